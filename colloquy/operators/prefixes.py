"""How much of a conversation each metric needs: gates over every beginning of a chat at once.

A chat of n messages has n beginnings. Each of them is the conversation up to one message, so what the
gates count over it is a running count at that message, and over its last WINDOW messages the difference of
two. Values that are counted once, as months, run over flags of first occurrences. One sort of a
chat's messages serves them all, and no beginning is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HARD_FLOOR, WINDOW
from . import metrics as M
from .sequence import transition_delta


def with_prefixes(rows: DataFrame) -> DataFrame:
    """Enriched ``rows`` with what gates count over the beginning that ends with each: rank, the counters, units and flags of fields."""
    order = Window.partitionBy("chat").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = lambda c: F.sum(c.cast("int")).over(upto)
    texts = M.is_text() & F.col("text").isNotNull()
    month = F.substring("date", 1, 7)
    new_month = month.isNotNull() & (F.row_number().over(Window.partitionBy("chat", month).orderBy("seq")) == 1)
    delta = transition_delta(F.col("ts0"), F.col("ts"), F.col("time0"), F.col("time"))
    marked = rows.withColumns({"_new_month": new_month, "_mine": texts & M.side("me"), "_theirs": texts & M.side("other"), "_reply": F.col("is_turn") & delta.isNotNull()})
    counted = marked.withColumns({
        "months": running(F.col("_new_month")),
        "sessions": F.col("session") + 1,
        "replies": running(F.col("_reply")),
        "emoticons": running((F.col("type") == "emoticon") & F.col("valence").isNotNull()),
        "texts_me": running(F.col("_mine")),
        "texts_other": running(F.col("_theirs")),
        "units": F.sum(M.info_tenths()).over(upto) / 10.0,
        "ts_all": F.min(F.col("ts").isNotNull()).over(upto),
        "date_all": F.min(F.col("date").isNotNull()).over(upto),
        "time_some": F.max(F.col("time").isNotNull()).over(upto),
        "text_some": F.max(F.col("text").isNotNull()).over(upto),
        "affect_some": F.max(F.col("valence").isNotNull()).over(upto),
    })
    in_window = lambda c: F.col(c) - F.coalesce(F.lag(c, WINDOW).over(order), F.lit(0))
    # A window's first message opens a burst of the window, wherever its burst began.
    bursts = F.col("burst") - F.coalesce(F.lag("burst", WINDOW - 1).over(order), F.first("burst").over(upto)) + 1
    return counted.withColumns({
        "window_messages": F.least("rank", F.lit(WINDOW)),
        "window_bursts": bursts,
        "texts": F.least("texts_me", "texts_other"),
        "window_texts": F.least(in_window("texts_me"), in_window("texts_other")),
        "window_pairs": F.greatest(bursts - 1, F.lit(0)),
    })


def fields_there() -> Column:
    """The fields that a beginning supports, from the flags of ``with_prefixes``."""
    flags = {"who": F.lit(True), "type": F.lit(True), "ts": F.col("ts_all"), "date": F.col("date_all"), "time": F.col("time_some"), "text": F.col("text_some"), "affect": F.col("affect_some"), "continuity": F.col("ts_all") & F.col("date_all")}
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda x: x.isNotNull())


def openings(rows: DataFrame, catalog: tuple, number_needs: int) -> DataFrame:
    """(chat, metric, opens_at): the smallest number of first messages of a chat with which each gate is open.

    ``report`` is the floor below which there is no report (of two messages at least), ``number`` the sample from which the headline
    shows its number. A gate that no beginning opens has null. A later message may shut a gate again.
    """
    there = with_prefixes(rows)
    open_ = {m.key: (F.size(F.array_except(F.array(*map(F.lit, m.needs)), fields_there())) == 0) & (F.lit(True) if m.counter == "unbounded" else F.col(m.counter) >= m.least) for m in catalog}
    open_ |= {"report": (F.col("units") >= HARD_FLOOR) & (F.col("rank") >= 2), "number": F.col("window_messages") >= number_needs}
    first = there.groupBy("chat").agg(*[F.min(F.when(c, F.col("rank"))).alias(k) for k, c in open_.items()])
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("opens_at")) for k in open_])
    return first.select("chat", F.inline(each))
