"""From metrics to a report: gates, headline, percent cards, single facts, figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp01, half_up
from ..operators import metrics as M
from ..operators import phrases as P
from ..operators import semantic as V
from ..operators.sequence import sessions, transitions
from ..schema import HARD_FLOOR

AXES = ("axis_count", "axis_length", "axis_question")
AXES_TOTAL = 4
NUMBER_NEEDS = 60
SYNC_SCALE = 0.15
SPREAD, DEAD_ZONE, LEAST_PARTS = 4.0, 12.0, 2
EVEN, STRONG, FLAT = 0.1, 0.3, 0.18


@dataclass(frozen=True)
class Metric:
    """A gated metric: the fields it needs, and how many of which sample."""

    key: str
    needs: tuple[str, ...]
    least: int
    counter: str


#: Fixed gates of the 14 metrics.
CATALOG = (
    Metric("msgCount", ("who",), 30, "window_messages"),
    Metric("msgLength", ("who", "text"), 30, "window_messages"),
    Metric("questionRate", ("who", "text"), 20, "window_bursts"),
    Metric("syncAsym", ("text", "embedding"), 20, "window_pairs"),
    Metric("styleSep", ("text", "embedding"), 30, "window_texts"),
    Metric("replyDist", ("time", "who"), 20, "replies"),
    Metric("initiation", ("ts", "date", "continuity"), 20, "sessions"),
    Metric("noReply", ("ts", "date", "continuity"), 20, "sessions"),
    Metric("monthly", ("date", "continuity"), 3, "months"),
    Metric("changePoint", ("date", "continuity"), 12, "months"),
    Metric("phraseGap", ("text",), 200, "texts"),
    Metric("deletedCount", ("type", "continuity"), 0, "unbounded"),
    Metric("emojiAffect", ("affect",), 8, "emoticons"),
    Metric("emojiVariety", ("affect",), 8, "emoticons"),
)


def available_fields(rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """The fields that a conversation's rows, and vectors of (chat, seq, who, v), support: some need all rows, some any."""
    every = lambda c: F.bool_and(F.col(c).isNotNull())
    some = lambda c: F.bool_or(F.col(c).isNotNull())
    flags = {"who": F.lit(True), "type": F.lit(True), "ts": every("ts"), "date": every("date"), "time": some("time"), "text": some("text"), "affect": some("valence"), "continuity": every("ts") & every("date")}
    found = rows.groupBy("chat").agg(*[c.alias(k) for k, c in flags.items()])
    if vectors is not None:
        found = found.join(vectors.select("chat").distinct().withColumn("embedding", F.lit(True)), "chat", "left")
        flags["embedding"] = F.col("embedding")
    return found.select("chat", F.filter(F.array(*[F.when(F.col(k), k) for k in flags]), lambda x: x.isNotNull()).alias("fields"))


def semantic(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row a chat with vectors: how each side's replies match, reply pairs, and how far styles are apart, in the window."""
    own = vectors.join(rows.where("in_window").select("chat", "seq"), ["chat", "seq"]).select("chat", "seq", "who", "v")
    pick = lambda w: F.max(F.when(F.col("responder") == w, F.col("net"))).alias(f"sync_{w}")
    sync = V.sync_seeded(V.reply_pairs(own)).groupBy("chat").agg(pick("me"), pick("other"), F.sum("pairs").alias("pairs"))
    style = V.style_separation(own).select("chat", F.col("score").alias("style_score"), F.col("ratio").alias("style_ratio"))
    return style.join(sync, "chat", "left")


def sample_counts(rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """How much there is of what the gates count."""
    least = lambda c: F.least(F.count_if(c & M.side("me")), F.count_if(c & M.side("other")))
    texts = M.is_text() & F.col("text").isNotNull()
    counts = rows.groupBy("chat").agg(
        F.count_if("in_window").alias("window_messages"),
        least(texts).alias("texts"),
        least(texts & F.col("in_window")).alias("window_texts"),
        F.count_if((F.col("type") == "emoticon") & F.col("valence").isNotNull()).alias("emoticons"),
        F.count_distinct(F.substring("date", 1, 7)).alias("months"),
        F.count_distinct("session").alias("sessions"),
    )
    replies = transitions(rows).groupBy("chat").agg(F.count("delta_min").alias("replies"))
    bursts = M.window_bursts(rows).select("chat", (F.col("bursts_me") + F.col("bursts_other")).alias("window_bursts"))
    out = counts.join(replies, "chat", "left").join(bursts, "chat")
    out = out.withColumns({"replies": F.coalesce("replies", F.lit(0)), "window_pairs": F.greatest(F.col("window_bursts") - 1, F.lit(0))})
    if vectors is None:
        return out
    # The gate needs their number alone; texts without a vector are left out, as in ``semantic``.
    own = vectors.select("chat", "seq", "who").join(rows.where("in_window").select("chat", "seq"), ["chat", "seq"])
    before = F.lag("who").over(Window.partitionBy("chat").orderBy("seq"))
    pairs = own.withColumn("_who0", before).groupBy("chat").agg(F.count_if(F.col("_who0") != F.col("who")).alias("pairs"))
    return out.join(pairs, "chat", "left").withColumn("window_pairs", F.coalesce("pairs", F.lit(0))).drop("pairs")


def metric_status(rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row a chat and metric: OK, LOCKED by missing fields, or INSUFFICIENT with have/need."""
    base = available_fields(rows, vectors).join(sample_counts(rows, vectors), "chat")

    def row(m: Metric) -> Column:
        missing = F.array_except(F.array(*map(F.lit, m.needs)), F.col("fields"))
        enough = F.lit(True) if m.counter == "unbounded" else F.col(m.counter) >= m.least
        short = F.lit("") if m.counter == "unbounded" else F.concat(F.lit("INSUFFICIENT:"), F.col(m.counter).cast("string"), F.lit(f"/{m.least}"))
        status = F.when(F.size(missing) > 0, F.concat(F.lit("LOCKED:"), F.array_join(missing, ","))).when(enough, "OK").otherwise(short)
        return F.struct(F.lit(m.key).alias("metric"), status.alias("status"))

    return base.select("chat", F.explode(F.array(*map(row, CATALOG))).alias("m")).select("chat", "m.metric", "m.status")


def band(tilt: Column) -> Column:
    return F.when(tilt >= 55, "strong_me").when(tilt >= 20, "lean_me").when(tilt > -20, "even").when(tilt > -55, "lean_other").otherwise("strong_other")


def headline(rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Tilt from -100 to 100: the mean of the axes that are there. Vectors give a fourth axis."""
    a, names = M.axes(rows), AXES
    if vectors is not None:
        sync = semantic(rows, vectors).select("chat", half_up(sync_axis(F.col("sync_me"), F.col("sync_other")), 2).alias("axis_sync"))
        a, names = a.join(sync, "chat", "left"), (*AXES, "axis_sync")
    there = F.filter(F.array(*names), lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda s, x: s + x)
    tilt = F.when(F.size(there) == 0, F.lit(0.0)).otherwise(half_up(100 * total / F.size(there)))
    return a.withColumns({"tilt": tilt.cast("long"), "axes_used": F.size(there)}).select(
        "chat", "tilt", band(F.col("tilt")).alias("band"), "axes_used", F.lit(AXES_TOTAL).alias("axes_total"), (F.col("window_filled") < NUMBER_NEEDS).alias("coarse"), "window_filled", *names
    )


def sync_axis(me: Column, other: Column) -> Column:
    return F.when(me.isNotNull() & other.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (me - other) / SYNC_SCALE)))


def crush_signal(rows: DataFrame) -> DataFrame:
    """The headline read from the other side: 0 to 100, with a direction for each axis."""

    def reading(c: str) -> Column:
        v = F.col(c)
        lean = F.when(v >= EVEN, "me").when(v <= -EVEN, "other").otherwise("even")
        return F.when(v.isNotNull(), F.concat(lean, F.when((F.abs(v) >= STRONG) & (lean != "even"), "!").otherwise(""))).alias(c.replace("axis", "lean"))

    h = headline(rows)
    return h.select("chat", half_up(50 - F.col("tilt") / 2).cast("long").alias("score"), *[reading(c) for c in AXES], "coarse")


def reported(rows: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Everything the cards read, one row a chat; a metric whose gate is shut is null."""
    status = metric_status(rows, vectors).groupBy("chat").pivot("metric", [m.key for m in CATALOG]).agg(F.first("status"))
    parts = {
        "msgCount": M.message_count(rows).select("chat", F.col("me").alias("count_me"), F.col("other").alias("count_other")),
        "msgLength": M.message_length(rows).select("chat", F.col("me").alias("length_me"), F.col("other").alias("length_other")),
        "questionRate": M.question_rate(rows).select("chat", F.col("me").alias("question_me"), F.col("other").alias("question_other")),
        "initiation": M.initiation(rows).select("chat", F.col("me").alias("initiation_me"), F.col("other").alias("initiation_other")),
        "noReply": M.no_reply(rows).select("chat", F.col("me_rate").alias("noreply_me"), F.col("other_rate").alias("noreply_other")),
        "emojiAffect": M.emoji_affect(rows).select("chat", F.col("me").alias("affect_me"), F.col("other").alias("affect_other"), F.col("gap").alias("affect_gap")),
        "changePoint": M.change_point(rows).select("chat", F.col("month").alias("change_month"), F.col("drop").alias("change_drop")),
    }
    out = headline(rows, vectors).join(status, "chat")
    for key, frame in parts.items():
        names = [c for c in frame.columns if c != "chat"]
        out = out.join(frame, "chat", "left").withColumns({c: F.when(F.col(key) == "OK", F.col(c)) for c in names})
    return out.drop(*[m.key for m in CATALOG])


def blended(parts: list[tuple[Column, int]], coarse: Column, tilt: Column) -> tuple[Column, Column]:
    """Percent of a card and the number of parts used; parts that are null don't count."""
    used = sum((F.when(v.isNotNull(), 1).otherwise(0) for v, _ in parts), F.lit(0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0) for v, w in parts), F.lit(0))
    total = sum((F.coalesce(v * float(w), F.lit(0.0)) for v, w in parts), F.lit(0.0))
    d = total / weight - 0.5
    way = F.when(d != 0, F.signum(d)).when(tilt != 0, -F.signum(tilt)).otherwise(-1.0)
    percent = 50 + way * (DEAD_ZONE + (50 - DEAD_ZONE) * F.tanh(F.abs(d) * SPREAD))
    return F.when(coarse, half_up(percent / 5) * 5).otherwise(half_up(percent * 10) / 10), used


def low_by_high(a: str, b: str) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(high > 0, clamp01(low / high)).when(high.isNotNull(), 0.0)


def odds(rows: DataFrame) -> DataFrame:
    """The two percent cards, long form; a card with fewer than two parts is left out."""
    r = reported(rows)
    asked = F.col("question_me") + F.col("question_other")
    reciprocity = blended(
        [
            (clamp01((100 - F.col("tilt")) / 200), 3),
            (F.when(F.col("initiation_other").isNotNull(), clamp01(F.col("initiation_other") / 100)), 2),
            (F.when(asked > 0, clamp01(F.col("question_other") / asked)), 2),
            (F.when(F.col("noreply_other").isNotNull(), clamp01(1 - F.col("noreply_other") / 100)), 2),
            (F.when(F.col("affect_other").isNotNull(), clamp01((F.col("affect_other") + 1) / 2)), 1),
        ],
        F.col("coarse"),
        F.col("tilt"),
    )
    momentum = blended(
        [
            (clamp01(1 - F.abs("tilt") / 100), 3),
            (F.when(F.col("noreply_me").isNotNull(), clamp01(1 - F.greatest("noreply_me", "noreply_other") / 100)), 2),
            (low_by_high("question_me", "question_other"), 2),
            (low_by_high("length_me", "length_other"), 1),
            (F.when(F.col("change_drop").isNotNull(), clamp01(1 - F.col("change_drop") / 100)), 2),
        ],
        F.col("coarse"),
        F.col("tilt"),
    )
    card = lambda key, c: F.struct(F.lit(key).alias("card"), c[0].alias("percent"), c[1].alias("used"))
    return r.select("chat", F.explode(F.array(card("reciprocity", reciprocity), card("momentum", momentum))).alias("c")).select("chat", "c.*").where(F.col("used") >= LEAST_PARTS)


def figure_columns() -> dict[str, Column]:
    """Numbers that a sentence about the conversation may use, out of the columns of ``reported``."""
    share = half_up(F.col("count_me") / F.nullif(F.col("count_me") + F.col("count_other"), F.lit(0)) * 100)
    whole = lambda c: c.cast("long")
    return {
        "share_me": whole(share),
        "share_other": whole(100 - share),
        "length_gap": whole(F.abs(half_up(F.col("length_me") - F.col("length_other")))),
        "question_gap": whole(F.abs(half_up((F.col("question_me") - F.col("question_other")) * 100))),
        "initiation_top": whole(half_up(F.when(F.col("initiation_me").isNotNull(), F.greatest("initiation_me", "initiation_other")))),
        "affect_gap": F.abs("affect_gap"),
        "noreply_top": whole(half_up(F.when(F.col("noreply_me").isNotNull(), F.greatest("noreply_me", "noreply_other")))),
        "change_month": F.substring("change_month", 6, 2).cast("long"),
        "change_drop": F.col("change_drop"),
    }


def figures(rows: DataFrame) -> DataFrame:
    return reported(rows).select("chat", *[c.alias(k) for k, c in figure_columns().items()])


def strongest_signal(rows: DataFrame) -> DataFrame:
    """Which observation a fallback sentence is made of; flat if none is strong enough."""
    r = reported(rows).withColumns({"signed_gap": F.col("affect_gap"), **figure_columns()})
    signals = [
        ("share", F.abs(F.col("share_me") - 50) / 25, F.col("share_me") >= 50),
        ("length", F.col("length_gap") / 12, F.col("length_me") >= F.col("length_other")),
        ("question", F.col("question_gap") / 20, F.col("question_me") >= F.col("question_other")),
        ("initiation", (F.col("initiation_top") - 50) / 25, F.col("initiation_me") >= F.col("initiation_other")),
        ("emoji", F.col("affect_gap") / 0.5, F.col("signed_gap") >= 0),
        ("cool", F.col("change_drop") / 40, F.lit(True)),
    ]
    listed = F.array(*[F.struct((-s).alias("weak"), F.lit(i).alias("place"), F.lit(k).alias("key"), m.alias("mine")) for i, (k, s, m) in enumerate(signals)])
    top = F.get(F.array_sort(F.filter(listed, lambda x: x["weak"].isNotNull())), F.lit(0))
    strong = F.coalesce(-top["weak"] >= FLAT, F.lit(False))
    return r.select("chat", F.when(strong, top["key"]).otherwise("flat").alias("signal"), F.when(strong, top["mine"]).alias("mine"), (F.col("window_filled") % 2).cast("long").alias("variant"))


def single_fact(rows: DataFrame) -> DataFrame:
    """The one thing that can be said for certain, and whether the chat is below the floor."""
    r = M.info_units(rows).join(M.reply_distribution(rows), "chat", "left").join(M.message_count(rows), "chat")
    quick = lambda w: F.col(f"{w}_fast") / F.nullif(F.col(f"{w}_n"), F.lit(0))
    ratio = quick("me") / F.nullif(quick("other"), F.lit(0.0))
    enough = (F.col("me_n") >= 5) & (F.col("other_n") >= 5) & (quick("me") > 0) & (quick("other") > 0)
    share = F.col("me") / (F.col("me") + F.col("other"))
    many = F.col("me") + F.col("other") >= 10
    fact = (
        F.when(enough & (ratio >= 1.5), "other replies slower")
        .when(enough & (ratio <= 1 / 1.5), "me replies slower")
        .when(many & (share >= 0.6), "me sends more")
        .when(many & (share <= 0.4), "other sends more")
    )
    return r.select("chat", "info_units", (F.col("info_units") < HARD_FLOOR).alias("below_floor"), fact.alias("fact"))


def band_histogram(rows: DataFrame) -> DataFrame:
    return headline(rows).groupBy("band").agg(F.count("*").alias("chats"), F.min("tilt").alias("low"), F.max("tilt").alias("high"))


def deleted_count(rows: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Deleted messages of a chat: from ``counters`` (parse_stats of an export, whose rows don't hold them), else from the rows."""
    if counters is not None:
        return counters.select("chat", "deleted")
    return rows.groupBy("chat").agg(F.count_if(F.col("type") == "deleted").alias("deleted"))


def further(rows: DataFrame, vectors: DataFrame | None, counters: DataFrame | None) -> dict[str, DataFrame]:
    """Values of the metrics that no card reads, by metric."""
    replies, variety = M.reply_distribution(rows), M.emoji_variety(rows)
    listed = lambda df, order, *names: df.groupBy("chat").agg(F.array_sort(F.collect_list(F.struct(*order, *names))))
    out = {
        "replyDist": replies.select("chat", *[F.col(c).alias(f"reply_{c}") for c in replies.columns if c != "chat"]),
        "monthly": listed(M.monthly(rows), ["month"], "messages", "ma", "granularity").toDF("chat", "months"),
        "phraseGap": listed(P.phrase_gap(rows), ["side", "place"], "gram", "z", "me", "other").toDF("chat", "phrases"),
        "deletedCount": deleted_count(rows, counters),
        "emojiVariety": variety.select("chat", *[F.col(c).alias(f"variety_{c}") for c in variety.columns if c != "chat"]),
    }
    if vectors is not None:
        near = semantic(rows, vectors)
        out |= {"syncAsym": near.select("chat", "sync_me", "sync_other"), "styleSep": near.select("chat", "style_score", "style_ratio")}
    return out


def report(rows: DataFrame, vectors: DataFrame | None = None, counters: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """One JSON document a chat: mode, gates, the values of all metrics whose gate is open, and the gaps of (chat, gap).

    A chat below the floor has no more than its units and the one fact that is certain.
    """
    gates = metric_status(rows, vectors).groupBy("chat").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "status")))).alias("status"))
    units = single_fact(rows).join(rows.groupBy("chat").agg(F.when(F.bool_and(F.col("ts").isNotNull()), "txt").otherwise("capture").alias("mode")), "chat")
    if gaps is not None:
        units = units.join(gaps.groupBy("chat").agg(F.array_sort(F.collect_set("gap")).alias("gaps")), "chat", "left")
    all_ = reported(rows, vectors).join(gates, "chat").join(units, "chat")
    for key, frame in further(rows, vectors, counters).items():
        names = [c for c in frame.columns if c != "chat"]
        all_ = all_.join(frame, "chat", "left").withColumns({c: F.when(F.col("status")[key] == "OK", F.col(c)) for c in names})
    low = F.to_json(F.struct(F.lit("hard_floor").alias("kind"), "info_units", F.col("fact").alias("single_fact")))
    whole = F.to_json(F.struct(*[c for c in all_.columns if c not in ("chat", "below_floor", "fact")]))
    return all_.select("chat", F.when(F.col("below_floor"), low).otherwise(whole).alias("report"))
