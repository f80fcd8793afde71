"""The conversation queries by name, and the SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import metrics as M
from ..operators import phrases as P
from ..operators import sequence as S
from ..sources.adapters import from_conversations, from_events, from_orders
from ..storage import stored
from . import oracle as O
from . import report as R

Query = Callable[[SparkSession, str], DataFrame]


def over_events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(S.enriched(from_events(spark, d)))


def over_stored(f: Callable[[DataFrame], DataFrame]) -> Query:
    """As over_events, for what reads the messages many times: they are numbered and sorted once, and each reader takes its columns."""
    return lambda spark, d: f(stored(S.enriched(from_events(spark, d)), "messages"))


def over_turns(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(S.enriched(from_conversations(spark, d)))


def over_orders(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(S.enriched(from_orders(spark, d)))


def over_pooled(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(from_conversations(spark, d, pooled=True))


SIDES = "me, other"
BINS = ", ".join(f"{w}_{k}" for w in ("me", "other") for k in ("fast", "mid", "slow", "n"))
HEADLINE = "chat, tilt, band, axes_used, axes_total, coarse, window_filled, axis_count, axis_length, axis_question"
LEANS = ", ".join(
    f"CASE WHEN {a} IS NOT NULL THEN CASE WHEN {a} >= 0.1 THEN 'me' WHEN {a} <= -0.1 THEN 'other' ELSE 'even' END || CASE WHEN abs({a}) >= 0.3 THEN '!' ELSE '' END END AS {a.replace('axis', 'lean')}"
    for a in R.AXES
)
FACT = """SELECT chat, info_units, info_units < 10 AS below_floor, CASE
  WHEN e5 AND (mf / mn) / (xf / xn) >= 1.5 THEN 'other replies slower' WHEN e5 AND (mf / mn) / (xf / xn) <= 1 / 1.5::DOUBLE THEN 'me replies slower'
  WHEN tot >= 10 AND sh >= 0.6 THEN 'me sends more' WHEN tot >= 10 AND sh <= 0.4 THEN 'other sends more' END AS fact FROM (
  SELECT iu.chat, info_units, me_fast::DOUBLE AS mf, me_n::DOUBLE AS mn, other_fast::DOUBLE AS xf, other_n::DOUBLE AS xn, me_n >= 5 AND other_n >= 5 AND me_fast > 0 AND other_fast > 0 AS e5,
  me + other AS tot, me / (me + other)::DOUBLE AS sh FROM iu LEFT JOIN rd USING (chat) JOIN cnt USING (chat))"""
VARIETY = f"""SELECT chat, coalesce(max(v) FILTER (who = 'me'), 0) AS me, coalesce(max(v) FILTER (who = 'other'), 0) AS other, coalesce(max(d) FILTER (who = 'me'), 0) AS me_unique, coalesce(max(d) FILTER (who = 'other'), 0) AS other_unique,
  coalesce(max(n) FILTER (who = 'me'), 0) AS me_total, coalesce(max(n) FILTER (who = 'other'), 0) AS other_total FROM (SELECT chat, who, count(*) AS n, count(DISTINCT coalesce(emoji_desc, '')) AS d,
  {O.up("CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(valence) END * (count(DISTINCT coalesce(emoji_desc, '')) / count(*)::DOUBLE)", 2)} AS v FROM e WHERE type = 'emoticon' AND valence IS NOT NULL GROUP BY ALL) GROUP BY chat"""

ALL = (O.STATUS, O.REPORTED, O.FIGURES)

#: name: (query, SQL)
REGISTERED: dict[str, tuple[Query, str | None]] = {
    "bursts": (over_events(S.bursts), O.on_events("SELECT chat, burst, any_value(who) AS who, min(seq) AS start_seq, count(*) AS messages FROM e GROUP BY ALL")),
    "sessions": (over_events(S.sessions), O.on_events("SELECT chat, sess AS session, opener, closer, messages, first_time, first_date, last_date FROM s")),
    "transitions": (over_events(S.transitions), O.on_events("SELECT chat, seq, responder, d AS delta_min FROM t")),
    "visible_time": (over_events(S.visible_times), O.on_events("SELECT chat, seq, coalesce(lead(time) OVER (PARTITION BY chat, burst ORDER BY seq) <> time, true) AS shown FROM e")),
    "msg_count": (over_events(M.message_count), O.on_events(f"SELECT chat, {SIDES} FROM cnt")),
    "msg_length": (over_events(M.message_length), O.on_events("SELECT chat, me, other FROM ml", *ALL)),
    "question_rate": (over_events(M.question_rate), O.on_events(f"SELECT chat, {SIDES} FROM qr")),
    "reply_dist": (over_events(M.reply_distribution), O.on_events(f"SELECT chat, {BINS} FROM rd")),
    "wake_proxy": (over_events(M.wake_proxy), O.on_events("SELECT chat, me_minute, other_minute, me_minute IS NOT NULL AND other_minute IS NOT NULL AS active FROM wake")),
    "initiation": (over_events(M.initiation), O.on_events("SELECT chat, me, other, sessions, wake_adjusted, excluded_handoffs FROM init")),
    "no_reply": (over_events(M.no_reply), O.on_events("SELECT chat, me_closed, other_closed, me_unanswered, other_unanswered, me_rate, other_rate FROM nr")),
    "monthly": (over_orders(M.monthly), O.on_orders("SELECT chat, month, messages, span, ma, granularity FROM mo")),
    "monthly_events": (over_events(M.monthly), O.on_events("SELECT chat, month, messages, span, ma, granularity FROM mo")),
    "change_point": (over_orders(M.change_point), O.on_orders("SELECT chat, month, drop FROM cp")),
    "emoji_affect": (over_events(M.emoji_affect), O.on_events("SELECT chat, me, other, gap FROM ea")),
    "emoji_variety": (over_events(M.emoji_variety), O.on_events(VARIETY)),
    "info_units": (over_events(M.info_units), O.on_events("SELECT chat, info_units, window_filled FROM iu")),
    "fields": (over_events(lambda e: R.available_fields(e).select("chat", F.array_join("fields", ",").alias("fields"))), O.on_events("SELECT chat, array_to_string(fields, ',') AS fields FROM fl", O.STATUS)),
    "fields_turns": (over_turns(lambda e: R.available_fields(e).select("chat", F.array_join("fields", ",").alias("fields"))), O.on_turns("SELECT chat, array_to_string(fields, ',') AS fields FROM fl", O.STATUS)),
    "metric_status": (over_stored(R.metric_status), O.on_events("SELECT chat, metric, status FROM st", O.STATUS)),
    "metric_status_turns": (over_turns(R.metric_status), O.on_turns("SELECT chat, metric, status FROM st", O.STATUS)),
    "headline": (over_events(R.headline), O.on_events(f"SELECT {HEADLINE} FROM hd")),
    "headline_turns": (over_turns(R.headline), O.on_turns(f"SELECT {HEADLINE} FROM hd")),
    "band_histogram": (over_events(R.band_histogram), O.on_events("SELECT band, count(*) AS chats, min(tilt) AS low, max(tilt) AS high FROM hd GROUP BY band")),
    "crush_signal": (over_events(R.crush_signal), O.on_events(f"SELECT chat, floor(50 - tilt / 2.0::DOUBLE + 0.5)::BIGINT AS score, {LEANS}, coarse FROM hd")),
    "odds": (over_stored(R.odds), O.on_events(f"SELECT * FROM ({O.ODDS})", *ALL)),
    "odds_orders": (over_orders(R.odds), O.on_orders(f"SELECT * FROM ({O.ODDS})", *ALL)),
    "figures": (over_stored(R.figures), O.on_events("SELECT * FROM fg", *ALL)),
    "figures_orders": (over_orders(R.figures), O.on_orders("SELECT * FROM fg", *ALL)),
    "strongest_signal": (over_stored(R.strongest_signal), O.on_events("SELECT chat, CASE WHEN s >= 0.18 THEN key ELSE 'flat' END AS signal, CASE WHEN s >= 0.18 THEN mine END AS mine, variant FROM sg1 WHERE k = 1", *ALL, O.SIGNAL)),
    "single_fact": (over_events(R.single_fact), O.on_events(FACT)),
    "single_fact_turns": (over_turns(R.single_fact), O.on_turns(FACT)),
    "ngram_counts": (over_pooled(lambda m: P.ngram_counts(P.ngrams(m)).select("chat", "gram", "fa", "fb")), O.q("SELECT chat, gram, fa, fb FROM gc", O.POOLED, O.GRAMS)),
    "subset_drop": (over_pooled(lambda m: P.drop_subsets(P.candidates(P.ngram_counts(P.ngrams(m)))).select("chat", "gram", "fa", "fb")), O.q("SELECT chat, gram, fa, fb FROM kp", O.POOLED, O.GRAMS)),
    "phrase_gap": (over_pooled(P.phrase_gap), O.q("SELECT chat, side, place, gram, z, me, other FROM pg WHERE place <= 8", O.POOLED, O.GRAMS)),
    "report": (over_stored(R.report), None),
}


def register(name: str, query: Query, sql: str | None = None) -> None:
    REGISTERED[name] = (query, sql)


def sliding_axes(rows: DataFrame, size: int = 120, step: int = 40) -> DataFrame:
    """The count and length axes over every window of ``size`` messages, ``step`` apart; a message joins the windows that cover it."""
    place = F.col("rank") - 1
    last = F.floor((F.col("total") - size) / step)
    first = F.greatest(F.ceil((place - (size - 1)) / step), F.lit(0))
    upto = F.least(F.floor(place / step), last)
    covered = rows.where(F.col("total") >= size).where(first <= upto).withColumn("start", F.explode(F.sequence(first.cast("long") * step, upto.cast("long") * step, F.lit(step).cast("long"))))
    mine, text = F.col("who") == "me", M.is_text()
    sums = covered.groupBy("chat", "start").agg(
        F.count_if(mine).alias("a"), F.count_if(~mine).alias("b"), M.mean_where(F.col("char_count"), text & mine).alias("la"), M.mean_where(F.col("char_count"), text & ~mine).alias("lb")
    )
    from ..functions.numbers import norm

    return sums.select("chat", "start", half_up(norm(F.col("a"), F.col("b")), 4).alias("axis_count"), half_up(norm(F.col("la"), F.col("lb")), 4).alias("axis_length"))


def axis_correlation(rows: DataFrame) -> DataFrame:
    """Correlation of the two axes over sliding windows, for each chat and for all together (chat null)."""
    x, y = F.col("axis_count"), F.col("axis_length")
    sums = sliding_axes(rows).rollup("chat").agg(F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.count("*").alias("windows"))
    flat = (F.col("sx") < 1e-12) | (F.col("sy") < 1e-12)
    return sums.select("chat", half_up(F.when(flat, 0.0).otherwise(F.try_divide("c", F.col("sx") * F.col("sy"))), 6).alias("r"), "windows")


SLIDING = f"""
wd AS (SELECT chat, unnest(range(0, n - 119, 40)) AS start FROM (SELECT DISTINCT chat, n FROM e WHERE n >= 120)),
sl0 AS (SELECT w.chat, w.start, count(*) FILTER (who = 'me') AS a, count(*) FILTER (who = 'other') AS b, coalesce(avg(char_count) FILTER (type = 'text' AND who = 'me'), 0) AS la, coalesce(avg(char_count) FILTER (type = 'text' AND who = 'other'), 0) AS lb
  FROM wd w JOIN e ON e.chat = w.chat AND e.rk > w.start AND e.rk <= w.start + 120 GROUP BY ALL),
sl AS (SELECT chat, start, {O.up("CASE WHEN a + b = 0 THEN 0 ELSE (a - b) / (a + b)::DOUBLE END", 4)} AS axis_count, {O.up("CASE WHEN la + lb = 0 THEN 0 ELSE (la - lb) / (la + lb) END", 4)} AS axis_length FROM sl0)"""
register("sliding_axes", over_events(sliding_axes), O.on_events("SELECT * FROM sl", SLIDING))
register("axis_corr", over_events(axis_correlation), O.on_events(f"SELECT chat, {O.up('CASE WHEN sx < 1e-12 OR sy < 1e-12 THEN 0 ELSE c / (sx * sy) END', 6)} AS r, windows FROM (SELECT chat, covar_pop(axis_count, axis_length) AS c, stddev_pop(axis_count) AS sx, stddev_pop(axis_length) AS sy, count(*) AS windows FROM sl GROUP BY GROUPING SETS ((chat), ()))", SLIDING))


def type_mix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chat").pivot("type", ["text", "photo", "emoticon"]).agg(F.count("seq")).na.fill(0)


register("type_mix", over_events(type_mix), O.on_events("SELECT chat, count(*) FILTER (type = 'text') AS text, count(*) FILTER (type = 'photo') AS photo, count(*) FILTER (type = 'emoticon') AS emoticon FROM e GROUP BY chat"))


def highlights(rows: DataFrame, top: int = 100, least: int = 15) -> DataFrame:
    """The longest texts of a chat; the limit is the feature."""
    order = Window.partitionBy("chat").orderBy(F.desc("char_count"), "seq")
    return rows.where(M.is_text() & (F.col("char_count") >= least)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("chat", "seq", "char_count", "place")


register("highlights", over_events(highlights), O.on_events("SELECT chat, seq, char_count, place FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY char_count DESC, seq) AS place FROM e WHERE type = 'text' AND char_count >= 15) WHERE place <= 100"))
register("highlights_turns", over_turns(highlights), O.on_turns("SELECT chat, seq, char_count, place FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY char_count DESC, seq) AS place FROM e WHERE type = 'text' AND char_count >= 15) WHERE place <= 100"))


def worker_summary(rows: DataFrame) -> DataFrame:
    """What a client shows of a chat besides its window."""
    return rows.groupBy("chat").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("who") == "me").alias("me"),
        F.max("burst").alias("bursts"),
        (F.max("session") + 1).alias("sessions"),
        F.count_distinct(F.substring("date", 1, 7)).alias("months"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


register("worker_summary", over_events(worker_summary), O.on_events("SELECT chat, count(*) AS messages, count(*) FILTER (who = 'me') AS me, max(burst) AS bursts, max(sess) + 1 AS sessions, count(DISTINCT date[1:7]) AS months, min(date) AS first_date, max(date) AS last_date FROM e GROUP BY chat"))


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
