"""The metrics of a conversation, each keyed by chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, nearest_rank, norm, ratio, shrunk_rate
from .sequence import minute_of_day, sessions, transitions

SIDES = ("me", "other")
MORNING = (4 * 60, 12 * 60)
WAKE_SAMPLES, WAKE_DAYS, WAKE_RANK, WAKE_SLACK = 30, 14, 0.05, 120


def side(who: str, column: str = "who") -> Column:
    return F.col(column) == who


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def mean_where(value: Column, condition: Column) -> Column:
    """Mean over the rows that meet the condition, 0 without any."""
    return F.coalesce(F.sum(F.when(condition, value)) / F.nullif(F.count_if(condition), F.lit(0)), F.lit(0.0))


def is_text() -> Column:
    return F.col("type") == "text"


def info_tenths() -> Column:
    """How much a message tells, in tenths, so that sums are exact."""
    return (
        F.when(is_text(), F.when(F.col("char_count") >= 10, 10).when(F.col("char_count") >= 3, 7).otherwise(4))
        .when(F.col("type") == "emoticon", F.when(F.col("valence").isNotNull(), 12).otherwise(1))
        .when(F.col("type") == "photo", 3)
        .when(F.col("type") == "nontext", 1)
        .otherwise(0)
    )


def info_units(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chat").agg((F.sum(info_tenths()) / 10.0).alias("info_units"), F.count_if("in_window").alias("window_filled"))


def message_count(rows: DataFrame) -> DataFrame:
    return rows.where("in_window").groupBy("chat").agg(*[count_where(side(w)).alias(w) for w in SIDES])


def message_length(rows: DataFrame) -> DataFrame:
    mean = lambda w: half_up(mean_where(F.col("char_count"), is_text() & side(w)), 2)
    return rows.where("in_window").groupBy("chat").agg(*[mean(w).alias(w) for w in SIDES])


def window_bursts(rows: DataFrame) -> DataFrame:
    """Per chat: bursts of the window by side, and those that ask."""
    asks = F.bool_or(is_text() & F.coalesce(F.col("text").contains("?"), F.lit(False)))
    runs = rows.where("in_window").groupBy("chat", "window_burst").agg(F.first("who").alias("who"), asks.alias("asks"))
    return runs.groupBy("chat").agg(
        *[count_where(side(w)).alias(f"bursts_{w}") for w in SIDES],
        *[count_where(side(w) & F.col("asks")).alias(f"asking_{w}") for w in SIDES],
    )


def question_rate(rows: DataFrame) -> DataFrame:
    return window_bursts(rows).select("chat", *[half_up(ratio(F.col(f"asking_{w}"), F.col(f"bursts_{w}")), 2).alias(w) for w in SIDES])


def reply_distribution(rows: DataFrame) -> DataFrame:
    """Replies by how long they took; n also counts those beyond six hours."""
    d = F.col("delta_min")
    bins = {"fast": d <= 5, "mid": (d > 5) & (d <= 60), "slow": (d > 60) & (d <= 360), "n": d.isNotNull()}
    return transitions(rows).groupBy("chat").agg(*[count_where(F.coalesce(c, F.lit(False)) & side(w, "responder")).alias(f"{w}_{k}") for w in SIDES for k, c in bins.items()])


def wake_proxy(rows: DataFrame) -> DataFrame:
    """When each side's mornings begin, if both have enough of them."""
    minute = minute_of_day(F.col("time"))
    mornings = rows.where(F.col("date").isNotNull()).withColumn("minute", minute).where((F.col("minute") >= MORNING[0]) & (F.col("minute") < MORNING[1]))
    each = mornings.groupBy("chat", "who").agg(F.count("*").alias("n"), F.count_distinct("date").alias("days"), nearest_rank(F.collect_list("minute"), WAKE_RANK).alias("p"))
    each = each.withColumn("minute", F.when((F.col("n") >= WAKE_SAMPLES) & (F.col("days") >= WAKE_DAYS), F.col("p")))
    wide = each.groupBy("chat").agg(*[F.max(F.when(side(w), F.col("minute"))).alias(f"{w}_minute") for w in SIDES])
    return wide.withColumn("active", F.col("me_minute").isNotNull() & F.col("other_minute").isNotNull())


def with_handoffs(rows: DataFrame) -> DataFrame:
    """Sessions, and which of them only take up in the morning what the day before left."""
    order = Window.partitionBy("chat").orderBy("session")
    runs = sessions(rows).withColumns({"prev_date": F.lag("last_date").over(order), "next_opener": F.lead("opener").over(order)})
    woken = runs.join(wake_proxy(rows), "chat", "left")
    wake = F.when(side("me", "opener"), F.col("me_minute")).otherwise(F.col("other_minute"))
    near = minute_of_day(F.col("first_time")) <= wake + WAKE_SLACK
    day = F.date_diff(F.to_date("first_date"), F.to_date("prev_date")) == 1
    return woken.withColumn("handoff", F.coalesce(F.col("active") & near & day, F.lit(False)))


def initiation(rows: DataFrame) -> DataFrame:
    """Who starts sessions, morning hand-offs aside, as a shrunk percentage."""
    counted = with_handoffs(rows).groupBy("chat").agg(
        count_where(~F.col("handoff") & side("me", "opener")).alias("mine"),
        count_where(~F.col("handoff")).alias("sessions"),
        count_where("handoff").alias("excluded_handoffs"),
        F.coalesce(F.bool_or("active"), F.lit(False)).alias("wake_adjusted"),
    )
    p = shrunk_rate(F.col("mine"), F.col("sessions"))
    return counted.select("chat", (half_up(p * 1000) / 10).alias("me"), (half_up((1 - p) * 1000) / 10).alias("other"), "sessions", "wake_adjusted", "excluded_handoffs")


def no_reply(rows: DataFrame) -> DataFrame:
    """Sessions that a side closed and the other did not take up; the last one counts so."""
    order = Window.partitionBy("chat").orderBy("session")
    runs = sessions(rows).withColumn("next_opener", F.lead("opener").over(order))
    left = F.col("next_opener").isNull() | (F.col("next_opener") == F.col("closer"))
    counted = runs.groupBy("chat").agg(
        *[count_where(side(w, "closer")).alias(f"{w}_closed") for w in SIDES], *[count_where(side(w, "closer") & left).alias(f"{w}_unanswered") for w in SIDES]
    )
    rate = lambda w: (half_up(shrunk_rate(F.col(f"{w}_unanswered"), F.col(f"{w}_closed")) * 1000) / 10).alias(f"{w}_rate")
    return counted.select("*", *[rate(w) for w in SIDES])


def monthly(rows: DataFrame) -> DataFrame:
    """Messages a month with a trailing mean over 1, 2 or 3 observed months."""
    months = rows.where(F.col("date").isNotNull()).groupBy("chat", F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("messages"))
    order = Window.partitionBy("chat").orderBy("month")
    spans = months.withColumn("span", F.count("*").over(Window.partitionBy("chat")))
    k = F.when(F.col("span") >= 12, 3).when(F.col("span") >= 6, 2).otherwise(1)
    at = F.row_number().over(order)
    trail = lambda n: F.sum("messages").over(order.rowsBetween(-(n - 1), 0)) / float(n)
    mean = F.when(k == 3, trail(3)).when(k == 2, trail(2)).otherwise(trail(1))
    return spans.withColumn("ma", F.when(at >= k, half_up(mean * 10) / 10)).withColumn("granularity", F.when(F.col("span") >= 6, "month").otherwise("week"))


def change_point(rows: DataFrame) -> DataFrame:
    """The largest relative drop of the trailing mean, the first one on ties; chats of 12 months or more."""
    order = Window.partitionBy("chat").orderBy("month")
    drops = monthly(rows).where("span >= 12").withColumn("before", F.lag("ma").over(order)).where("before > 0 AND ma IS NOT NULL")
    drop = (F.col("before") - F.col("ma")) / F.col("before")
    best = drops.withColumn("drop", drop).where("drop > 0").withColumn("k", F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("drop"), "month"))).where("k = 1")
    return best.select("chat", "month", (half_up(F.col("drop") * 1000) / 10).alias("drop"))


def affective(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("type") == "emoticon") & F.col("valence").isNotNull())


def emoji_affect(rows: DataFrame) -> DataFrame:
    score = F.col("valence") * F.col("intensity")
    means = affective(rows).groupBy("chat").agg(*[mean_where(score, side(w)).alias(f"_{w}") for w in SIDES])
    gap = half_up((F.col("_me") - F.col("_other")) / 2 * 100)
    return means.select("chat", *[half_up(F.col(f"_{w}"), 2).alias(w) for w in SIDES], gap.alias("gap"))


def emoji_variety(rows: DataFrame) -> DataFrame:
    each = affective(rows).groupBy("chat", "who").agg(
        F.stddev_pop("valence").alias("sd"), F.count_distinct(F.coalesce("emoji_desc", F.lit(""))).alias("distinct"), F.count("*").alias("n")
    )
    value = half_up(F.when(F.col("n") < 2, 0.0).otherwise(F.col("sd")) * (F.col("distinct") / F.col("n")), 2)
    pick = lambda w, c: F.coalesce(F.max(F.when(side(w), c)), F.lit(0))
    return each.groupBy("chat").agg(
        *[pick(w, value).cast("double").alias(w) for w in SIDES],
        *[pick(w, F.col("distinct")).alias(f"{w}_unique") for w in SIDES],
        *[pick(w, F.col("n")).alias(f"{w}_total") for w in SIDES],
    )


def axes(rows: DataFrame) -> DataFrame:
    """Signed shares of the last window, rounded, null where a side gives nothing to compare."""
    counts = rows.where("in_window").groupBy("chat").agg(
        *[count_where(side(w)).alias(f"n_{w}") for w in SIDES],
        count_where(is_text()).alias("texts"),
        *[mean_where(F.col("char_count"), is_text() & side(w)).alias(f"len_{w}") for w in SIDES],
    )
    both = counts.join(window_bursts(rows), "chat")
    share = lambda w: F.col(f"asking_{w}") / F.nullif(F.col(f"bursts_{w}"), F.lit(0))
    return both.select(
        "chat",
        half_up(norm(F.col("n_me"), F.col("n_other")), 2).alias("axis_count"),
        F.when(F.col("texts") > 0, half_up(norm(F.col("len_me"), F.col("len_other")), 2)).alias("axis_length"),
        half_up(norm(share("me"), share("other")), 2).alias("axis_question"),
        (F.col("n_me") + F.col("n_other")).alias("window_filled"),
    )
