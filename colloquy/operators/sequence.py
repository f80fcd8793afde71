"""Bursts, sessions and transitions: one window over (chat, seq) marks them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SESSION_GAP_MS, WINDOW


def minute_of_day(time: Column) -> Column:
    """Minutes of an H:mm or HH:mm label, null for any other text."""
    ok = time.rlike(r"\A\d{1,2}:\d{2}\z")
    return F.when(ok, F.split_part(time, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(time, F.lit(":"), F.lit(2)).cast("int"))


def transition_delta(ts0: Column, ts: Column, time0: Column, time: Column) -> Column:
    """Minutes from one message to its answer.

    With both timestamps there is no upper limit, and a negative gap is null.
    From clock times a negative gap passes midnight, and more than six hours is null.
    """
    gap = (ts - ts0) / 60000.0
    clock = (minute_of_day(time) - minute_of_day(time0) + 1440) % 1440
    by_clock = F.when(clock <= 360, clock.cast("double"))
    return F.when(ts0.isNotNull() & ts.isNotNull(), F.when(gap >= 0, gap)).otherwise(by_clock)


def enriched(messages: DataFrame) -> DataFrame:
    """Messages with their neighbours and the ids of burst and session; in_window marks the last WINDOW of a chat."""
    order = Window.partitionBy("chat").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumns({
        "who0": F.lag("who").over(order),
        "ts0": F.lag("ts").over(order),
        "time0": F.lag("time").over(order),
        "rank": F.row_number().over(order),
        "total": F.count("*").over(Window.partitionBy("chat")),
    })
    rows = rows.withColumn("in_window", F.col("rank") > F.col("total") - WINDOW)
    turn = F.col("who0").isNull() | (F.col("who") != F.col("who0"))
    # The window's first message opens a burst of the window, wherever its burst began.
    first = F.col("rank") == F.greatest(F.col("total") - WINDOW, F.lit(0)) + 1
    pause = F.coalesce(F.col("ts") - F.col("ts0") >= SESSION_GAP_MS, F.lit(False))
    return rows.withColumns({
        "is_turn": F.col("who0").isNotNull() & turn,
        "burst": F.sum(turn.cast("int")).over(upto),
        "window_burst": F.sum((turn | first).cast("int")).over(upto),
        "session": F.sum(pause.cast("int")).over(upto),
    })


def bursts(rows: DataFrame) -> DataFrame:
    """Runs of one speaker."""
    return rows.groupBy("chat", "burst").agg(F.min_by("who", "seq").alias("who"), F.min("seq").alias("start_seq"), F.count("*").alias("messages"))


def sessions(rows: DataFrame) -> DataFrame:
    """Runs without a pause of six hours or more."""
    return rows.groupBy("chat", "session").agg(
        F.min_by("who", "seq").alias("opener"),
        F.max_by("who", "seq").alias("closer"),
        F.count("*").alias("messages"),
        F.min_by("time", "seq").alias("first_time"),
        F.min_by("date", "seq").alias("first_date"),
        F.max_by("date", "seq").alias("last_date"),
    )


def transitions(rows: DataFrame) -> DataFrame:
    """The first message after each change of speaker, with the minutes it took."""
    delta = transition_delta(F.col("ts0"), F.col("ts"), F.col("time0"), F.col("time"))
    return rows.where("is_turn").select("chat", "seq", F.col("who").alias("responder"), delta.alias("delta_min"))


def visible_times(rows: DataFrame) -> DataFrame:
    """Whether a renderer shows a message's time: the last of its burst, or the next has another time."""
    run = Window.partitionBy("chat", "burst").orderBy("seq")
    following = F.lead("time").over(run)
    return rows.select("chat", "seq", (following.isNull() | (following != F.col("time"))).alias("shown"))
