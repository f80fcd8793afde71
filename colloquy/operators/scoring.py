"""How well recognised screens give back what was said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact(text: Column) -> Column:
    """A text without white space: recognition doesn't keep it."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")


def matched(found: DataFrame, truth: DataFrame) -> DataFrame:
    """True texts of (page, seq, who, time, type, text) with hit, and the side and time of the first found text that equals theirs.

    ``paired`` is stricter: the n-th true text of a kind needs an n-th found one.
    """
    texts = lambda df: df.where("type = 'text'").withColumn("_key", compact(F.col("text")))
    first = texts(found).groupBy("page", "_key").agg(F.count("*").alias("_times"), F.min(F.struct("seq", "who", "time")).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("page", "_key").orderBy("seq"))
    asked = texts(truth).withColumn("_nth", nth).join(first, ["page", "_key"], "left")
    return asked.select("page", "seq", "who", "time", "text", F.col("_first").isNotNull().alias("hit"), F.col("_first.who").alias("found_who"), F.col("_first.time").alias("found_time"), F.coalesce(F.col("_nth") <= F.col("_times"), F.lit(False)).alias("paired"))


def scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a page of ``truth``: texts and how many are hit, paired, on the right side, and at the right time of those with a time;
    things without text that were found and that there are."""
    m = matched(found, truth)
    rated = m.groupBy("page").agg(
        F.count("*").alias("texts"),
        F.count_if("hit").alias("text_hits"),
        F.count_if("paired").alias("paired"),
        F.count_if(F.col("found_who") == F.col("who")).alias("side_hits"),
        F.count("time").alias("timed"),
        F.count_if(F.col("found_time") == F.col("time")).alias("time_hits"),
    )
    pictures = truth.groupBy("page").agg(F.count_if(F.col("type") != "text").alias("pictures"))
    holes = found.groupBy("page").agg(F.count_if(F.col("type") == "nontext").alias("holes"))
    whole = pictures.join(rated, "page", "left").join(holes, "page", "left")
    return whole.select("page", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("texts", "text_hits", "paired", "side_hits", "timed", "time_hits", "pictures", "holes")])


def spread(values: DataFrame, *columns: str) -> DataFrame:
    """One row: how far the largest and the smallest value of each column are apart over all chats, and how many there are."""
    return values.agg(F.count("*").alias("chats"), *[(F.max(c) - F.min(c)).alias(f"{c}_spread") for c in columns])
