"""Message rows from general event, turn and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import countable_length

COLUMNS = ("chat", "seq", "who", "ts", "date", "time", "type", "text", "char_count", "emoji_desc", "valence", "intensity", "confidence")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: three users share a conversation, even event ids are mine."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    minute = F.date_trunc("minute", "ts")
    kind = F.when(F.col("event_type") == "purchase", "photo").when(F.col("event_type") == "error", "emoticon").otherwise("text")
    text = (
        F.when(F.col("event_type") == "signup", F.lit("signup now?"))
        .when(F.col("event_type") == "view", F.concat(F.lit("view "), F.repeat(F.lit("x"), k % 12)))
        .when(F.col("event_type") == "click", F.lit("ok"))
    )
    smile = F.col("event_type") == "error"
    rows = e.select(
        F.floor(F.col("user_id") / 3).cast("long").alias("chat"),
        F.col("event_id"),
        F.col("ts").alias("_ts"),
        F.when(F.col("event_id") % 2 == 0, "me").otherwise("other").alias("who"),
        F.unix_millis(minute.cast("timestamp")).alias("ts"),
        F.date_format(minute, "yyyy-MM-dd").alias("date"),
        F.date_format(minute, "HH:mm").alias("time"),
        kind.alias("type"),
        text.alias("text"),
        F.coalesce(countable_length(text), F.lit(0)).alias("char_count"),
        F.when(smile, F.concat(F.lit("e"), (k % 5).cast("string"))).alias("emoji_desc"),
        F.when(smile, (k - 50) / 50.0).alias("valence"),
        F.when(smile, F.least(F.lit(1.0), F.col("value") / 100.0)).alias("intensity"),
        F.lit(1.0).alias("confidence"),
    )
    order = Window.partitionBy("chat").orderBy("_ts", "event_id")
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).select(*COLUMNS)


def from_conversations(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    """Turns without times; system turns don't count. ``pooled`` puts all turns into one conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role <> 'system'")
    nothing = lambda kind: F.lit(None).cast(kind)
    return c.select(
        (F.lit(0) if pooled else F.col("conv_id")).cast("long").alias("chat"),
        (F.col("conv_id") * 100_000 + F.col("turn") if pooled else F.col("turn")).cast("long").alias("seq"),
        F.when(F.col("role") == "user", "me").otherwise("other").alias("who"),
        nothing("long").alias("ts"),
        nothing("string").alias("date"),
        nothing("string").alias("time"),
        F.lit("text").alias("type"),
        F.col("text"),
        countable_length(F.col("text")).alias("char_count"),
        nothing("string").alias("emoji_desc"),
        nothing("double").alias("valence"),
        nothing("double").alias("intensity"),
        F.lit(1.0).alias("confidence"),
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of many months: customers share 50 conversations, odd orders are the other's."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    rows = o.select(
        (F.col("o_custkey") % 50).cast("long").alias("chat"),
        F.col("o_orderkey"),
        day.alias("_day"),
        F.when(F.col("o_orderkey") % 2 == 0, "me").otherwise("other").alias("who"),
        F.unix_millis(day.cast("timestamp")).alias("ts"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.date_format(day, "HH:mm").alias("time"),
        F.lit("text").alias("type"),
        F.col("o_orderpriority").alias("text"),
        F.length("o_orderpriority").alias("char_count"),
        F.lit(None).cast("string").alias("emoji_desc"),
        F.lit(None).cast("double").alias("valence"),
        F.lit(None).cast("double").alias("intensity"),
        F.lit(1.0).alias("confidence"),
    )
    order = Window.partitionBy("chat").orderBy("_day", "o_orderkey")
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).select(*COLUMNS)
