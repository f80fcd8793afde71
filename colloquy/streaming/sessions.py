"""Sessions of a message stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder

#: session_window joins a pause of exactly its gap, and a pause of six hours ends a session.
GAP = "5 hours 59 minutes 59.999999 seconds"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files as a stream of (chat, at)."""
    path = f"{sf_dir}/events.parquet"
    # As a pattern the path may be one file or a folder of them.
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet")
    return e.select(F.floor(F.col("user_id") / 3).cast("long").alias("chat"), F.date_trunc("minute", "ts").cast("timestamp").alias("at"))


def session_counts(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Messages of each session.

    A session is given out, and leaves the state, once the watermark has passed it; those still open are not given.
    Messages that come later than the watermark are dropped.
    """
    by_session = stream.withWatermark("at", lateness).groupBy("chat", F.session_window("at", GAP).alias("w"))
    return by_session.agg(F.count("*").alias("messages"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).drop("w")


def run_once(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over all that is there and return what it gave, kept in the shared folder.

    A batch that is run again replaces what it wrote before.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
