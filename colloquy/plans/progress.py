"""What a run has done so far: rows of each stage of a plan, and of each batch of a stream."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from ..storage import stored

STAGE_SCHEMA = "place int, stage string, rows long"
BATCH_SCHEMA = "query string, batch long, rows long, millis long"
#: Batches that a listener remembers.
REMEMBERED = 10_000


class Stages:
    """Counts rows while the stages of a plan are stored: no stage runs twice to be counted."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, Observation]] = []

    def done(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` stored; its rows are counted as they are written."""
        watch = Observation(f"{name}-{len(self.seen)}")
        out = stored(df.observe(watch, F.count(F.lit(1)).alias("rows")), f"stage-{name}")
        self.seen.append((name, watch))
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """(place, stage, rows) of the stages that are done, in their order."""
        return spark.createDataFrame([(i, name, watch.get["rows"]) for i, (name, watch) in enumerate(self.seen)], STAGE_SCHEMA)


class Batches(StreamingQueryListener):
    """Remembers the progress of the session's streams; add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.seen: deque[tuple[str, int, int, int]] = deque(maxlen=REMEMBERED)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.seen.append((p.name or str(p.id), p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def rows(self, spark: SparkSession) -> DataFrame:
        """(query, batch, rows, millis) of the batches seen."""
        return spark.createDataFrame(list(self.seen), BATCH_SCHEMA)
