"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_folder, stored  # noqa: F401  the operators take them from here

#: A word, as every operator counts it, and the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that are sent to Python at a time.
TEXT_BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let batches of texts be of at most TEXT_BATCH_BYTES, whatever the lengths of the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").strip().lower().rstrip("b")
    size = int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if not 0 < size <= TEXT_BATCH_BYTES:
        spark.conf.set(name, str(TEXT_BATCH_BYTES))


def lean(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``f`` for mapInPandas, which gives memory back when its task ends: Python workers idle on for later tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is small, else left to a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df``, whatever their names, as one."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def one_row(row: str) -> Column:
    """An aggregate: one of the rows in the column ``row``, the same one in every run; types without an order, as maps, may be in it."""
    return F.min_by(row, F.md5(F.to_json(F.struct(row)).cast("binary")))


def words_in(text: Column) -> Column:
    """Number of words in ``text``; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def with_running_totals(df: DataFrame, order: list[str], totals: dict[str, Column], label: str, shard: str = "_range") -> DataFrame:
    """Add, for each entry of ``totals``, its sum over all rows that come before in ``order``.

    Rows are dealt by range, each range is summed on its own, and the sums of
    whole ranges (one row each) give every range its base. No task sees more
    than its range, and ``shard``, if given, names a column for the range's number.
    """
    ranged = stored(
        df.withColumns({f"_{k}": c for k, c in totals.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()),
        label,
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_sum_{k}") for k in totals]).select(
        "_range", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in totals]
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = (
        ranged.join(F.broadcast(bases), "_range")  # one row a partition
        .withColumns({k: F.col(f"_base_{k}") + F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in totals})
        .drop(*[f"_{k}" for k in totals], *[f"_base_{k}" for k in totals])
    )
    return out.drop("_range") if shard == "_range" else out.withColumnRenamed("_range", shard)
