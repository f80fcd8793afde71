"""Joins over places on a line: the last value before a point, and the free part of a band."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(points: DataFrame, values: DataFrame, by: list[str], at: str, take: list[str], including: bool = False, tie: list[str] | None = None) -> DataFrame:
    """``points`` with the columns ``take`` of the last row of ``values`` whose ``at`` is smaller, null if there is none.

    ``including`` counts values at the very place of the point. Of values at one place the
    last in the order of ``tie`` stands. One union and one window over ``by``; a value's nulls are
    carried as they are, they don't let an older value through.
    """
    kind, other = (0, 1) if including else (1, 0)
    tie = tie or []
    own = points.select(*by, F.col(at).alias("_at"), F.lit(other).alias("_kind"), F.struct(*points.columns).alias("_row"))
    found = values.select(*by, F.col(at).alias("_at"), F.lit(kind).alias("_kind"), F.struct(*take).alias("_value"), *[F.col(c).alias(f"_tie_{c}") for c in tie])
    order = Window.partitionBy(*by).orderBy("_at", "_kind", *[F.col(f"_tie_{c}") for c in tie]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(found, allowMissingColumns=True).withColumn("_last", F.last("_value", ignorenulls=True).over(order))
    return both.where(F.col("_row").isNotNull()).select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in take])


def free_bands(bands: DataFrame, blockers: DataFrame, by: list[str], band: str = "band", pad: float = 0.0) -> DataFrame:
    """``bands`` (by, band, lo, hi) with free_lo and free_hi: the largest part of each that no blocker (by, lo, hi) covers.

    Blockers that overlap a band count with ``pad`` on either side. The first of equally large parts
    stands; both are null if nothing is free. A sweep: in the order of their starts, what is free
    before a blocker begins at the largest end so far.
    """
    key = [*by, band]
    own = blockers.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    same = reduce(and_, [F.col(c) == F.col(f"_{c}") for c in by])
    met = bands.select(*key, "lo", "hi").join(own, same & (F.col("_hi") > F.col("lo")) & (F.col("_lo") < F.col("hi"))).select(*key, "lo", "hi", (F.col("_lo") - pad).alias("a"), (F.col("_hi") + pad).alias("b"))
    # The end of the band closes the sweep, as a blocker that starts there.
    swept = met.union(bands.select(*key, "lo", "hi", F.col("hi").alias("a"), F.col("hi").alias("b")))
    before = Window.partitionBy(*key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.col("lo"), F.coalesce(F.max("b").over(before), F.col("lo")))
    parts = swept.withColumn("_from", start).withColumn("_to", F.least("a", "hi")).where(F.col("_to") > F.col("_from"))
    best = parts.groupBy(*key).agg(F.min(F.struct((F.col("_from") - F.col("_to")).alias("size"), F.col("_from").alias("lo"), F.col("_to").alias("hi"))).alias("_best"))
    return bands.join(best, key, "left").withColumns({"free_lo": F.col("_best.lo"), "free_hi": F.col("_best.hi")}).drop("_best")


def upper_median(value: Column) -> Column:
    """An aggregate: the middle of the values that aren't null, the upper one of two; null without values."""
    values = F.collect_list(value)
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def with_upper_median(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the ``upper_median`` of their group, by windows, so that they are read once and no group is an array."""
    group = Window.partitionBy(*by)
    placed = rows.withColumn("_value", value).withColumns({"_place": F.row_number().over(group.orderBy(F.col("_value").asc_nulls_last())) - 1, "_values": F.count("_value").over(group)})
    middle = F.when(F.col("_place") == F.floor(F.col("_values") / 2), F.col("_value"))
    return placed.withColumn(name, F.max(middle).over(group)).drop("_value", "_place", "_values")
