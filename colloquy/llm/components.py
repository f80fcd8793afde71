"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """From (a, b) to (v, comp): comp is the smallest vertex that v reaches.

    Labels pass along edges and then jump to the label of the label, which
    halves the distance to go. Every round is written to the shared folder. Hot
    vertices are met by map-side minima only.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        own = labels.join(near, "v").select("v", F.least("comp", "near").alias("next"), "comp")
        own = stored(own, "cc-next")
        jump = own.select(F.col("v").alias("next"), F.col("next").alias("far"))
        moved = stored(own.join(jump, "next").select("v", F.least("next", "far").alias("comp"), F.col("comp").alias("_was")), "cc-labels")
        labels = moved.drop("_was")
        if moved.where("comp <> _was").isEmpty():
            return labels
