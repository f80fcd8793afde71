"""Mixing sources to target weights.

Method: sizes are summed per source; each source's target and repetition rate
follow from its weight; every document is then emitted floor(rate) times plus
one more time if a hash of its id falls below the fraction of the rate.

Defined results: a null text has size 0. Sources rank by code point, null last,
and take the weights in turn. A source without words has target 0 and rate 0.
Rows that repeat an id draw alike. An empty table gives an empty result. Long
texts are counted whole. Only the id, the text and the source decide; rows come back whole, so that columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored, whole_row, with_running_totals, words_in

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = "mix"
#: One row a source; beyond this many the rates are joined by a shuffle.
SOURCES_TO_BROADCAST = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """From (source, source_size): weight and target of every source.

    Targets share the sum of all sizes by weight, and none exceeds ``max_rate``
    times its source's size. Sharing the excess again and again ends where
    target = level * weight for all sources below their limit; in the order of
    limit / weight, the sources before that point are those at their limit.
    """
    ranked = with_running_totals(
        sizes.withColumns({"_null": F.col("source").isNull(), "_key": F.coalesce("source", F.lit(""))}), ["_null", "_key"], {"_rank": F.lit(1)}, "mix-rank"
    ).drop("_null", "_key")
    turn = F.col("_rank") % len(weights)
    weight = F.lit(weights[-1])
    for i in range(len(weights) - 1):
        weight = F.when(turn == i, F.lit(weights[i])).otherwise(weight)
    limited = ranked.withColumn("weight", weight.cast("long")).withColumns({"_limit": F.col("source_size") * max_rate}).withColumn("_ratio", F.col("_limit") / F.col("weight"))
    running = with_running_totals(limited, ["_ratio", "_rank"], {"_limits_before": F.col("_limit"), "_weights_before": F.col("weight")}, "mix-fill")
    whole = limited.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    filled = running.crossJoin(F.broadcast(whole)).withColumn(
        "_open", (F.col("_all") - F.col("_limits_before")) * F.col("weight") <= F.col("_limit") * (F.col("_weights") - F.col("_weights_before"))
    )
    filled = stored(filled, "mix-filled")
    # The first source that stays below its limit sets the level for all after it.
    level = filled.where("_open").agg(F.min(F.struct("_ratio", "_rank", "_limits_before", "_weights_before")).alias("_first"))
    return filled.crossJoin(F.broadcast(level)).select(
        "source",
        "source_size",
        "weight",
        F.when(
            F.struct("_ratio", "_rank") >= F.struct("_first._ratio", "_first._rank"),
            (F.col("_all") - F.col("_first._limits_before")) * F.col("weight") / (F.col("_weights") - F.col("_first._weights_before")),
        )
        .otherwise(F.col("_limit").cast("double"))
        .alias("target"),
    )


def draw(ident: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of MD5 of the seed and the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, rate, copies): each row of ``docs`` as it is, and how often the mix takes it."""
    col = lambda c: F.col(f"`{c}`")
    sized = docs.select(whole_row(docs).alias("row"), words_in(col(text_col)).alias("size"), col(source_col).alias("source"), col(id_col).alias("id"))
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    targets = source_targets(sizes).select(F.col("source").alias("of"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = sized.join(maybe_broadcast(targets, SOURCES_TO_BROADCAST), F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    copies = F.floor("rate") + (draw(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return planned.select("row", "size", "source_size", "target", "rate", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as its rate says."""
    planned = plan_mix(docs, id_col, text_col, source_col, seed).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
