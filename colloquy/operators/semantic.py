"""Measures over embedding vectors: how replies match, and how far apart styles are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.text import is_embed_skip

#: Fixed seeds of the shuffled baseline, and the number of shuffles.
SEEDS = {"me": 0x9E37, "other": 0x85EB}
SHUFFLES = 20


def texts_to_embed(rows: DataFrame) -> DataFrame:
    """The distinct texts of all messages that say enough to be embedded, each once: what a model is given."""
    said = (F.col("type") == "text") & F.col("text").isNotNull() & ~is_embed_skip(F.col("text"))
    return rows.where(said).select("text").distinct()


def with_vectors(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(chat, seq, who, v) of the messages whose text has a vector in ``known`` (text, v), one row a text; texts that say too little have none."""
    said = rows.where((F.col("type") == "text") & ~is_embed_skip(F.col("text"))).select("chat", "seq", "who", "text")
    return said.join(known.select("text", "v"), "text").select("chat", "seq", "who", "v")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays as it is."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size == 0, x).otherwise(x / size))


def reply_pairs(vectors: DataFrame) -> DataFrame:
    """(chat, seq, responder, a, b): unit vectors on both sides of each change of speaker."""
    order = Window.partitionBy("chat").orderBy("seq")
    rows = vectors.withColumns({"who0": F.lag("who").over(order), "a": F.lag("v").over(order)})
    return rows.where("who0 <> who").select("chat", "seq", F.col("who").alias("responder"), unit(F.col("a")).alias("a"), unit(F.col("v")).alias("b"))


def sync_exact(pairs: DataFrame) -> DataFrame:
    """Mean similarity of replies less its mean over all other pairings, from sums of each dimension."""
    long = pairs.select("chat", "responder", "seq", F.posexplode(F.arrays_zip("a", "b")).alias("i", "x"))
    by_dim = long.groupBy("chat", "responder", "i").agg(F.sum("x.a").alias("sa"), F.sum("x.b").alias("sb"), F.sum(F.col("x.a") * F.col("x.b")).alias("own"), F.count("*").alias("n"))
    sums = by_dim.groupBy("chat", "responder").agg(F.sum("own").alias("own"), F.sum(F.col("sa") * F.col("sb")).alias("all"), F.max("n").alias("n"))
    raw = F.col("own") / F.col("n")
    base = F.when(F.col("n") < 2, 0.0).otherwise((F.col("all") - F.col("own")) / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1)))
    return sums.select("chat", "responder", F.col("n").alias("pairs"), half_up(raw, 3).alias("raw"), half_up(base, 3).alias("base"), half_up(raw - base, 3).alias("net"))


def mulberry(seed: int) -> Iterator[float]:
    """The 32-bit generator that the seeded baseline is defined with."""
    mask, a = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ (a >> 15)) * (1 | a)) & mask
        t = ((t + (((t ^ (t >> 7)) * (61 | t)) & mask)) & mask) ^ t
        yield ((t ^ (t >> 14)) & mask) / 4294967296


def sync_seeded(pairs: DataFrame) -> DataFrame:
    """As sync_exact, but the baseline is the mean over SHUFFLES seeded pairings."""

    def baseline(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        a, b = (np.array(group[c].tolist(), float).reshape(len(group), -1) for c in ("a", "b"))
        raw, rounds = float((a * b).sum(axis=1).mean()), []
        draw = mulberry(SEEDS[group["responder"].iloc[0]])
        for _ in range(SHUFFLES if len(group) > 1 else 0):
            at = list(range(len(group)))
            for i in range(len(at) - 1, 0, -1):
                j = int(next(draw) * (i + 1))
                at[i], at[j] = at[j], at[i]
            moved = [i for i, j in enumerate(at) if i != j]
            if moved:
                rounds.append(float((a[moved] * b[[at[i] for i in moved]]).sum(axis=1).mean()))
        base = float(np.mean(rounds)) if rounds else 0.0
        three = lambda x: float(np.floor(x * 1000 + 0.5) / 1000)
        return pd.DataFrame([(group["chat"].iloc[0], group["responder"].iloc[0], len(group), three(raw), three(base), three(raw - base))], columns=["chat", "responder", "pairs", "raw", "base", "net"])

    return pairs.groupBy("chat", "responder").applyInPandas(baseline, "chat long, responder string, pairs long, raw double, base double, net double")


def style_separation(vectors: DataFrame) -> DataFrame:
    """Distance of the sides' centroids over their mean spread, as 0 to 100.

    All of it follows from sums and squares of each dimension.
    """
    long = vectors.select("chat", "who", F.posexplode("v").alias("i", "x"))
    dims = long.groupBy("chat", "i").agg(*[f(F.when(F.col("who") == w, c)).alias(f"{n}_{w}") for w in SEEDS for f, c, n in ((F.avg, F.col("x"), "m"), (F.avg, F.col("x") * F.col("x"), "q"))])
    gap = F.sqrt(F.sum((F.col("m_me") - F.col("m_other")) ** 2))
    spread = lambda w: F.sqrt(F.greatest(F.sum(F.col(f"q_{w}") - F.col(f"m_{w}") ** 2), F.lit(0.0)))
    sums = dims.groupBy("chat").agg(gap.alias("between"), ((spread("me") + spread("other")) / 2).alias("within"))
    counts = vectors.groupBy("chat").agg(*[F.count_if(F.col("who") == w).alias(f"vectors_{w}") for w in SEEDS])
    none = (F.col("vectors_me") == 0) | (F.col("vectors_other") == 0) | (F.col("within") == 0)
    both = counts.join(sums, "chat").withColumn("ratio", F.when(none, 0.0).otherwise(F.try_divide("between", "within")))
    return both.select("chat", half_up(100 * F.tanh("ratio")).cast("long").alias("score"), half_up(F.col("ratio"), 3).alias("ratio"), "vectors_me", "vectors_other")
