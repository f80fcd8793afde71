"""Phrases that one side uses more than the other: n-grams and log odds with a prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.text import BLANK
from ..storage import stored

#: Fixed list of endings and particles that say nothing about a side.
STOPWORDS = (
    "는데", "니까", "습니", "어서", "으로", "에서", "하고", "지만", "면서", "든지",
    "이나", "라고", "다고", "까지", "부터", "보다", "처럼", "만큼", "에게", "한테",
    "이랑", "그리", "그래", "그러", "이런", "저런", "그런", "아서", "어요", "아요",
    "네요", "어야", "아야", "려고", "거든", "잖아", "더라", "으면", "이면", "해서",
)
SIZES = (2, 3, 4)
PRIOR, LEAST_TOTAL, SUBSET, TOP = 0.01, 10, 0.8, 8


def runs(messages: DataFrame) -> DataFrame:
    """Text messages with ``runs``: what stands between white space and end marks."""
    texts = messages.where((F.col("type") == "text") & F.col("text").isNotNull())
    return texts.select("chat", "who", "seq", F.split("text", f"[{BLANK}.,!?~]+").alias("runs"))


def ngrams(messages: DataFrame) -> DataFrame:
    """(chat, who, seq, n, run, i, gram): n-grams of code points without white space or end marks."""

    def of(run: Column, at: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.struct(F.lit(n).alias("n"), at.alias("run"), i.alias("i"), F.substring(run, i, F.lit(n)).alias("gram")))
        return F.when(F.length(run) >= n, cut).otherwise(F.array().cast("array<struct<n:int,run:int,i:int,gram:string>>"))

    listed = F.flatten(F.transform("runs", lambda run, at: F.flatten(F.array(*[of(run, at, n) for n in SIZES]))))
    return runs(messages).select("chat", "who", "seq", F.inline(listed))


def gram_totals(messages: DataFrame) -> DataFrame:
    """How many n-grams each side has, from the lengths of the runs alone."""
    own = F.aggregate("runs", F.lit(0), lambda s, run: s + sum((F.greatest(F.length(run) - n + 1, F.lit(0)) for n in SIZES), F.lit(0)))
    mine = F.col("who") == "me"
    return runs(messages).groupBy("chat").agg(*[F.coalesce(F.sum(F.when(who, own)), F.lit(0)).alias(c) for c, who in (("na", mine), ("nb", ~mine))])


def ngram_counts(grams: DataFrame) -> DataFrame:
    """Counts by side, with the place of a gram's first use by me."""
    mine = F.col("who") == "me"
    return grams.groupBy("chat", "gram").agg(F.count_if(mine).alias("fa"), F.count_if(~mine).alias("fb"), F.min(F.when(mine, F.struct("seq", "n", "run", "i"))).alias("first"))


def candidates(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("fa") + F.col("fb") >= LEAST_TOTAL) & (F.col("fa") >= 1) & (F.col("fb") >= 1) & ~F.col("gram").isin(*STOPWORDS))


def drop_subsets(keys: DataFrame) -> DataFrame:
    """Without grams that a longer kept gram explains; sub-grams of the longer make the join an equi-join."""

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length("gram") - n + 1), lambda i: F.substring(F.col("gram"), i, F.lit(n)))
        return F.when(F.length("gram") > n, cut).otherwise(F.array().cast("array<string>"))

    parts = F.flatten(F.array(*[of(n) for n in SIZES[:-1]]))
    inside = keys.select("chat", (F.col("fa") + F.col("fb")).alias("_long"), F.explode(F.array_distinct(parts)).alias("gram"))
    gone = inside.join(keys.select("chat", "gram", (F.col("fa") + F.col("fb")).alias("_short")), ["chat", "gram"]).where(F.col("_long") >= SUBSET * F.col("_short"))
    return keys.join(gone.select("chat", "gram").distinct(), ["chat", "gram"], "left_anti")


def phrase_gap(messages: DataFrame, top: int = TOP) -> DataFrame:
    """The top phrases of each side by log odds; ties go to the phrase used first."""
    keys = stored(candidates(ngram_counts(ngrams(messages))), "phrase-keys")
    kept, totals = drop_subsets(keys), gram_totals(messages)
    kinds = kept.groupBy("chat").agg(F.count("*").alias("v"))
    odds = lambda f, n: F.ln((F.col(f) + PRIOR) / (F.col(n) + PRIOR * F.col("v") - F.col(f) - PRIOR))
    scored = kept.join(totals, "chat").join(kinds, "chat").withColumn("z", half_up((odds("fa", "na") - odds("fb", "nb")) * 1000) / 1000).where("z <> 0")
    side = F.when(F.col("z") > 0, "me").otherwise("other")
    order = Window.partitionBy("chat", "side").orderBy(F.desc(F.abs("z")), "first")
    return scored.withColumn("side", side).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("chat", "side", "place", "gram", "z", F.col("fa").alias("me"), F.col("fb").alias("other"))
