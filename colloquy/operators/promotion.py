"""Rows without text that a given table of readings turns into pictures and stickers.

A reading (chat, page slot or place, kind, emoji_desc, valence, intensity, confidence) is what some reader said about one
picture. The two lists are numbered on their own and joined by number; a reading that isn't valid
leaves its row as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of a reading: its kinds, and the code points of a description that are kept.
KINDS = ("emoticon", "photo")
DESCRIBED = 30


def is_valid(kind: str = "kind", described: str = "emoji_desc", valence: str = "valence", intensity: str = "intensity", confidence: str = "confidence") -> Column:
    """Whether a reading has a known kind, a description, and numbers in their ranges; null and NaN are in none."""
    within = lambda c, low, high: F.coalesce(~F.isnan(c) & F.col(c).between(low, high), F.lit(False))
    return F.coalesce(F.col(kind).isin(*KINDS), F.lit(False)) & F.coalesce(F.length(described) > 0, F.lit(False)) & within(valence, -1, 1) & within(intensity, 0, 1) & within(confidence, 0, 1)


def slots(readings: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chat, slot, kind, emoji_desc, valence, intensity, confidence): valid readings by the picture they are about.

    ``readings`` are (chat, place, i, ...), ``place`` counts a chat's answers from 0. A reading names its picture
    by ``i`` if there is such a picture, else its place says it; of several for one
    picture the last answer stands, and those beyond ``sizes`` (chat, n) go.
    """
    named = readings.where(is_valid()).join(sizes, "chat").withColumn("slot", F.when((F.col("i") >= 0) & (F.col("i") < F.col("n")), F.col("i")).otherwise(F.col("place")).cast("long"))
    last = F.max(F.struct("place", "kind", F.substring("emoji_desc", 1, DESCRIBED).alias("emoji_desc"), "valence", "intensity", "confidence")).alias("r")
    return named.where(F.col("slot") < F.col("n")).groupBy("chat", "slot").agg(last).select("chat", "slot", "r.kind", "r.emoji_desc", "r.valence", "r.intensity", "r.confidence")


def promote(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """``rows`` of messages in which the n-th row of type nontext of a chat has become what the reading of slot n says."""
    nontext = F.col("type") == "nontext"
    order = Window.partitionBy("chat", nontext).orderBy("seq")
    numbered = rows.withColumn("_slot", F.when(nontext, (F.row_number().over(order) - 1).cast("long")))
    sizes = rows.groupBy("chat").agg(F.count_if(nontext).alias("n"))
    found = slots(readings, sizes).select("chat", F.col("slot").alias("_slot"), F.struct("kind", "emoji_desc", "valence", "intensity", "confidence").alias("_r"))
    taken = {"type": "kind", "emoji_desc": "emoji_desc", "valence": "valence", "intensity": "intensity", "confidence": "confidence"}
    joined = numbered.join(found, ["chat", "_slot"], "left")
    return joined.withColumns({c: F.when(F.col("_r").isNotNull(), F.col(f"_r.{r}")).otherwise(F.col(c)) for c, r in taken.items()}).select(*rows.columns)
