"""Exact deduplication: group by a 128-bit content hash, then compare bytes.

Method: every row is hashed; rows are grouped by hash without their texts; the
texts of groups with more than one row are then compared byte by byte with
the text of the row that stays, so a hash collision cannot merge two texts.

Defined results: a null text counts as empty, and all empty texts are one
group. Lower-casing touches A-Z only. A null id sorts before every other id. Of
rows that repeat both id and text one is kept. An empty table gives an empty
result. Texts of any length are hashed and compared whole.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, maybe_broadcast, one_row, stored, whole_row

#: Hashes of groups are sent to all executors (24 bytes each) up to this many;
#: beyond it the texts are joined with them by a shuffle.
GROUPS_TO_BROADCAST = 500_000


def content_hash(data: bytes) -> bytes:
    """128 bits of BLAKE2b."""
    return hashlib.blake2b(data, digest_size=16).digest()


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; bytes.lower() leaves all others alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hasher: Callable[[bytes], bytes] = content_hash) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep`` says which id of a group of equal texts stays, "min" or "max".
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [normalise(x) for x in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"], "_hash": [hasher(x) for x in data], "text_sha256": [hashlib.sha256(x).hexdigest() for x in data]})

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [normalise(x) for x in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"], "_hash": [hasher(x) for x in data], "_bytes": data, "text_sha256": [hashlib.sha256(x).hexdigest() for x in data]})

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    hashed = rows.mapInPandas(lean(digests), f"_id {kind}, _hash binary, text_sha256 string")
    best = F.max if keep == "max" else F.min

    # Rows that agree in id and text are counted as one line from here on.
    lines = stored(hashed.groupBy("_id", "_hash", "text_sha256").agg(F.count("*").alias("_n")), "exact-lines")
    groups = stored(lines.groupBy("_hash").agg(best("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_lines")), "exact-groups")

    # Bytes are compared wherever a hash has more than one line: each text with
    # one text of its group.
    many = maybe_broadcast(groups.where("_lines > 1").select("_hash", "keep_id"), GROUPS_TO_BROADCAST)
    full = rows.mapInPandas(lean(texts), f"_id {kind}, _hash binary, _bytes binary, text_sha256 string")
    chosen = full.join(many, "_hash").where(F.col("_id").eqNullSafe(F.col("keep_id"))).groupBy("_hash").agg(F.min("_bytes").alias("_kept_bytes"))
    compared = full.join(many.select("_hash"), "_hash", "left_semi").join(stored(chosen, "exact-chosen"), "_hash")
    # Stored before they are grouped, so that the join may split the rows of one hash.
    differing = stored(compared.where(F.col("_bytes") != F.col("_kept_bytes")).drop("_kept_bytes", "keep_id"), "exact-differing")
    odd = stored(
        differing.groupBy("_hash", "_bytes").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("text_sha256").alias("text_sha256")).drop("_bytes"),
        "exact-collisions",
    )

    # Collisions are regrouped by their bytes; their group leaves the rest of its hash behind.
    lost = odd.groupBy("_hash").agg(F.sum("group_size").alias("_lost"))
    wholes = groups.join(lost, "_hash", "left").select("_hash", "keep_id", (F.col("group_size") - F.coalesce("_lost", F.lit(0))).alias("group_size"))
    apart = lines.join(odd.select("_hash", "text_sha256", F.col("keep_id").alias("_odd_keep"), F.col("group_size").alias("_odd_size")), ["_hash", "text_sha256"], "left")
    found = apart.join(wholes, "_hash").select(
        "_id",
        F.when(F.col("_odd_size").isNull(), F.col("keep_id")).otherwise(F.col("_odd_keep")).alias("keep_id"),
        F.coalesce("_odd_size", "group_size").alias("group_size"),
        "text_sha256",
        "_n",
    )
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows that repeat an id and a text one of them."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(normalise(x)).hexdigest() for x in texts])

    copies = stored(find_copies(docs, id_col, text_col, keep).select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "exact-copies")
    rows = docs.select(whole_row(docs).alias("_row"), F.col(id_col).alias("_own"), digest(text_col).alias("_digest"))
    found = rows.join(copies.where("kept").drop("kept"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), "left_semi")
    if copies.groupBy("_id", "_sha").count().where("count > 1").isEmpty():
        return found.select("_row.*")  # no id is repeated with its text, so every row found stays
    return found.groupBy("_own", "_digest").agg(one_row("_row").alias("_row")).select("_row.*")
