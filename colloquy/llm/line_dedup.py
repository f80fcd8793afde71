"""Line deduplication across documents, in DataFrame functions only.

Method: the normalised lines of every document are exploded with their positions
and hashed (MD5, 128 bits); the distinct documents that hold a hash are counted;
lines that too many documents hold are dropped everywhere but in the document of
the largest id that holds them; texts are put together again by position.

Defined results: rows with the same id are one document, and a null id is an id of
its own, smaller than all others. A null or empty text is one empty line, and what
is kept of it is empty. Rows that repeat id and text get equal results. Lines of a
document that stays its line's holder all stay, repeated ones too. A text of any
length is handled whole, its lines are one array in one row. An empty table gives
an empty result. Rows come back whole in one column and the results in others, so
that columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, stored, whole_row

#: Code points of the shortest key that can be dropped, and the documents that hold it at least.
MIN_CHARS = 40
MIN_DOCS = 5
#: White space that is stripped at both ends of a line.
ENDS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of lines to drop (24 bytes each) that are sent to all executors at most.
KEYS_TO_BROADCAST = 500_000


def line_keys(text: Column, min_chars: int) -> Column:
    """(pos, key) of the lines of ``text`` whose normalised form is long enough; key is its hash."""
    keys = F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), lambda line: F.btrim(line, F.lit(ENDS)))
    hashed = F.transform(keys, lambda k, i: F.struct(i.alias("pos"), F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(k.cast("binary")))).alias("key")))
    return F.filter(hashed, lambda x: x["key"].isNotNull())


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """From (_id, key): key and _holder, the largest id that holds it, of keys in at least ``min_docs`` documents."""
    # Distinct pairs first, so that a line of very many documents is counted where its pairs are.
    pairs = lines.select("key", "_id").distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("_docs"), F.max("_id").alias("_holder")).where(F.col("_docs") >= min_docs).drop("_docs")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): each row of ``docs`` as it is, and its text without the dropped lines."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(whole_row(docs).alias("row"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    lines = rows.select("_id", "_text", F.explode(line_keys(F.col("_text"), min_chars)).alias("_line")).select("_id", "_text", "_line.pos", "_line.key")
    gone = stored(repeated_lines(lines.select("_id", "key"), min_docs), "dedup-keys")
    small = small_enough(gone, KEYS_TO_BROADCAST)

    # Texts are told apart by id and hash, so that rows which repeat an id drop lines of their own.
    of_text = lines.select("_id", F.unhex(F.md5(F.col("_text").cast("binary"))).alias("_sum"), "pos", "key")
    hits = of_text.join(F.broadcast(gone) if small else gone, "key").where(~F.col("_id").eqNullSafe(F.col("_holder"))).select("_id", "_sum", "pos")
    # Stored before it is grouped, so that the join may split the rows of one line.
    hits = hits if small else stored(hits, "dedup-hits")
    drops = stored(hits.groupBy(F.col("_id").alias("_of"), F.col("_sum").alias("_of_sum")).agg(F.collect_set("pos").alias("_gone")), "dedup-drops")

    keyed = rows.withColumn("_sum", F.unhex(F.md5(F.col("_text").cast("binary"))))
    found = keyed.join(drops, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_sum") == F.col("_of_sum")), "left")
    n_lines = F.regexp_count("_text", F.lit("\n")).cast("long") + 1

    def without(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    # The split lines are a lambda's variable, so that they are made once a row.
    left = F.get(F.transform(F.array(F.split("_text", "\n")), without), F.lit(0))
    return found.select(
        "row",
        n_lines.alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left).alias("kept_text"),
    )
