"""One way in for text exports and tables: what a file is, is told by how it begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exports, tables

#: How the first line of a table may begin, and what the head of a text export says.
TABLE_HEAD = r'(?i)\A\s*(date|"date"|날짜)\s*,'
EXPORT_HEAD = "님과 카카오톡 대화"
HEAD_LINES = 3


def looks_like_csv(name: Column, head: Column) -> Column:
    """Whether a file is a table: by its first column's name, its own name, or two commas in its head and no title of an export."""
    plain = F.regexp_replace(head, "\\A\ufeff", "")
    commas = F.regexp_count(plain, F.lit(",")) >= 2
    return plain.rlike(TABLE_HEAD) | name.rlike(r"(?i)\.csv\z") | (commas & ~F.contains(plain, F.lit(EXPORT_HEAD)))


def kinds_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, chat, kind): csv or text, from the first lines of every file of a folder; an empty file has no row."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    # The first stretch of a file holds its head, in rows that are numbered one after the other.
    begin = lines.where("block = 0")
    start = begin.groupBy("file").agg(F.min("n").alias("start"))
    near = begin.join(start, "file").where(F.col("n") < F.col("start") + HEAD_LINES)
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n")
    kind = F.when(looks_like_csv(F.col("file"), F.col("head")), "csv").otherwise("text")
    return near.groupBy("file").agg(head.alias("head")).select("file", F.xxhash64("file").alias("chat"), kind.alias("kind"))


def read_chats(spark: SparkSession, path: str, chosen: DataFrame | None = None) -> DataFrame:
    """Message rows of all exports and tables of a folder; a chat's key is the hash of its file's name.

    ``chosen`` (chat, name) says who is me where no title does; chats that nothing settles have no rows.
    """
    kinds = kinds_of_files(spark, path)
    table = tables.csv_rows(spark, path).withColumn("chat", F.xxhash64("chat")).join(kinds.where("kind = 'csv'"), "chat", "left_semi")
    text = exports.read_exports(spark, path).join(kinds.where("kind = 'text'"), "chat", "left_semi")
    found = exports.messages_of(text, chosen)
    return found if chosen is None else found.unionByName(tables.csv_message_rows(table, chosen))
