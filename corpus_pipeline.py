"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last keep the columns of
documents. The last gives doc_id, n_tokens and digests of ids and decoded text,
one row for each copy that the mix takes.

Defined results: a null text or one of few words fails the base rules, so it goes in the first stage. Of rows that repeat an
id and a text one stays in the second. A null source is a source of its own. Texts of any length are read whole. An empty
table gives an empty result, and columns of any name and type pass through to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import exact_dedup, ngram_join
from colloquy.llm.common import stored
from colloquy.llm.line_rules import apply_line_rules
from colloquy.llm.mixing import mix
from colloquy.llm.queries import documents, tokenizer_path
from colloquy.llm.word_bpe import encode_decode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that are frequent at their host."""
    kept = apply_line_rules(docs).where("rules.kept")
    changed = {"text": F.col("rules.clean_text"), "n_chars": F.char_length("rules.clean_text").cast("long")}
    return kept.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal texts."""
    return ngram_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and the text that they decode to, as digests."""
    return encode_decode(docs, tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("source mix", source_mix),
    ("word BPE", token_ids),
]

#: SQL can't express the last stage; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
