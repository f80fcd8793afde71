"""One query per operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .exact_dedup import find_copies
from .importance import resample
from .language_id import fit_dictionaries, held_out, identify
from .line_dedup import dedup_lines
from .line_rules import apply_line_rules
from .mixing import plan_mix
from .ngram_join import similarity_join
from .pii import BASE, KINDS, find_personal_data
from .repeated_bytes import remove_repeats
from .spelling import group_spellings
from .token_store import new_folder, read_sums, write_store
from .toxicity import THRESHOLD, fit, score
from .word_bpe import encode_decode


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")
    return apply_line_rules(documents(spark, sf_dir)).select("row.doc_id", *[f"rules.{c}" for c in columns])


#: The id that ends each document.
END_ID = 2


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, path = new_folder(spark), tokenizer_path("byte_bpe_50k.json")
    write_store(documents(spark, sf_dir), folder, path, END_ID)
    return read_sums(spark, folder, path).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit_dictionaries(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return find_personal_data(documents(spark, sf_dir)).select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(line(of(*BASE)), 256).alias("base_sha256"),
        line("spans").alias("spans"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS if k not in BASE],
    )


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(documents(spark, sf_dir)).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return ranked.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(documents(spark, sf_dir)).select("word", "n", "n_near", "form", "form_n", "root")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_frequency": op1_line_frequency,
        "op2_token_store": op2_token_store,
        "op3_word_bpe": op3_word_bpe,
        "op4_ngram_join": op4_ngram_join,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_language_id": op6_language_id,
        "op7_repeated_bytes": op7_repeated_bytes,
        "op8_toxicity": op8_toxicity,
        "op9_personal_data": op9_personal_data,
        "op10_source_mix": op10_source_mix,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_line_dedup": op12_line_dedup,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_frequency": sql.LINE_FREQUENCY,
        "op5_exact_dedup": sql.EXACT_DEDUP,
        "op10_source_mix": sql.SOURCE_MIX,
        "op11_importance_resampling": sql.IMPORTANCE,
        "op12_line_dedup": sql.LINE_DEDUP,
        "op13_spelling_variants": sql.SPELLING,
    }
