"""Quality rules with cross-document line frequency, in DataFrame functions only.

Method: lines are normalised and hashed (MD5, 128 bits); for each host the
distinct documents that hold a line are counted, where texts that are equal
count as one document; lines above both limits are removed; a document that
keeps too small a share of its words is rejected, and so is one that fails the
base rules (too few words, or too many words in repeated 3-word windows).

Defined results: a null text has no lines and no words, and fails the base
rules. A null host is a host of its own. Rows that repeat host and text get
equal results. Blank lines are never removed. Texts of any length are judged whole; the lines of one
are an array in its row. An empty table gives an empty result. Rows come back whole in one column and the results in another, so that columns of
any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, small_enough, stored, whole_row

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"

#: A line goes if more documents of its host hold it than either limit says.
MAX_DOCS = 10
MAX_DOCS_PERCENT = 1
#: A document goes if less than this percentage of its words is left.
MIN_LEFT_PERCENT = 30
#: Frequent lines (16 bytes and a host each) that are sent to all executors at most.
LINES_TO_BROADCAST = 200_000
#: Frequent lines of a host that each line of a text is compared with one by one, at most.
FEW_LINES = 64


def base_measures(text: Column) -> dict[str, Column]:
    """Word and symbol counts that need no other column."""
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    }


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more among ``words``."""
    last = F.size(words) - 3
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))
    # Sorted by (hash, place), equal windows are neighbours.
    windows = F.when(last >= 0, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)))

    def covered(places: Column) -> Column:
        # A window adds three words, less those that the next repeated one covers.
        step = lambda p, j: F.least(F.coalesce(F.get(places, j + 1) - p, F.lit(3)), F.lit(3))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, b: a + b)

    def places(ordered: Column) -> Column:
        at = lambda j: F.get(ordered, j)["h"]
        return F.sort_array(F.transform(F.filter(ordered, lambda x, j: (x["h"] == at(j - 1)) | (x["h"] == at(j + 1))), lambda x: x["p"]))

    return F.coalesce(let(let(windows, places), covered), F.lit(0))


def with_words(line: Column) -> Column:
    return line.rlike(WORD)


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), f"{SPACE}+", " "))


def line_name(line: Column) -> Column:
    """The hash of a line in hexadecimal: texts are compared by hashing, bytes in arrays one by one."""
    return F.md5(normalised(line).cast("binary"))


def line_hash(line: Column) -> Column:
    return F.unhex(line_name(line))


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def base_rules(text: Column) -> dict[str, Column]:
    """The base measures of a text that isn't null."""
    lines = F.filter(F.split(text, "\n"), with_words)
    return base_measures(text) | {
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), repeated_words).cast("long"),
    }


def without_lines(text: Column, gone: Column) -> Column:
    """(n_removed_lines, n_removed_words, clean) of a text without the lines whose names are in ``gone``."""
    marked = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), (with_words(x) & F.array_contains(gone, line_name(x))).alias("gone")))

    def cut(lines: Column) -> Column:
        out = F.filter(lines, lambda x: x["gone"])
        words = F.aggregate(out, F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x["line"], F.lit(WORD)).cast("long"))
        left = F.array_join(F.transform(F.filter(lines, lambda x: ~x["gone"]), lambda x: x["line"]), "\n")
        return F.struct(F.size(out).cast("long").alias("n_removed_lines"), words.alias("n_removed_words"), left.alias("clean"))

    whole = F.struct(F.lit(0).cast("long").alias("n_removed_lines"), F.lit(0).cast("long").alias("n_removed_words"), text.alias("clean"))
    return F.when(F.size(gone) > 0, let(marked, cut)).otherwise(whole)


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, max_docs: int = MAX_DOCS, max_docs_percent: float = MAX_DOCS_PERCENT) -> DataFrame:
    """(_host, _line, n_docs) of the lines above both limits of their host."""
    keyed = held_lines(docs.select(F.col(f"`{host_col}`").alias("_host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")))
    counts = keyed.select("_host", "_doc", F.explode("_held").alias("_line")).groupBy("_host", "_line").agg(F.count_distinct("_doc").alias("n_docs"))
    hosts = keyed.groupBy("_host").agg(F.count_distinct("_doc").alias("_host_docs"))
    above = counts.where(F.col("n_docs") > max_docs).join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    return above.where(100 * F.col("n_docs") > max_docs_percent * F.col("_host_docs")).select("_host", "_line", "n_docs")


def held_lines(rows: DataFrame) -> DataFrame:
    """``rows`` (_host, _text) as _host, _doc (a text's hash) and _held (the distinct hashes of its lines)."""
    return rows.select("_host", text_hash(F.col("_text")).alias("_doc"), F.array_distinct(F.transform(F.filter(F.split("_text", "\n"), with_words), line_hash)).alias("_held"))


def with_gone(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` (_host, _text and more) with _gone: names of frequent lines that the text may hold.

    Frequent lines are sent to all executors if they are few, those of a host together; of more than
    FEW_LINES a text keeps those that it holds, found by hashing, before its lines are
    compared with them. Else each text's hits are found by joins, and joined to it by host and hash.
    """
    none = F.array().cast("array<string>")
    name = F.lower(F.hex("_line"))
    if small_enough(frequent, LINES_TO_BROADCAST):
        of_host = F.broadcast(frequent.groupBy(F.col("_host").alias("_h")).agg(F.collect_list(name).alias("_lines")))
        held = F.transform(F.filter(F.split("_text", "\n"), with_words), line_name)
        own = F.when(F.size("_lines") > FEW_LINES, F.array_intersect(held, "_lines")).otherwise(F.col("_lines"))
        return rows.join(of_host, F.col("_host").eqNullSafe(F.col("_h")), "left").withColumn("_gone", F.coalesce(own, none)).drop("_h", "_lines")
    same = lambda *pairs: reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs))
    lines = held_lines(rows).select("_host", "_doc", F.explode("_held").alias("_held")).distinct()
    hits = lines.join(frequent.withColumnRenamed("_host", "_h"), same(("_host", "_h"), ("_held", "_line")))
    hits = stored(hits.groupBy(F.col("_host").alias("_h"), F.col("_doc").alias("_d")).agg(F.collect_set(name).alias("_lines")), "line-hits")
    return rows.withColumn("_doc", text_hash(F.col("_text"))).join(hits, same(("_host", "_h"), ("_doc", "_d")), "left").withColumn("_gone", F.coalesce("_lines", none)).drop("_doc", "_h", "_d", "_lines")


def apply_line_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(row, rules): each row of ``docs`` as it is, and its measures, n_removed_lines, n_removed_words,
    clean_text (without the frequent lines; null for a null text) and kept."""
    frequent = stored(frequent_lines(docs, text_col, host_col).drop("n_docs"), "frequent-lines")
    text = F.col(f"`{text_col}`")
    rows = docs.select(whole_row(docs).alias("row"), F.col(f"`{host_col}`").alias("_host"), F.coalesce(text, F.lit("")).alias("_text"), text.isNull().alias("_null"))
    text = F.col("_text")
    # Made by a generator, the measures are computed once, wherever filters and columns that use them stand.
    found = F.struct(*[c.alias(k) for k, c in base_rules(text).items()], without_lines(text, F.col("_gone")).alias("cut"))
    m = with_gone(rows, frequent).select("row", "_null", F.inline(F.array(found)))
    m = m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    left = 100 * (F.col("n_words") - F.col("cut.n_removed_words")) >= MIN_LEFT_PERCENT * F.col("n_words")
    rules = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
    rules |= {"kept": ~F.col("base_failed") & left, "n_removed_lines": F.col("cut.n_removed_lines"), "n_removed_words": F.col("cut.n_removed_words"), "clean_text": F.when(~F.col("_null"), F.col("cut.clean"))}
    return m.select("row", F.struct(*[c.alias(k) for k, c in rules.items()]).alias("rules"))
