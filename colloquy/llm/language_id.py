"""Language identification by compression.

Method: a zstandard dictionary of raw content is made for each language from
labelled texts; a text is compressed in blocks with every dictionary, and the
language whose dictionary gives the fewest bytes over all blocks is chosen. Texts
and dictionaries are lower-cased words of letters only, so that case, marks and
numbers, which languages share, don't decide. A prediction whose margin over the runner-up is narrow is marked as not accepted.

Fitting reads a bounded sample: the LANGUAGES with most labels, of each at most SAMPLE
labelled texts, and of each text no more characters than a dictionary has bytes (DICTIONARY_BYTES). Prediction reads every whole text.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if no
language was learned. Equal sizes go to the language with more labels, then by code point.
Every row gives one row. An empty table gives an empty result. Columns other
than id, text and (in fitting) language are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bounds of the fitting sample: the languages with most labels, and texts of each.
LANGUAGES = 500
SAMPLE = 200
DICTIONARY_BYTES = 1 << 17
#: Bytes of text that are compressed at a time.
BLOCK = 512
LEVEL = 3
#: Share of the runner-up's size by which the best must be smaller to be accepted.
MARGIN = 0.005

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    return " ".join(WORDS.findall(text.lower())).encode()


def held_out(ident: Column) -> Column:
    """Whether a row is kept from fitting: CRC-32 of its id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw content by language, from labelled rows that are not held out.

    Rows are chosen by a hash of their id: first below a rate that leaves about
    twice SAMPLE a language, then the lowest SAMPLE of each.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("draw")
    )
    counts = stored(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES), "language-counts")
    rate = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.col("count"))
    near = rows.join(F.broadcast(counts), "lang").where(F.pmod("draw", F.lit(1 << 20)) < rate * (1 << 20))
    ordered = Window.partitionBy("lang").orderBy("draw", "text")
    sample = near.withColumn("k", F.row_number().over(ordered)).where(F.col("k") <= SAMPLE).select("lang", "k", F.substring("text", 1, DICTIONARY_BYTES).alias("text"))
    gathered: dict[str, bytes] = defaultdict(bytes)
    for row in sample.orderBy("lang", F.desc("k")).toLocalIterator():
        gathered[row["lang"]] += letters(row["text"]) + b" "
    labels = {row["lang"]: row["count"] for row in counts.collect()}
    # A match costs less the nearer it is, and the end of a dictionary is nearest.
    return {lang: gathered[lang][-DICTIONARY_BYTES:] for lang in sorted(gathered, key=lambda x: (-labels[x], x))}


def predictor(dictionaries: dict[str, bytes]) -> Callable[[str | None], tuple[str, float, bool]]:
    """Text to (language, score, accepted)."""
    compressors = []
    for lang, data in dictionaries.items():
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        compressors.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)))

    def predict(text: str | None) -> tuple[str, float, bool]:
        data = letters(text or "")
        if not data or not compressors:
            return UNKNOWN, 0.0, False
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted(((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors), key=lambda x: x[0])
        best, lang = sizes[0]
        # Each byte more is eight bits less likely.
        score = 1.0 / sum(2.0 ** -min(8 * (size - best), 1000) for size, _ in sizes)
        return lang, score, len(sizes) == 1 or sizes[1][0] - best >= MARGIN * sizes[1][0]

    return predict


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, lang_pred, score and accepted."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = predictor(dictionaries)
        for b in batches:
            found = pd.DataFrame([predict(t) for t in b["_text"]], columns=["lang_pred", "score", "accepted"])
            yield found.assign(_id=b["_id"].to_numpy())[["_id", "lang_pred", "score", "accepted"]]

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, f"_id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("_id", id_col)
