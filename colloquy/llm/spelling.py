"""Grouping of spelling variants by full neighbourhood generation.

Method: distinct words are counted; for each word of the vocabulary all distinct
deletions, replacements and insertions of one code point over the observed alphabet are
generated; candidates are hash-joined to the vocabulary, and what joins is near by
construction, so no distance is computed. A word's form is its near word of largest
count if that is large enough, and forms are followed to their roots by pointer doubling.

There are about 2 x alphabet x length candidates a word, nearly all of which are no word. Their
64-bit hashes follow from hashes of the word's beginnings and ends, all at once, and
a bit filter of the vocabulary's hashes (no word is ever missed) holds back
those that can't join, before strings are made and shuffled. The filter is built by Spark
in segments and is of bounded size: a vocabulary beyond it is filtered in slices, each
with a pass of its own.

Defined results: a null or empty text has no words. A null id writes as ``null``. Rows that
repeat an id or a text are counted each. Long texts are read whole. Of equal counts the
word that is smaller in code-point order is the form. An empty table gives an empty
result. Only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, maybe_broadcast, small_enough, stored

MIN_CHARS = 5
MIN_COUNT = 3
FORM_RATIO = 2
#: Every word of a document whose hash this divides loses a code point.
DAMAGE = 97
#: In Latin-1: A-Z to a-z; letters and C0 to FF stay; all else parts words.
RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Filter: bits a word at least, and bits in all at most (64 MB; no less than 15), as powers of 2.
WORD_BITS = 6
MOST_BITS = 29
#: Candidates whose hashes are computed at a time, and words of a task.
CELLS = 1 << 16
TASK_WORDS = 10_000
#: Words and their counts or forms that are sent to all executors at most.
WORDS_TO_BROADCAST = 100_000

#: Hash of a word: sum of VALUE[code point] * BASE ** (code points after it), modulo 2 ** 64.
VALUE = np.random.default_rng(2024).integers(1 << 60, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors that make a hash's bits of the filter, and its slice.
PROBES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
SLICE = np.uint64(0xE7037ED1A0B428DB)
#: Words beyond this length look first whether the vocabulary has any word of the lengths next to theirs,
#: if it has no more different lengths than this (16 bytes each).
LONG = 64
LENGTHS_TO_SEND = 100_000
#: Code points of candidates that are made into strings at a time.
HANDED = 4 << 20


def count_into(total: dict[bytes, int], ident: int | None, text: str | None, min_chars: int) -> None:
    """Add the words of one document, after the damage that its id decides, to ``total``."""
    prefix = zlib.crc32(f"{'null' if ident is None else int(ident)}:".encode())
    for w, n in Counter((text or "").encode("latin-1", "replace").translate(RUNS).split()).items():
        if len(w) >= min_chars:
            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), prefix)
            if not h % DAMAGE:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
                if len(w) < min_chars:
                    continue
            total[w] = total.get(w, 0) + n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bytes, int] = {}
        handed = lambda: pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())})
        for b in batches:
            for ident, text in zip(b["id"], b["_text"], strict=True):
                count_into(total, None if pd.isna(ident) else ident, text, min_chars)
                if len(total) > COUNTED:
                    yield handed()
                    total.clear()
        if total:
            yield handed()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("_text"))
    found = rows.mapInPandas(lean(counted), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)


def ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length, as rows of Latin-1 codes: hashes of their first i and of their last L - i code points."""
    n, length = codes.shape
    values, power = VALUE[codes], powers(length)
    first, rest = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64)
    for i in range(length):
        first[:, i + 1] = first[:, i] * BASE + values[:, i]
    for i in range(length - 1, -1, -1):
        rest[:, i] = values[:, i] * power[length - 1 - i] + rest[:, i + 1]
    return first, rest


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes and codes of the words of each length, few enough at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        all_of = np.flatnonzero(lengths == length)
        for at in np.array_split(all_of, max(1, len(all_of) * int(length) // 4096)):
            yield at, np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(len(at), length)


class Filter:
    """Four bits for each word of the vocabulary; a word that lacks one of them is not in it."""

    def __init__(self, bits: int, slices: int):
        self.bits, self.slices = bits, slices

    @staticmethod
    def of_size(words: int) -> Filter:
        wanted = max(15, (words << WORD_BITS).bit_length())
        return Filter(min(wanted, MOST_BITS), max(0, wanted - MOST_BITS))

    def place(self, hashed: np.ndarray, probe: np.uint64) -> np.ndarray:
        return ((hashed ^ (hashed >> np.uint64(32))) * probe) >> np.uint64(64 - self.bits)

    def slice_of(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed * SLICE) >> np.uint64(64 - self.slices) if self.slices else np.zeros(hashed.shape, np.uint64)

    def built(self, words: DataFrame) -> DataFrame:
        """Segments (slice, segment, bits) of 32 768 bits each, by Spark's bitmap aggregate."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for _, codes in by_length(list(b["word"])):
                    hashed = ends(codes)[1][:, 0]
                    places = np.concatenate([self.place(hashed, p) for p in PROBES]).astype(np.int64) + 1
                    yield pd.DataFrame({"slice": np.tile(self.slice_of(hashed), len(PROBES)).astype(np.int64), "place": places})

        bits = words.select("word").mapInPandas(lean(run), "slice long, place long")
        return bits.groupBy("slice", F.bitmap_bucket_number("place").alias("segment")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))

    def loaded(self, segments: DataFrame, number: int) -> np.ndarray:
        """The bytes of one slice: at most 2 ** MOST_BITS bits, whatever the vocabulary's size."""
        out = np.zeros(1 << self.bits >> 3, np.uint8)
        for r in segments.where(F.col("slice") == number).toLocalIterator():
            out[(r["segment"] - 1) * 4096 : r["segment"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        return out

    def passing(self, hashed: np.ndarray, held: np.ndarray, number: int) -> np.ndarray:
        """Indexes of those hashes that may be of words in slice ``number``."""
        at = None
        for probe in PROBES:
            place = self.place(hashed, probe)
            found = np.flatnonzero((held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
            at, hashed = found if at is None else at[found], hashed[found]
        return at[self.slice_of(hashed) == number] if self.slices else at


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray, lengths: dict[int, int] | None = None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """All deletions, replacements and insertions of words of one length: how many code points are taken
    and added, the first place, and hashes by word, place and letter (one for a deletion). Changes that lead
    to a long word are left out if ``lengths``, numbers of words by length, has no other of its length."""
    n, length = codes.shape
    first, rest = ends(codes)
    power, letters = powers(length + 1), VALUE[alphabet]
    step = max(1, CELLS // (n * max(len(letters), 1)))
    for taken, added in ((1, 0), (1, 1), (0, 1)):
        made = length - taken + added
        if lengths is not None and made > LONG and lengths.get(made, 0) <= (made == length):
            continue
        for lo in range(0, length + 1 - taken, step):
            i = np.arange(lo, min(lo + step, length + 1 - taken))
            after = length - i - taken
            base = (first[:, i] * power[after + added] + rest[:, i + taken])[:, :, None]
            yield taken, added, lo, base + power[after][:, None] * letters if added else base


def candidates(words: DataFrame, alphabet: np.ndarray, test: Filter, held: Broadcast, number: int, lengths: dict[int, int] | None) -> DataFrame:
    """(word, n, near): the neighbours of each word that pass a slice of the filter, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, letters = held.value, alphabet.tobytes().decode("latin-1")
        for b in batches:
            words, counts = list(b["word"]), b["n"].to_numpy()
            near, of, room = [], [], HANDED
            handed = lambda: pd.DataFrame({"word": [words[r] for r in of], "n": counts[of], "near": near})
            for which, codes in by_length(words):
                for taken, added, lo, hashed in neighbourhood(codes, alphabet, lengths):
                    row, rest = np.divmod(test.passing(hashed.ravel(), bits, number), hashed.shape[1] * hashed.shape[2])
                    at, k = lo + rest // hashed.shape[2], rest % hashed.shape[2]
                    # Of changes with one result the first stands, and a letter isn't replaced by itself.
                    before = np.where(at > 0, codes[row, np.maximum(at - 1, 0)], 0)
                    own = codes[row, np.minimum(at, codes.shape[1] - 1)]
                    ok = (own != alphabet[k] if taken else before != alphabet[k]) if added else before != own
                    for r, i, c in zip(which[row[ok]].tolist(), at[ok].tolist(), k[ok].tolist(), strict=True):
                        w = words[r]
                        near.append(w[:i] + (letters[c] if added else "") + w[i + taken :])
                        of.append(r)
                        room -= len(w)
                        if room < 0:
                            yield handed()
                            near, of, room = [], [], HANDED
            if of:
                yield handed()

    return words.mapInPandas(lean(run), "word string, n long, near string")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far in each round."""
    small = small_enough(forms, WORDS_TO_BROADCAST)
    paths = stored(forms.select("word", F.col("form").alias("root")), "spelling-paths")
    while True:
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = stored(paths.join(F.broadcast(on) if small else on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"), "spelling-paths")
        paths = longer.drop("_next")
        # Counts at least double along a path, so its length is at most the logarithm of a count.
        if longer.where("_next is not null").isEmpty():
            return paths


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    spark = docs.sparkSession
    words = stored(vocabulary(docs, id_col, text_col, min_chars, min_count), "spelling-words")
    total = words.count()
    # At most the code points that a word may hold, whatever the vocabulary's size.
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c != ''").collect()
    alphabet = np.frombuffer("".join(sorted(r["c"] for r in letters)).encode("latin-1"), np.uint8)
    by_size = words.where(F.char_length("word") > LONG).groupBy(F.char_length("word").alias("length")).count()
    lengths = {r["length"]: r["count"] for r in by_size.collect()} if small_enough(by_size, LENGTHS_TO_SEND) else None
    test = Filter.of_size(total)
    segments = stored(test.built(words), "spelling-filter")
    dealt = words.repartition(max(1, -(-total // TASK_WORDS)), "word")
    targets = maybe_broadcast(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), WORDS_TO_BROADCAST)
    found = []
    for number in range(1 << test.slices):
        held = spark.sparkContext.broadcast(test.loaded(segments, number))
        found.append(stored(candidates(dealt, alphabet, test, held, number, lengths).join(targets, "near"), "spelling-near"))
        held.destroy()
    pairs = reduce(DataFrame.unionByName, found)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best"))
    best_n = -F.col("best.neg")
    fit = best_n >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fit, F.col("best.near")).alias("form"), F.when(fit, best_n).alias("form_n"))
    formed = stored(formed, "spelling-forms")
    roots = roots_of(formed.where("form is not null").select("word", "form"))
    return formed.join(maybe_broadcast(roots, WORDS_TO_BROADCAST), "word", "left").withColumn("root", F.coalesce("root", "word"))
