"""BPE encoding and decoding through a table of distinct words.

Method: documents are split into words block by block; a block keeps each of
its words once and its documents as positions in that list. Words are then
dealt by hash, so that each distinct word of the corpus meets in one place and
is encoded once; its ids go back to every block that asked and take the places
of the positions. For decoding the ids of a block's words are joined to the table of ids and
pieces (as large as the vocabulary), and the pieces take the places of the words.

A block is of bounded size, and words stream past a table of bounded size (a word that
has left it is encoded anew), so no task holds more than these.

The result equals the tokenizers library's encode(text, add_special_tokens=False)
and decode(ids, skip_special_tokens=False). Words of common Latin text are split
by one pattern here; any text with other characters is normalised and split by
the library's own normalizer and pre-tokenizer. Strings of special tokens become
their ids, as in the library.

Defined results: a null text counts as empty and has no ids and an empty decoded
text. Every row gives one row, repeated ids included. An empty table gives an
empty result. Only the id and the text are read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, stored

#: Characters of text that make one block; a longer document is a block of its own.
BLOCK_CHARS = 12_000_000
#: Words of the documents that are put together at a time.
RUN_WORDS = 200_000
#: Words that are encoded in one call of the library.
ENCODE_BATCH = 5_000
#: Words of a bucket that a task remembers before it starts anew.
REMEMBERED = 500_000

#: Texts of these characters alone need neither the library's NFC nor its Unicode
#: tables: ASCII and the Latin letters up to U+024F, less the dotted capital I,
#: whose lower case has two characters.
PLAIN = re.compile("[\t\n\r -~À-įı-ɏ]*")
LETTERS = "a-zß-öø-ɏ"
WORDS = re.compile(f"[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")
WORDS_WITH_ENDINGS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")


class Splitter:
    """Splits texts into the words that the tokenizer's model gets to see."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalizer, self.split = whole.normalizer, whole.pre_tokenizer[0]
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) + ")")

    def __call__(self, text: str) -> list[str]:
        if "<|" in text and len(parts := self.special.split(text)) > 1:
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words(part))]
        return self.words(text)

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return (WORDS_WITH_ENDINGS if "'" in text else WORDS).findall(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]


class Encoder:
    """Ids of single words, and the table of ids and pieces."""

    def __init__(self, path: str) -> None:
        # Tasks fill the cores already; the library's own threads would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = pd.DataFrame({"id": np.fromiter(pieces.values(), np.int64), "piece": pd.Series(list(pieces), dtype=object)})

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), ENCODE_BATCH):
            part = words[at : at + ENCODE_BATCH]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)


@functools.cache
def splitter(path: str) -> Splitter:
    return Splitter(path)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack_codes(codes: np.ndarray) -> bytes:
    """Numbers of which most are small: a byte for each, 255 standing for those that follow in full."""
    small = zstandard.compress(np.minimum(codes, 255).astype(np.uint8).tobytes())
    return len(small).to_bytes(4, "little") + small + pack(codes[codes >= 255])


def unpack_codes(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    codes = np.frombuffer(zstandard.decompress(data[4 : 4 + size]), np.uint8).astype(np.uint32)
    codes[codes == 255] = unpack(data[4 + size :])
    return codes


def to_blocks(path: str, buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of documents (ids, counts, codes) and of words (bucket, words, slots) of each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, task, n = splitter(path), TaskContext.get().partitionId(), count()

        def close(ids: list, codes: list[np.ndarray], table: dict[str, int]) -> pd.DataFrame:
            # Frequent words get low numbers, which pack best.
            flat = np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(table)), kind="stable")
            rank = np.empty(len(table), np.uint32)
            rank[order] = np.arange(len(table), dtype=np.uint32)
            found = list(table)
            parts: dict[int, tuple[list[str], list[int]]] = {}
            for code, at in enumerate(order.tolist()):
                own = parts.setdefault(zlib.crc32(found[at].encode()) % buckets, ([], []))
                own[0].append(found[at])
                own[1].append(code)
            counts = np.fromiter(map(len, codes), np.int64)
            turn = np.cumsum(counts) // RUN_WORDS
            rows = []
            for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(turn)) + 1):
                first, last = int(counts[: at[0]].sum()), int(counts[: at[-1] + 1].sum())
                rows.append((ids[at[0] : at[-1] + 1], pack(counts[at]), pack_codes(rank[flat[first:last]]), None, None, None))
            rows += [(None, None, None, bucket, zstandard.compress("\n".join(w).encode()), pack(np.diff(s, prepend=0))) for bucket, (w, s) in parts.items()]
            return pd.DataFrame(rows, columns=["_ids", "counts", "codes", "bucket", "words", "slots"]).assign(block=(task << 32) + next(n))[BLOCK]

        ids, codes, chars = [], [], 0
        table: dict[str, int] = defaultdict(count().__next__)
        for batch in batches:
            for ident, text in zip(batch["_id"], batch["_text"], strict=True):
                text = text or ""
                if ids and chars + len(text) > BLOCK_CHARS:
                    yield close(ids, codes, table)
                    ids, codes, chars, table = [], [], 0, defaultdict(count().__next__)
                words = split(text)
                ids.append(None if pd.isna(ident) else ident)
                codes.append(np.fromiter(map(table.__getitem__, words), np.uint32, len(words)))
                chars += len(text)
        if ids:
            yield close(ids, codes, table)

    return run


BLOCK = ["block", "_ids", "counts", "codes", "bucket", "words", "slots"]


def encode_words(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From rows (block, bucket, words) with those of a bucket side by side: sizes and ids of the words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, place, flat, sizes = None, {}, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for b in batches:
            rows = []
            for block, own, packed in zip(b["block"], b["bucket"], b["words"], strict=True):
                words = zstandard.decompress(packed).decode().split("\n")
                if own != bucket or len(place) > REMEMBERED:
                    bucket, place, flat, sizes = own, {}, np.zeros(0, np.uint32), np.zeros(0, np.int64)
                new = [w for w in words if w not in place]
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                ids, n = encoder(path).ids(new)
                flat, sizes = np.concatenate([flat, ids]), np.concatenate([sizes, n])
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                ids = flat[runs((np.cumsum(sizes) - sizes)[at], sizes[at])]
                rows.append((block, own, pack(sizes[at]), pack(ids)))
            yield pd.DataFrame(rows, columns=["block", "bucket", "sizes", "word_ids"])

    return run


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def assemble(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Documents from the rows of blocks: those of a block are neighbours, its words before its documents.

    A block's words are held, and documents are put together a run at a time.
    """

    def words_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Where the ids of each word begin, how many it has, the ids, and the text of each word."""
        both = rows.dropna(subset=["slots"])[["bucket", "slots"]].merge(rows.dropna(subset=["sizes"])[["bucket", "sizes", "word_ids"]], on="bucket")
        column = lambda c, f: np.concatenate([f(unpack(x)) for x in both[c]] or [np.zeros(0)]).astype(np.int64)
        slots, sizes, ids = column("slots", np.cumsum), column("sizes", np.asarray), column("word_ids", np.asarray)
        starts = np.cumsum(sizes) - sizes
        start_of, size_of = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        start_of[slots], size_of[slots] = starts, sizes
        pieces = pd.DataFrame({"id": ids}).merge(encoder(path).vocabulary, on="id", how="left")["piece"].tolist()
        text_of = [""] * len(slots)
        for slot, a, n in zip(slots.tolist(), starts.tolist(), sizes.tolist(), strict=True):
            text_of[slot] = " ".join(pieces[a : a + n])
        return start_of, size_of, ids, text_of

    def documents(idents: list, counts: bytes, codes: bytes, words: tuple) -> pd.DataFrame:
        start_of, size_of, ids, text_of = words
        out_ids, texts = [], []
        for own in np.split(unpack_codes(codes), np.cumsum(unpack(counts).astype(np.int64))[:-1]):
            out_ids.append(ids[runs(start_of[own], size_of[own])].astype("<u4").tobytes())
            texts.append(" ".join(map(text_of.__getitem__, own.tolist())))
        return pd.DataFrame({"_id": pd.Series(list(idents), dtype=object), "n_tokens": [len(x) // 4 for x in out_ids], "ids": out_ids, "decoded": texts})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, words = None, [], None
        for b in batches:
            for i in range(len(b)):
                row = b.iloc[i : i + 1]
                if row["block"].iat[0] != block:
                    block, held, words = row["block"].iat[0], [], None
                if row["documents"].iat[0]:
                    words = words or words_of(pd.concat(held) if held else row)
                    yield documents(row["_ids"].iat[0], row["counts"].iat[0], row["codes"].iat[0], words)
                else:
                    held.append(row)

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_tokens, ids (little-endian unsigned 32-bit numbers) and decoded."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    blocks = stored(rows.mapInPandas(lean(to_blocks(path, buckets)), f"block long, _ids array<{kind}>, counts binary, codes binary, bucket int, words binary, slots binary"), "bpe-blocks")
    words = blocks.where("bucket IS NOT NULL").select("block", "bucket", "words").repartition("bucket").sortWithinPartitions("bucket")
    encoded = words.mapInPandas(lean(encode_words(path)), "block long, bucket int, sizes binary, word_ids binary")
    parts = blocks.drop("words").unionByName(encoded, allowMissingColumns=True).withColumn("documents", F.col("codes").isNotNull())
    out = parts.repartition("block").sortWithinPartitions("block", "documents").mapInPandas(lean(assemble(path)), f"_id {kind}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("_id", id_col)
