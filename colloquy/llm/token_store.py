"""A content-addressed store of token ids.

Method: every text becomes a stream of ids; a hash that rolls over the last WINDOW
ids cuts the stream into chunks, so that equal passages give equal chunks wherever
they stand; a chunk is stored once under the hash of its bytes; a document is a
recipe, the list of its chunks' hashes; Merkle roots stand for recipes, shards and
the whole store, and a reader recomputes them all from what it has read. A document is verified if
its chunks, its shard and the store are as their roots say.

Format, below one folder, all Parquet:
``chunks``    hash, n, ids: each distinct chunk once; ids are little-endian, 2 bytes
              each if the vocabulary allows, else 4.
``documents`` shard, doc_id, start, n_tokens, recipe (hashes, 16 bytes each), root:
              in ascending doc_id order within and across shards.
``manifest``  shard, documents, tokens, root: one row a shard. A leaf of a shard's tree holds a
              document's id, its start and the root of its recipe.
``store``     one row: n_shards, documents, tokens, and the root over the shards' roots.

Ids equal the tokenizers library's encode(text, add_special_tokens=False), with an
end id after each document. Texts are cut where a boundary of words is certain; the new
pieces of many texts are encoded by the library together, and each is encoded once as
long as it is remembered. A text with a special token is encoded whole.

Defined results: a null text counts as empty and has its end id only. Null ids come
first; rows that repeat an id follow each other and each has a recipe. An empty table
gives an empty store. Texts of any length are encoded whole, in bounded pieces. Only the id and the text are read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, shared_folder, stored, with_running_totals

#: A chunk ends where the hash of the last WINDOW ids has MASK's bits zero, or
#: after MAX_CHUNK ids.
WINDOW, MASK, MAX_CHUNK = 8, 255, 2048
HASH_BYTES = 16
#: Texts that are encoded in one call of the library.
ENCODE_BATCH = 1_000
#: Characters of text whose new pieces are encoded together.
BATCH_CHARS = 2_000_000
#: Pieces of text remembered by a worker (about 40 bytes each) before it starts anew.
REMEMBERED = 3_000_000
#: Chunk numbers (8 bytes each) that are sent to all executors up to this many.
NUMBERS_TO_BROADCAST = 1_000_000

U = np.uint64
ID_RANKS = np.random.RandomState(11).randint(0, 1 << 63, 1 << 16, dtype=np.int64).astype(U)
FACTOR = U(0x9E3779B97F4A7C15)

LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~×÷"
#: Pieces of such characters are split here as the tokenizer's own pattern does.
PLAIN = re.compile(f" ?[{LETTERS}0-9{MARKS}]+|\n")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\n|\x00")
#: Kinds of characters below OTHER: marks, digits and letters next to which a boundary is certain, letters alone, and marks that end a word.
OTHER = 0x250
SURE, LETTER, ENDING = (np.zeros(OTHER + 1, bool) for _ in range(3))
SURE[0x21:0x7F] = SURE[0xC0:OTHER] = True
LETTER[[i for i in range(OTHER) if re.fullmatch(f"[{LETTERS}]", chr(i))]] = True
ENDING[[ord(c) for c in ".,;:!?"]] = True


def byte_characters() -> dict[int, str]:
    """The character for each byte in the pieces of a byte-level vocabulary: itself if it can be shown, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(other)}


BYTE_CHARACTERS = byte_characters()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, ``size`` numbers each."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)


class RollingHash:
    """Hashes of any stretch of a text, from running sums; 64 bits."""

    def __init__(self, seed: int) -> None:
        draw = np.random.RandomState(seed)
        self.ranks = draw.randint(0, 1 << 62, 1 << 16, dtype=np.int64).astype(U)
        self.base = int(draw.randint(0, 1 << 62, dtype=np.int64)) * 2 + 1
        self.powers = self.inverses = np.ones(1, U)

    def __call__(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if len(points) >= len(self.powers):
            n = len(points) * 3 // 2 + 1
            self.powers, self.inverses = (np.cumprod(np.concatenate([[U(1)], np.full(n, U(x % (1 << 64)))]), dtype=U) for x in (self.base, pow(self.base, -1, 1 << 64)))
        terms = self.ranks[points & 0xFFFF] + (points >> 16).astype(U) * FACTOR
        sums = np.concatenate([[U(0)], np.cumsum(terms * self.powers[: len(points)], dtype=U)])
        h = (sums[starts + sizes] - sums[starts]) * self.inverses[starts] + sizes.astype(U)
        h = (h ^ (h >> U(31))) * FACTOR
        return h ^ (h >> U(29))


class Known:
    """Ids of pieces by their two hashes: a sorted table, and a smaller one of what came last."""

    def __init__(self, dtype: str) -> None:
        self.ids = np.zeros(0, dtype)
        self.levels = [self.level(), self.level()]

    @staticmethod
    def level(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
        """First hash, second hash, start and number of ids."""
        columns = columns or (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is known, and where its ids stand. A piece that differs from a known one in its second hash alone is an error."""
        known, starts, sizes = np.zeros(len(first), bool), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for keys, others, at, n in self.levels:
            if len(keys):
                place = np.minimum(np.searchsorted(keys, first), len(keys) - 1)
                same = keys[place] == first
                if (others[place[same]] != second[same]).any():
                    raise LookupError
                known |= same
                starts[same], sizes[same] = at[place[same]], n[place[same]]
        return known, starts, sizes

    def add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        own = (first, second, len(self.ids) + np.cumsum(sizes) - sizes, sizes)
        self.ids = np.concatenate([self.ids, ids])
        old, late = self.levels
        late = self.level(*map(np.concatenate, zip(late, own, strict=True)))
        if len(late[0]) > 100_000 + len(old[0]) // 4:
            old, late = self.level(*map(np.concatenate, zip(old, late, strict=True))), self.level()
        self.levels = [old, late]


class TextEncoder:
    """Texts to ids, as the library has them.

    Texts are cut where a boundary of words is certain, whatever stands around: before single spaces between characters
    of SURE, around single line feeds between such, and before marks after letters. Pieces are told apart by 128-bit hashes,
    and each new one is encoded once.
    """

    def __init__(self, path: str) -> None:
        # Tasks fill the cores already; the library's own threads would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer(self.library.model)  # for words that are split and mapped to characters already
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.hashes = RollingHash(1), RollingHash(2)
        self.known = Known(self.dtype)

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts as the library splits them."""
        found = []
        for at in range(0, len(texts), ENCODE_BATCH):
            found += [e.ids for e in self.library.encode_batch_fast(texts[at : at + ENCODE_BATCH], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())), sizes

    def plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that PLAIN matches."""
        found = WORDS.findall("\x00".join(pieces))
        place: dict[str, int] = defaultdict(count().__next__)
        place["\x00"]
        at = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
        words = "\x00".join(place)[2:].encode().decode("latin-1").translate(BYTE_CHARACTERS).split(BYTE_CHARACTERS[0])
        e = self.model.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, sizes = np.array(e.ids, self.dtype), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))
        sizes = np.concatenate([[0], sizes])  # the mark between two pieces has no ids
        per_piece = np.bincount(np.cumsum(at == 0), sizes[at], len(pieces)).astype(np.int64)
        return ids[ranges((np.cumsum(sizes) - sizes)[at], sizes[at])], per_piece

    def learn(self, pieces: list[str], first: np.ndarray, second: np.ndarray) -> None:
        ok = np.fromiter((PLAIN.fullmatch(x) is not None for x in pieces), bool, len(pieces))
        for part, encode in ((ok, self.plain), (~ok, self.raw)):
            if part.any():
                self.known.add(first[part], second[part], *encode([pieces[i] for i in np.flatnonzero(part)]))

    def cut(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        kinds = np.minimum(points, OTHER)
        sure = SURE[kinds]
        head = np.zeros(len(points) + 1, bool)
        head[begins[begins < len(points)]] = True
        start = head[:-1].copy()
        between = np.zeros(len(points), bool)
        between[1:-1] = sure[:-2] & sure[2:] & ~head[1:-2] & ~head[2:-1]
        start |= between & ((points == 0x20) | (points == 0x0A))
        start[1:] |= (between & (points == 0x0A))[:-1]
        start[1:] |= ENDING[kinds[1:]] & LETTER[kinds[:-1]] & ~head[1:-1]
        return np.flatnonzero(start)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        whole = np.fromiter((any(s in t for s in self.special) for t in texts), bool, len(texts))
        if whole.any():
            return self.with_whole(texts, whole)
        big = "".join(texts)
        if not big:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        begins = np.cumsum(lengths) - lengths
        starts = self.cut(points, begins)
        sizes = np.diff(np.append(starts, len(points)))
        first, second = (h(points, starts, sizes) for h in self.hashes)
        keys, example, own = np.unique(first, return_index=True, return_inverse=True)
        others = second[example]
        try:
            if (others[own] != second).any():
                raise LookupError
            if len(self.known) > REMEMBERED:
                self.known = Known(self.dtype)
            new = ~self.known.find(keys, others)[0]
            self.learn([big[a:z] for a, z in zip(starts[example[new]].tolist(), (starts + sizes)[example[new]].tolist(), strict=True)], keys[new], others[new])
            _, at, n = self.known.find(keys, others)
        except LookupError:  # two pieces with one first hash
            return self.raw(texts)
        counts = n[own]
        edges = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, np.append(begins, len(points)))]
        return self.known.ids[ranges(at[own], counts)], np.diff(edges)

    def with_whole(self, texts: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where some texts hold a special token; these are encoded whole."""
        sizes, parts = np.zeros(len(texts), np.int64), {}
        for chosen, encode in ((whole, self.raw), (~whole, self)):
            at = np.flatnonzero(chosen)
            ids, own = encode([texts[i] for i in at])
            sizes[at] = own
            parts |= dict(zip(at.tolist(), np.split(ids, np.cumsum(own)[:-1]), strict=True)) if len(at) else {}
        return np.concatenate([parts[i] for i in range(len(texts))]), sizes


@functools.cache
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def chunk_ends(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the chunks of streams end that stand one after the other; a stream's end ends a chunk."""
    ranks = ID_RANKS[ids & 0xFFFF]
    place = ranges(np.zeros(len(sizes), np.int64), sizes)
    total, power = np.zeros(len(ids), U), FACTOR
    for j in range(min(WINDOW, len(ids))):
        total[j:] += np.where(place[j:] >= j, ranks[: len(ids) - j] * power, U(0))
        power = U(int(power) * int(FACTOR) & (1 << 64) - 1)
    last = ((total >> U(40)) & U(MASK)) == 0
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts > MAX_CHUNK
    if long.any():
        more = [np.arange(a + MAX_CHUNK, z, MAX_CHUNK) for a, z in zip(starts[long], ends[long], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunk_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node goes up as it is. Leaves and nodes are hashed apart."""
    level = [chunk_hash(b"\x00" + x) for x in leaves] or [chunk_hash(b"")]
    while len(level) > 1:
        level = [chunk_hash(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def hashes_of(recipe: bytes) -> list[bytes]:
    return [recipe[i : i + HASH_BYTES] for i in range(0, len(recipe), HASH_BYTES)]


CHUNK = ["number", "hash", "n", "ids"]
DOCUMENT = ["_id", "row", "n_tokens", "recipe", "root"]


def encoded(path: str, end_id: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of documents (_id, row, n_tokens, recipe, root) and of chunks (number, hash, n, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, at = text_encoder(path), TaskContext.get().partitionId() << 40
        row, number = count(at), count(at)
        width = np.dtype(encoder.dtype).itemsize
        for b in small_batches(batches):
            ids, sizes = encoder([t or "" for t in b["_text"]])
            ids, sizes = np.insert(ids, np.cumsum(sizes), np.array(end_id, encoder.dtype)), sizes + 1
            ends = chunk_ends(ids, sizes)
            data, cuts = ids.tobytes(), (ends * width).tolist()
            parts = [data[a:z] for a, z in zip([0, *cuts[:-1]], cuts, strict=True)]
            hashes = [chunk_hash(x) for x in parts]
            of = np.searchsorted(ends, np.cumsum(sizes), "right").tolist()
            recipes = [hashes[a:z] for a, z in zip([0, *of[:-1]], of, strict=True)]
            docs = pd.DataFrame({"_id": b["_id"].reset_index(drop=True), "row": list(islice(row, len(b))), "n_tokens": sizes, "recipe": [b"".join(r) for r in recipes], "root": list(map(merkle_root, recipes))})
            yield docs.assign(**dict.fromkeys(CHUNK))[CHUNK + DOCUMENT]
            chunks = pd.DataFrame({"number": list(islice(number, len(parts))), "hash": hashes, "n": np.diff(ends, prepend=0), "ids": parts})
            yield chunks.assign(**dict.fromkeys(DOCUMENT))[CHUNK + DOCUMENT]

    return run


def small_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in frames of about BATCH_CHARS characters of text."""
    for b in batches:
        at = np.cumsum([len(t or "") for t in b["_text"]]) // BATCH_CHARS
        for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(at)) + 1):
            yield b.iloc[part]


def document_leaf(doc_id: object, start: int, root: bytes) -> bytes:
    """What stands for a document in its shard's tree: its id and place, and the root of its recipe."""
    return chunk_hash(f"{'' if pd.isna(doc_id) else doc_id}:{start}:".encode() + root)


def shard_roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The manifest's rows from documents sorted by shard and place; a tree of each shard."""
    shard, leaves, tokens = None, [], 0

    def row() -> pd.DataFrame:
        return pd.DataFrame([(shard, len(leaves), tokens, merkle_root(leaves))], columns=["shard", "documents", "tokens", "root"])

    for b in batches:
        for s, doc_id, start, n, root in zip(b["shard"], b["doc_id"], b["start"], b["n_tokens"], b["root"], strict=True):
            if s != shard:
                if leaves:
                    yield row()
                shard, leaves, tokens = s, [], 0
            leaves.append(document_leaf(doc_id, start, root))
            tokens += n
    if leaves:
        yield row()


MANIFEST = "shard int, documents long, tokens long, root binary"


def manifest_of(documents: DataFrame) -> DataFrame:
    ordered = documents.select("shard", F.col("doc_id").cast("string").alias("doc_id"), "start", "row", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "start", "row")
    return ordered.mapInPandas(shard_roots, MANIFEST)


def store_of(manifest: DataFrame) -> DataFrame:
    """One row: the numbers of shards, documents and tokens, and the root over the shards' roots."""

    def rooted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(root=[merkle_root([bytes(x["root"]) for x in shards]) for shards in b["shards"]])[["n_shards", "documents", "tokens", "root"]]

    one = manifest.groupBy().agg(F.count("*").alias("n_shards"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.array_sort(F.collect_list(F.struct("shard", "root"))).alias("shards"))
    return one.mapInPandas(rooted, "n_shards long, documents long, tokens long, root binary")


def write_store(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` with the tokenizer at ``path`` and write the store to ``folder``."""
    kind = docs.schema[id_col].dataType.simpleString()
    staged = stored(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(
            encoded(path, end_id), f"number long, hash binary, n long, ids binary, _id {kind}, row long, n_tokens long, recipe binary, root binary"
        ),
        "tokens-staged",
    )
    chunks = staged.where("hash IS NOT NULL")
    again = stored(chunks.groupBy("hash").agg(F.min("number").alias("first"), F.count("*").alias("k")).where("k > 1").select("hash", "first"), "tokens-again")
    spare = stored(chunks.select("hash", "number").join(again, "hash").where("number > first").select("number"), "tokens-spare")
    once = chunks.join(maybe_broadcast(spare, NUMBERS_TO_BROADCAST), "number", "left_anti")
    once.select("hash", "n", "ids").write.option("compression", "zstd").parquet(f"{folder}/chunks")

    recipes = staged.where("row IS NOT NULL").select(F.col("_id").alias("doc_id"), "row", "n_tokens", "recipe", "root")
    placed = with_running_totals(recipes, ["doc_id", "row"], {"start": F.col("n_tokens")}, "tokens-placed", shard="shard")
    placed.select("shard", "doc_id", "row", "start", "n_tokens", "recipe", "root").sortWithinPartitions("shard", "start", "row").write.parquet(f"{folder}/documents")
    documents = docs.sparkSession.read.parquet(f"{folder}/documents")
    manifest_of(documents).write.parquet(f"{folder}/manifest")
    store_of(docs.sparkSession.read.parquet(f"{folder}/manifest")).write.parquet(f"{folder}/store")


def gf2_product(a: int, b: int) -> int:
    """a * b modulo the polynomial of CRC-32, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
    return out


def times(values: np.ndarray, factor: int) -> np.ndarray:
    """gf2_product of every value and one factor."""
    out, b = np.zeros(len(values), np.uint32), values.astype(np.uint32)
    for bit in range(31, -1, -1):
        if factor >> bit & 1:
            out ^= b
        b = (b >> np.uint32(1)) ^ (b & np.uint32(1)) * np.uint32(0xEDB88320)
    return out


def crc_of_runs(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of wholes from those of their parts: ``sizes`` in bytes; a whole begins at each of ``starts``."""
    ends = np.cumsum(sizes)
    after = np.repeat(np.append(ends[starts[1:] - 1], ends[-1]), np.diff(np.append(starts, len(sizes)))) - ends
    moved, power = crcs.astype(np.uint32), 1 << 23  # x^8: one zero byte
    while after.any():
        odd = np.flatnonzero(after & 1)
        moved[odd] = times(moved[odd], power)
        power, after = gf2_product(power, power), after >> 1
    return np.bitwise_xor.reduceat(moved, starts)


def checked_chunks(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What the stored chunks hold: hash, ids, and the CRC of the ids as 32-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype = text_encoder(path).dtype
        for b in batches:
            ids = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in b["ids"]]
            yield pd.DataFrame({
                "hash": b["hash"],
                "n": [len(x) // 4 for x in ids],
                "crc": [zlib.crc32(x) for x in ids],
                "sound": [chunk_hash(x) == h for x, h in zip(b["ids"], b["hash"], strict=True)],
            })

    return run


def document_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of documents from their parts in order; the last document of a batch waits for the next one."""

    def sums(b: pd.DataFrame) -> pd.DataFrame:
        row, hashes = b["row"].to_numpy(), list(b["hash"])
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        n = b["n"].to_numpy()
        ends = np.append(starts[1:], len(row))
        return pd.DataFrame({
            "row": row[starts],
            "n_tokens": np.add.reduceat(n, starts),
            "ids_crc32": crc_of_runs(b["crc"].to_numpy(), 4 * n, starts).astype(np.int64),
            "found": merkle_roots(hashes, starts.tolist(), ends.tolist()),
            "sound": np.logical_and.reduceat(b["sound"].to_numpy(bool), starts),
        })

    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if len(b):
            last = int(np.argmax(b["row"].to_numpy() == b["row"].iloc[-1]))
            if last:
                yield sums(b.iloc[:last])
            held = b.iloc[last:]
    if held is not None and len(held):
        yield sums(held)


def merkle_roots(hashes: list[bytes], starts: list[int], ends: list[int]) -> list[bytes]:
    return [merkle_root(hashes[a:z]) for a, z in zip(starts, ends, strict=True)]


def pieces_of(documents: DataFrame) -> DataFrame:
    """(row, at, hash) of the recipes."""
    last = (F.length("recipe") / HASH_BYTES).cast("int") - 1
    return documents.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("recipe", i * HASH_BYTES + 1, F.lit(HASH_BYTES)))).alias("at", "hash"))


def sound_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, shard_sound): whether the shard and the store are what the documents read make them; one row a shard."""
    documents, held = spark.read.parquet(f"{folder}/documents"), spark.read.parquet(f"{folder}/manifest")
    made = stored(manifest_of(documents), "tokens-manifest")
    whole = not spark.read.parquet(f"{folder}/store").exceptAll(store_of(made)).count() and not held.exceptAll(made).count()
    same = made.join(held.withColumn("shard_sound", F.lit(True)), made.columns, "left")
    return same.select("shard", (F.coalesce("shard_sound", F.lit(False)) & F.lit(whole)).alias("shard_sound"))


def read_sums(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids_crc32, verified; all from the files.

    A chunk's bytes are read once; a document's CRC and Merkle root follow from
    those of its chunks, so no ids are sent from one executor to another.
    """
    documents = spark.read.parquet(f"{folder}/documents")
    chunks = stored(spark.read.parquet(f"{folder}/chunks").mapInPandas(checked_chunks(path), "hash binary, n long, crc long, sound boolean"), "tokens-checked")
    parts = stored(pieces_of(documents).join(chunks, "hash"), "tokens-parts").select("row", "at", "hash", "n", "crc", "sound").repartition("row").sortWithinPartitions("row", "at")
    sums = parts.mapInPandas(document_sums, "row long, n_tokens long, ids_crc32 long, found binary, sound boolean")
    shards = maybe_broadcast(sound_shards(spark, folder), NUMBERS_TO_BROADCAST)
    known = documents.select("row", "doc_id", "start", "shard", "root", F.col("n_tokens").alias("listed")).join(shards, "shard").join(sums, "row")
    verified = F.col("sound") & (F.col("found") == F.col("root")) & (F.col("listed") == F.col("n_tokens")) & F.col("shard_sound")
    return known.select("doc_id", "start", "n_tokens", "ids_crc32", verified.alias("verified"))


def read_ids(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Per stored document: doc_id, start, and ids (little-endian unsigned 32-bit numbers), put together again."""
    documents = spark.read.parquet(f"{folder}/documents")
    parts = pieces_of(documents).join(spark.read.parquet(f"{folder}/chunks"), "hash").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype = text_encoder(path).dtype
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in parts), dtype).astype("<u4").tobytes() for parts in b["parts"]]
            yield pd.DataFrame({"row": b["row"], "ids": ids})

    return documents.select("row", "doc_id", "start").join(parts.mapInPandas(joined, "row long, ids binary"), "row").drop("row")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
