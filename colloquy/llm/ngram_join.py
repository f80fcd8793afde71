"""Similarity join of shingle sets by Jaccard similarity, with PartEnum signatures.

Method: the sets of word shingles are put into bands by size. Within a band (and its
upper neighbour, as far as sizes allow) two sets of similarity 0.8 or more differ in at
most k features. The feature domain is dealt by hash into parts, and each part into
CELLS cells. Two sets differ by one feature at most in some part, as there are more than
k / 2 of them; there CELLS - 1 cells agree. So a set's signatures are, for each part and each
subset of CELLS - 1 of its cells, the hash of the features in those cells: sets that link share one.
A set with features in two cells or more of over k / 2 parts needs no signature of empty cells,
because then a shared one holds a feature; any other set has those of empty cells too.

Sets that share a signature are candidates. Small groups give all their pairs. Large
groups (a family of near copies, or a passage that many documents share) give the pairs of
one member, the centre, which is the same for most groups of a family. Candidates are refuted by
sizes and feature counts (the difference of two histograms is at most that of the sets);
for each set the nearest candidate is verified on whole sets first, and then whatever
candidates still join two components.

What large groups may hide is settled next, for centres whose groups hold sets of several components:
1. A set is done with if it has so few signatures in those groups that each partner must meet it elsewhere.
2. Sets that link share all but a fifth of their features. A set whose rarest features, a fifth and one more,
   have few holders each gives its pairs with those holders and is done with.
3. What remains (sets made almost wholly of common features, not yet connected) is compared family by family,
   in blocks of bounded size: by components, sizes, histograms and features, in this order. Only links that join
   components leave a task.

Sets are known by 128-bit hashes; signatures carry 64 bits of them as a name, and names lead back to all sets
that bear them, so that equal names cost a verification and merge nothing. Features are 64-bit hashes.

Defined results: a null text counts as empty; an empty text or one without words
has no features, links with nothing and is its own component. A text of fewer
than five words is one feature. Rows that repeat an id count as copies if
their texts agree. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, maybe_broadcast, one_row, stored, whole_row
from .components import connected_components

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Cells of a part; signatures are of all subsets with one cell less.
CELLS = 3
#: Parts for each that is needed; more leave room for empty cells.
ROOM = 1.2
BAND_RATIO = 1.5
#: A group of more sets than this is large.
SMALL_GROUP = 6
#: A feature is common if more than this many of the sets that are left hold it.
COMMON = 16
HISTOGRAM = 128
#: Classes of at least this share of all rows give their signatures once; there
#: are at most 1 / HOT_SHARE of them.
HOT_SHARE, HOT_LEAST = 1e-5, 16
#: Set numbers (8 bytes each) are sent to all executors up to this many.
IDS_TO_BROADCAST = 1_000_000
#: Characters of text that are turned into features at a time.
CHUNK_CHARS = 1_000_000
#: Features in a block of the sets that are compared with each other.
BLOCK_FEATURES = 2_000_000
#: Bytes of text whose words are hashed at a time, so that the running sums stay in a core's cache.
PIECE = 1 << 17

U = np.uint64
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes:
    """Hashes of the words of texts, all words of a piece of text at once.

    A word's hash is the sum of VALUE[byte] * BASE ** place over its bytes, modulo 2 ** 64: a difference of two
    running sums over the piece, brought back to the word's start by the inverse of BASE.
    """

    BASE = 0x9E3779B97F4A7C15
    VALUE = mixed(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self) -> None:
        powers = lambda base: np.cumprod(np.concatenate([np.ones(1, U), np.full(PIECE - 1, base, U)]), dtype=U)
        self.up, self.down = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hash and the first byte of each word of ``data``; ASCII white space parts words."""
        text = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(text) + 2, np.int8)
        inside[1:-1] = ~self.SPACE[text]
        turns = np.flatnonzero(np.diff(inside))
        starts, ends = turns[::2], turns[1::2]
        out = np.empty(len(starts), U)
        at = 0
        while at < len(starts):
            to = int(np.searchsorted(ends, starts[at] + PIECE, "right"))
            if to == at:  # a word that is longer than a piece
                out[at] = xxhash.xxh3_64_intdigest(data[starts[at] : ends[at]])
                at += 1
                continue
            low, high = int(starts[at]), int(ends[to - 1])
            sums = np.zeros(high - low + 1, U)
            np.cumsum(self.VALUE[text[low:high]] * self.up[: high - low], out=sums[1:])
            first = starts[at:to] - low
            out[at:to] = (sums[ends[at:to] - low] - sums[first]) * self.down[first]
            at = to
        return out, starts


def shingle_sets(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of every text, one after the other, and where each text's begin and end.

    bytes.lower() knows ASCII only.
    """
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    h, starts = hashes.of(b" ".join(data))
    begin = np.cumsum([0, *(len(d) + 1 for d in data)])
    ends = np.searchsorted(starts, begin[1:])
    counts = np.diff(ends, prepend=0)
    total = h * FACTORS[0] + U(SHINGLE)
    for j in range(1, SHINGLE):
        total[: max(len(h) - j, 0)] += h[j:] * FACTORS[j]
    # A text with fewer words has one feature, which its number of words tells apart.
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = h[ends[i] - counts[i] : ends[i]]
        total[ends[i] - counts[i]] = np.sum(own * FACTORS[: len(own)]) + U(len(own))
    sizes = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    features = mixed(total[ranges(ends - counts, sizes)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        features[a:z].sort()
    new = np.ones(len(features), bool)
    new[1:] = features[1:] != features[:-1]
    new[bounds[:-1][sizes > 0]] = True
    return features[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, ``size`` numbers each."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in frames of about CHUNK_CHARS characters of text."""
    for b in batches:
        chars = np.cumsum([len(t or "") for t in b["_text"]]) // CHUNK_CHARS
        for a, z in edges(np.flatnonzero(np.diff(chars)) + 1, len(b)):
            yield b.iloc[a:z]


def edges(inner: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of 0 .. n that ``inner`` cuts."""
    at = [0, *inner.tolist(), n] if n else [0]
    return zip(at[:-1], at[1:], strict=True)


def set_id(features: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(features.tobytes())


def named(ident: bytes) -> int:
    """The name that signatures carry: half of the set's id."""
    return int.from_bytes(ident[:8], "big", signed=True)


class Bands:
    """Size bands up to a size, and for each the most features that may differ."""

    def __init__(self, largest: int = 1 << 40) -> None:
        self.low = [1]
        while self.low[-1] <= largest * 2:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND_RATIO)))

    def instances(self, size: int) -> list[tuple[int, int, int]]:
        """(band, k, parts): its own band, and the one below if it has sets in reach."""
        i = bisect_right(self.low, size) - 1
        own = [i] + ([i - 1] if i and PERCENT * size <= 100 * (self.low[i] - 1) else [])
        out = []
        for b in own:
            # Of sizes a <= b, with 100 a >= PERCENT b: at most (a + b) (100 - PERCENT) / (100 + PERCENT) differ.
            a = self.low[b + 1] - 1
            k = (100 - PERCENT) * (a + a * 100 // PERCENT) // (100 + PERCENT)
            if k:  # else only equal sets link, and these are one
                out.append((b, k, int(np.ceil(ROOM * (k // 2 + 1)))))
        return out


class Signatures:
    """Signatures of the sets of a chunk: ``values``, the set of each, and its instance (0 or 1, by its band)."""

    def __init__(self, features: np.ndarray, bounds: np.ndarray, bands: Bands) -> None:
        listed = [(i, band, k, parts) for i, n in enumerate(np.diff(bounds).tolist()) if n for band, k, parts in bands.instances(n)]
        self.set, band, k, parts = np.array(listed, np.int64).reshape(-1, 4).T
        sizes = np.diff(bounds)[self.set]
        at = ranges(bounds[self.set], sizes)
        own = features[at]
        part = ((own >> U(32)) * np.repeat(parts.astype(U), sizes)) >> U(32)
        cell = ((own & U(0xFFFFFFFF)) * U(CELLS)) >> U(32)
        first = np.cumsum(parts) - parts
        slot = (np.repeat(first, sizes) + part.astype(np.int64)) * CELLS + cell.astype(np.int64)
        content = np.zeros(int(parts.sum()) * CELLS, U)
        np.add.at(content, slot, own)
        content = content.reshape(-1, CELLS)
        full = content != 0
        row = np.repeat(np.arange(len(parts)), parts)
        #: Parts that may be missed, all others being enough; below zero where empty cells count.
        self.spare = np.bincount(row, full.sum(axis=1) > 1, len(parts)).astype(np.int64) - (k // 2 + 1)
        self.bit = band & 1
        whose = ranges(np.zeros(len(parts), np.int64), parts).astype(U) * FACTORS[2] + (band[row] + 1).astype(U) * FACTORS[3]
        empty_too = (self.spare < 0)[row]
        values, rows = [], []
        for left_out in range(CELLS):
            cells = [c for c in range(CELLS) if c != left_out]
            value = whose + np.array([left_out], U) * FACTORS[4]
            for j, c in enumerate(cells):
                value = value + content[:, c] * FACTORS[j]
            given = full[:, cells].any(axis=1) | empty_too
            values.append(mixed(value[given]))
            rows.append(row[given])
        at = np.concatenate(rows)
        self.values = ((np.concatenate(values) & ~U(1)) | self.bit[at].astype(U)).view(np.int64)
        self.of = self.set[at]


def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, key of the text, set, n and histogram of each row."""
    hashes = WordHashes()
    for b in chunks(batches):
        features, bounds = shingle_sets(list(b["_text"]), hashes)
        sizes = np.diff(bounds)
        held = np.bincount(np.repeat(np.arange(len(b)), sizes) * HISTOGRAM + (features & U(HISTOGRAM - 1)).astype(np.int64), minlength=len(b) * HISTOGRAM)
        held = np.minimum(held, 255).astype(np.uint8).reshape(-1, HISTOGRAM)
        yield pd.DataFrame({
            "_id": b["_id"],
            "key": [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in b["_text"]],
            "set": [set_id(features[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)],
            "n": sizes,
            "hist": [x.tobytes() for x in held],
        })


def signed(hot: dict[bytes, int | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(sig, name) rows. Sets in ``hot`` have many copies: the one with the given id speaks for all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bands = WordHashes(), Bands()
        for b in chunks(batches):
            features, bounds = shingle_sets(list(b["_text"]), hashes)
            sets = [set_id(features[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            speaks = np.array([hot.get(x, ident) in (ident, None) for x, ident in zip(sets, b["_id"], strict=True)], bool)
            found = Signatures(features, bounds, bands)
            names = np.fromiter(map(named, sets), np.int64, len(sets))
            yield pd.DataFrame({"sig": found.values, "name": names[found.of]})[speaks[found.of]]

    return run


def pairs_of_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sig, a, b) from rows in which equal sigs, and equal names of a sig, are neighbours.

    A group of up to SMALL_GROUP names gives all its pairs, with sig null. A larger one gives the pairs of its
    first name, the centre, and for each member a row of its sig, the member and the centre. No more
    than SMALL_GROUP names are kept from one batch to the next.
    """
    tail_sig, tail_name, large = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def of_groups(sig: np.ndarray, name: np.ndarray, large: bool) -> Iterator[pd.DataFrame]:
        """``large``: the first name is the centre of a large group, and was given before."""
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(starts, len(sig)))
        pairs = []
        many = sizes > SMALL_GROUP
        many[0] |= large
        for n in range(2, SMALL_GROUP + 1):
            own = starts[(sizes == n) & ~many]
            pairs += [(name[own + i], name[own + j]) for i, j in combinations(range(n), 2)] if len(own) else []
        at = ranges(starts[many], sizes[many])
        centre = np.repeat(name[starts[many]], sizes[many])
        given = at != 0 if large else np.ones(len(at), bool)
        star = name[at] != centre
        pairs.append((name[at][star], centre[star]))
        a, b = np.concatenate([p for p, _ in pairs]), np.concatenate([p for _, p in pairs])
        both = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        yield both.assign(sig=pd.array([None] * len(both), "Int64"))[["sig", "a", "b"]]
        yield pd.DataFrame({"sig": pd.array(sig[at][given], "Int64"), "a": name[at][given], "b": centre[given]})

    for batch in batches:
        sig, name = np.concatenate([tail_sig, batch["sig"].to_numpy()]), np.concatenate([tail_name, batch["name"].to_numpy()])
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])
        sig, name = sig[new], name[new]
        last = int(np.searchsorted(sig == sig[-1], True)) if sig[0] != sig[-1] else 0
        ends_large = len(sig) - last > SMALL_GROUP or (large and not last)
        done = len(sig) if ends_large else last
        if done:
            yield from of_groups(sig[:done], name[:done], large)
        # Of a large group that goes on the centre stays; names come in order, so that the last one tells repeats.
        keep = [last, len(sig) - 1] if ends_large and len(sig) - 1 > last else [last] if ends_large else list(range(last, len(sig)))
        tail_sig, tail_name, large = sig[keep], name[keep], ends_large
    if len(tail_sig) and not large:
        yield from of_groups(tail_sig, tail_name, False)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least number of features in which sets differ, from their histograms."""
    return np.abs(x.astype(np.int16) - y).sum(axis=-1, dtype=np.int32)


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    # union >= (n + m + differ) / 2 and intersection <= (n + m - differ) / 2
    return 100 * (n + m - differ) >= PERCENT * (n + m + differ)


def histograms(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, HISTOGRAM)


def open_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that sizes and histograms don't refute, and how far these are apart."""
    for b in batches:
        differ = apart(histograms(b["hist_a"]), histograms(b["hist_b"])) if len(b) else np.zeros(0, np.int32)
        ok = may_link(b["n_a"].to_numpy(), b["n_b"].to_numpy(), differ)
        yield b[["a", "b"]].assign(apart=differ)[ok]


def features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for b in chunks(batches):
        features, bounds = shingle_sets(list(b["_text"]), hashes)
        held = [features[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pd.DataFrame({"set": [set_id(x) for x in held], "features": [x.tobytes() for x in held]})


def link(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = np.count_nonzero(both[1:] == both[:-1])
    return 100 * shared >= PERCENT * (len(both) - shared)


def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [link(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(b["features_a"], b["features_b"], strict=True)]
        yield b.loc[np.array(ok, bool), ["a", "b"]]


def with_features(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (set, first_id and more) with features, one row for each row with that id and set; only texts of first ids are read."""
    ids = maybe_broadcast(wanted.select(F.col("first_id").alias("_first")).distinct(), IDS_TO_BROADCAST)
    near = docs.join(ids, F.col("_id").eqNullSafe(F.col("_first")), "left_semi").select("_text")
    return near.mapInPandas(lean(features_of), "set binary, features binary").join(maybe_broadcast(wanted.drop("first_id"), IDS_TO_BROADCAST), "set")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that link, out of distinct pairs (a, b) of numbers."""
    wanted = pairs.select(F.col("a").alias("num")).union(pairs.select("b")).distinct().join(sets.select("num", "set", "first_id"), "num")
    held = stored(with_features(stored(wanted, "join-wanted"), docs).select("num", "features"), "join-features")
    side = lambda x: held.select(F.col("num").alias(x), F.col("features").alias(f"features_{x}"))
    return stored(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(lean(linked), "a long, b long").distinct(), "join-links")


def not_refuted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, apart) of numbers from (a, b) of names."""
    side = lambda x: sets.select(F.col("name").alias(x), F.col("num").alias(f"num_{x}"), F.col("n").alias(f"n_{x}"), F.col("hist").alias(f"hist_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b").withColumnsRenamed({"num_a": "a", "num_b": "b"})
    return stored(both.mapInPandas(open_pairs, "a long, b long, apart int"), "join-open")


def with_components(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of the set in ``column``: itself, if it has no link."""
    return rows.join(labels.select(F.col("v").alias(column), F.col("comp").alias(f"_{name}")), column, "left").withColumn(name, F.coalesce(f"_{name}", column)).drop(f"_{name}")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that join two components."""
    both = with_components(with_components(pairs, labels, "a", "comp_a"), labels, "b", "comp_b")
    return stored(both.where("comp_a <> comp_b").select(*pairs.columns), "join-across")


def nearest(pairs: DataFrame) -> DataFrame:
    """For each set the pair that is least apart."""
    ends = pairs.select(F.col("a").alias("x"), F.struct("apart", "a", "b").alias("p")).union(pairs.select("b", F.struct("apart", "a", "b")))
    return stored(ends.groupBy("x").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct(), "join-nearest")


def several(rows: DataFrame, key: str) -> DataFrame:
    """The rows of (key, comp) whose key has several components."""
    open_ = rows.groupBy(key).agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select(key)
    return stored(rows.join(stored(open_, "join-several"), key, "left_semi"), "join-left")


def hidden(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets (num, features) with too many signatures in open groups; ``large_0`` and ``large_1`` count these by instance."""
    bands = Bands()
    for b in batches:
        ok = []
        for features, *large in zip(b["features"], b["large_0"], b["large_1"], strict=True):
            own = Signatures(np.frombuffer(features, U), np.array([0, len(features) // 8]), bands)
            ok.append(any(large[bit] > max(spare, 0) for bit, spare in zip(own.bit.tolist(), own.spare.tolist(), strict=True)))
        yield b.loc[np.array(ok, bool), ["num", "features"]]


def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for num, features in zip(b["num"], b["features"], strict=True):
            yield pd.DataFrame({"num": num, "feature": np.frombuffer(features, np.int64)})


def root(up: dict[int, int], x: int) -> int:
    while up.get(x, x) != x:
        up[x] = x = up.get(up[x], up[x])
    return x


def links_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that join components, from rows in which the sets of two blocks to compare are neighbours; no more than there are sets."""
    key, held = None, []

    def links() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        rows = rows.assign(n=rows["features"].str.len() // 8).sort_values("n", kind="stable")
        n, num, second = rows["n"].to_numpy(), rows["num"].to_numpy(), rows["second"].to_numpy()
        comps, comp = np.unique(rows["comp"].to_numpy(), return_inverse=True)
        features = [np.frombuffer(x, U) for x in rows["features"]]
        hist = np.array([np.bincount((x & U(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM) for x in features]).astype(np.int16)
        one = key[1] == key[2]
        up: dict[int, int] = {}
        found = []
        for x in np.flatnonzero(~second):
            low, high = np.searchsorted(n, -(-PERCENT * n[x] // 100), "left"), np.searchsorted(n, 100 * n[x] // PERCENT, "right")
            other = low + np.flatnonzero((comp[low:high] != comp[x]) & ((num[low:high] > num[x]) if one else second[low:high]))
            for y in other[may_link(n[x], n[other], apart(hist[x], hist[other]))].tolist():
                a, b = root(up, int(comp[x])), root(up, int(comp[y]))
                if a != b and link(features[x], features[y]):
                    up[a] = b
                    found.append((min(num[x], num[y]), max(num[x], num[y])))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    for b in batches:
        keys = b[["family", "low", "high"]].to_numpy()
        for a, z in edges(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(b)):
            if tuple(keys[a]) != key:
                if held:
                    yield links()
                key, held = tuple(keys[a]), []
            held.append(b.iloc[a:z])
    if held:
        yield links()


def links_of_rest(rest: DataFrame, poor: DataFrame) -> DataFrame:
    """Links (a, b) across components out of (family, num, comp): sets of a family are compared with each other, block by block."""
    rest = rest.join(poor.select("num", (F.length("features") / 8).alias("n")), "num")
    rest = stored(rest, "join-rest")
    count = stored(rest.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_FEATURES).cast("int").alias("blocks")), "join-blocks")
    own = F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")
    dealt = rest.join(maybe_broadcast(count, IDS_TO_BROADCAST), "family").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "num", "comp")
    dealt = dealt.join(poor, "num").repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    return dealt.mapInPandas(links_of_blocks, "a long, b long")


def links_hidden(members: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links (a, b) of numbers, enough to join components, that large groups hide; None if there are none. ``members``: (sig, name, centre)."""
    numbers = lambda c, to: sets.select(F.col("name").alias(c), F.col("num").alias(to))
    named_ = members.join(numbers("name", "num"), "name").join(numbers("centre", "centre_num"), "centre").select("sig", "num", "centre_num")
    # Groups of centres in one component are a family.
    labelled = with_components(with_components(named_, labels, "num", "comp"), labels, "centre_num", "family").drop("centre_num")
    left = several(labelled, "family")
    if left.isEmpty():
        return None
    of_bit = lambda bit: F.count_distinct(F.when(F.col("sig").bitwiseAND(1) == bit, F.col("sig"))).alias(f"large_{bit}")
    large = stored(left.groupBy("num").agg(of_bit(0), of_bit(1)).join(sets.select("num", "set", "first_id"), "num"), "join-large")
    near = stored(with_features(large, docs), "join-near")  # on its own, so that no task has two Python workers
    poor = stored(near.mapInPandas(lean(hidden), "num long, features binary").dropDuplicates(["num"]), "join-poor")

    features = poor.mapInPandas(exploded, "num long, feature long")
    holders = stored(features.groupBy("feature").agg(F.count("*").alias("holders")).where(F.col("holders") <= COMMON), "join-holders")
    few = features.join(holders, "feature").groupBy("num").agg(F.count("*").alias("few"), F.array_sort(F.collect_list(F.when(F.col("holders") > 1, F.struct("holders", "feature")))).alias("rare"))
    # floor((100 - PERCENT) n / 100) + 1 features of a set: one of them is in each set it links to.
    need = F.floor((100 - PERCENT) * F.length("features") / 800) + 1
    lone = F.col("few") - F.size("rare")
    ranked = poor.join(few.where("few > 0"), "num").where(F.col("few") >= need).select("num", F.slice("rare", F.lit(1), F.greatest(F.lit(0), need - lone).cast("int")).alias("rare"))
    ranked = stored(ranked, "join-ranked")
    asked = stored(ranked.select(F.col("num").alias("x"), F.explode("rare.feature").alias("feature")), "join-asked")
    met = features.select("feature", F.col("num").alias("y")).join(maybe_broadcast(asked, IDS_TO_BROADCAST), "feature").where("x <> y")
    found = across(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), labels)

    rest = left.join(poor.select("num"), "num", "left_semi").join(ranked.select("num"), "num", "left_anti").select("family", "num", "comp").distinct()
    return stored(verified(found, sets, docs).union(links_of_rest(several(rest, "family"), poor)).distinct(), "join-hidden")


def neighbours(sigs: DataFrame) -> DataFrame:
    """``sigs`` (sig, name) with equal ones side by side."""
    return sigs.repartition("sig").sortWithinPartitions("sig", "name")


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, set (class of equal sets), component_id and text_md5."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = stored(rows.mapInPandas(lean(described), f"_id {kind}, key binary, set binary, n long, hist binary"), "join-rows")
    classes = known.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("hist").alias("hist"), F.count("*").alias("copies"), F.min("_id").alias("first_id"))
    name = F.conv(F.hex(F.substring("set", 1, 8)), 16, -10).cast("long")
    sets = stored(classes.withColumns({"num": F.monotonically_increasing_id(), "name": name}), "join-sets")
    least = max(HOT_LEAST, HOT_SHARE * known.count())
    hot = {bytes(r["set"]): r["first_id"] for r in sets.where(F.col("copies") >= least).select("set", "first_id").toLocalIterator()}

    found = stored(neighbours(rows.mapInPandas(lean(signed(hot)), "sig long, name long")).mapInPandas(lean(pairs_of_runs), "sig long, a long, b long").distinct(), "join-found")
    pairs = not_refuted(found.where("sig IS NULL").select("a", "b"), sets)
    links = verified(nearest(pairs), sets, rows)
    labels = connected_components(links)
    more = across(pairs.select("a", "b"), labels)
    if not more.isEmpty():
        links = stored(links.union(verified(more, sets, rows)), "join-links")
        labels = connected_components(links)
    hidden_ = links_hidden(found.where("sig IS NOT NULL").select("sig", F.col("a").alias("name"), F.col("b").alias("centre")), labels, sets, rows)
    if hidden_ is not None and not hidden_.isEmpty():
        labels = connected_components(links.union(hidden_))

    comps = with_components(sets.select("set", "num", "first_id"), labels, "num", "comp")
    lows = stored(comps.groupBy("comp").agg(F.min("first_id").alias("component_id")), "join-lows")
    of_set = stored(comps.join(lows, "comp").select("set", "component_id"), "join-sets-done")
    return known.select("_id", "key", "n", "set").join(of_set, "set", "left").select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("set")).alias("set"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
        F.col("key").alias("text_md5"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the one with the smallest id.

    Of rows that repeat an id and a set of features one of them stays.
    """
    found = similarity_join(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    found = stored(found.select(F.col(id_col).alias("_id"), F.col("text_md5").alias("_md5"), F.col("set").alias("_set")), "join-kept")
    own = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = docs.select(whole_row(docs).alias("_row"), F.col(id_col).alias("_own"), own.alias("_key"))
    both = rows.join(found.distinct(), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_md5")))
    if found.groupBy("_id").count().where("count > 1").isEmpty():
        return both.select("_row.*")  # no id is repeated, so every row found stays
    # Texts without features are no copies of each other unless they are equal.
    return both.groupBy("_own", "_set", F.when(F.col("_set").isNull(), F.col("_key"))).agg(one_row("_row").alias("_row")).select("_row.*")
