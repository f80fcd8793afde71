"""Importance resampling towards a target distribution, with exact ranks.

Method: a document's features (runs of words) fall into hashed buckets; the gain of a
bucket says how much likelier it is in the target than in the documents; the gains are
one array, and a document's weight is their mean over its features. Weights get Gumbel
noise from a hash of the id. The eligible rows of each partition are sorted into a run,
runs are cut into blocks at the bounds of ranges, and each range is merged by tournament
trees that hold one open block of a run at a time and stop after the exact number
of draws. Ranks follow from the numbers of rows in the ranges before.

Defined results: a null or empty text has no features and weight 0. Ids are integers; a
null id is drawn as the text ``null`` and comes last among equal scores. Rows with equal
score and id rank by their number of features; rows that agree in that too are
interchangeable. Every row of ``docs`` gives one row, repeated ones too. Long texts are
read whole. An empty table gives an empty result, and an empty target leaves only the
documents' own counts to the gains. Only id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, stored

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: A-Z to a-z; digits, a-z and all bytes of code points from U+0080 stay; all else parts words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Distinct features whose buckets a task remembers.
REMEMBERED = 500_000
#: Rows of a block of a run, rows of a range that is merged on its own, ranges at most, and sampled rows a range.
BLOCK = 1024
RANGE_ROWS = 50_000
MOST_RANGES = 2000
SAMPLES = 20


class Buckets(dict):
    """Bucket of each feature, computed once while it is remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) % self.buckets
        return bucket


def feature_reader(grams: tuple[int, int], buckets: int) -> Callable[[str | None], tuple[int, np.ndarray]]:
    """A function from a text to its number of words and the buckets of its features."""
    known = Buckets(buckets)

    def read(text: str | None) -> tuple[int, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
        parts = [words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(grams[0], grams[1] + 1)]
        return len(words), np.concatenate([np.fromiter(map(known.__getitem__, p), np.uint32, len(p)) for p in parts])

    return read


def features(docs: DataFrame, id_col: str, text_col: str, grams: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets): buckets are little-endian integers, one a feature, 16 bits if they suffice."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = feature_reader(grams, buckets)
        for b in batches:
            found = [read(x) for x in b["_text"]]
            yield pd.DataFrame({"id": b["id"], "n_words": [n for n, _ in found], "n_features": [len(x) for _, x in found], "buckets": [x.astype(kind).tobytes() for _, x in found]})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInPandas(lean(run), "id long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: ``buckets`` numbers, whatever the input's size."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b["buckets"]:
                total += np.bincount(np.frombuffer(x, kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    out = np.zeros(buckets, np.int64)
    for row in found.select("buckets").mapInPandas(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of each bucket's smoothed shares in target and documents, floored."""
    size, s_all, t_all = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((int(t) + 1) * (s_all + size)) / ((int(s) + 1) * (t_all + size)))) for s, t in zip(own, target, strict=True)], np.int64)


def scored(found: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """``found`` of ``features`` as id, n_words, n_features, weight and score."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = [int(gain[np.frombuffer(x, kind)].sum()) // max(len(x) // np.dtype(kind).itemsize, 1) for x in b["buckets"]]
            yield b[["id", "n_words", "n_features"]].assign(weight=sums)

    weighted = found.mapInPandas(lean(run), "id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", (F.col("weight") + noise).cast("long"))


class TournamentTree:
    """Finds the smallest of the keys of many slots; a changed key replays its way to the root only."""

    EMPTY = (math.inf,)

    def __init__(self, slots: int = 4):
        self.size = slots
        self.keys = [self.EMPTY] * slots
        self.free = list(range(slots))
        self.winner = [0] * slots + list(range(slots))
        for i in range(slots - 1, 0, -1):
            self.winner[i] = self.winner[2 * i]

    def best(self) -> tuple[int, tuple]:
        """The slot that wins, and its key; EMPTY if no slot has a key."""
        slot = self.winner[1]
        return slot, self.keys[slot]

    def set(self, slot: int, key: tuple) -> None:
        self.keys[slot] = key
        i = (slot + self.size) // 2
        while i:
            a, b = self.winner[2 * i], self.winner[2 * i + 1]
            self.winner[i] = a if self.keys[a] <= self.keys[b] else b
            i //= 2

    def enter(self, key: tuple) -> int:
        """Take a free slot for ``key``, with twice the slots if none is free."""
        if not self.free:
            old = self.keys
            self.__init__(2 * self.size)
            self.free = self.free[len(old) :]
            for slot, k in enumerate(old):
                self.set(slot, k)
        slot = self.free.pop()
        self.set(slot, key)
        return slot

    def leave(self, slot: int) -> None:
        self.set(slot, self.EMPTY)
        self.free.append(slot)


#: The order of a merge: high scores first, ties to smaller ids, null last; the rest tells equal rows apart.
KEY = ("neg", "is_null", "ident", "n_features", "run", "pos")
ENTRY = np.dtype([(c, "<i8") for c in (*KEY, "n_words", "weight")])
BLOCK_SCHEMA = "range int, rows long, " + ", ".join(f"{c} long" for c in KEY) + ", entries binary"
OUT_SCHEMA = "id long, n_words long, n_features long, weight long, score long, rank long"


def run_blocks(bounds: list[tuple]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From the sorted rows of a run: its blocks, cut at the bounds of ranges, with their first keys."""

    def range_of(entries: np.ndarray) -> np.ndarray:
        # Entries from a bound on are in a later range than those before it.
        at = np.zeros(len(entries), np.int64)
        for bound in bounds:
            less, same = np.zeros(len(entries), bool), np.ones(len(entries), bool)
            for c, v in zip(KEY, bound, strict=True):
                less |= same & (entries[c] < v)
                same &= entries[c] == v
            if less.all():
                break
            at += ~less
        return at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            entries = np.zeros(len(b), ENTRY)
            for c in ENTRY.names:
                entries[c] = b[c]
            at = range_of(entries)
            # A batch may hold the end of a run and the start of another.
            cuts = [0, *(np.flatnonzero(np.diff(at) | np.diff(entries["run"])) + 1), len(b)]
            spans = [(x, min(x + BLOCK, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False) for x in range(lo, hi, BLOCK)]
            yield pd.DataFrame({"range": [int(at[lo]) for lo, _ in spans], "rows": [hi - lo for lo, hi in spans]} | {c: [int(entries[c][lo]) for lo, _ in spans] for c in KEY} | {"entries": [entries[lo:hi].tobytes() for lo, hi in spans]})

    return run


class Waiting:
    """The blocks that come, seen one ahead: the next one's range (None at the end) and first key."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        self.source = ((r, first, data) for b in batches for r, first, data in zip(b["range"], zip(*[b[c] for c in KEY], strict=True), b["entries"], strict=True))
        self.step()

    def step(self) -> None:
        self.range, self.first, self.data = next(self.source, (None, None, None))

    def take(self) -> list[tuple]:
        entries = np.frombuffer(self.data, ENTRY).tolist()
        self.step()
        return entries


def merge_blocks(before: dict[int, int], draws: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Merge blocks that come ordered by range and first key; rows past the number of draws get no rank."""

    def rows(entries: list[tuple], first: int | None) -> pd.DataFrame:
        of = pd.DataFrame(entries, columns=list(ENTRY.names))
        rank = pd.Series(range(first, first + len(of)), dtype="Int64") if first is not None else pd.Series([None] * len(of), dtype="Int64")
        return pd.DataFrame({"id": of["ident"].astype("Int64").mask(of["is_null"] == 1), "n_words": of["n_words"], "n_features": of["n_features"], "weight": of["weight"], "score": -of["neg"], "rank": rank})

    def merged(blocks: Waiting, number: int) -> Iterator[pd.DataFrame]:
        """One range, whose first block waits."""
        tree, held, at, out = TournamentTree(), {}, before[number] + 1, []
        first = at
        while at <= draws:
            # A block is opened before a row is taken that might come after its first.
            while blocks.range == number and blocks.first <= tree.best()[1]:
                entries = blocks.take()
                held[slot := tree.enter(entries[0][: len(KEY)])] = [entries, 0]
            slot, key = tree.best()
            if key is TournamentTree.EMPTY:
                break
            entries, i = held[slot]
            out.append(entries[i])
            at += 1
            if i + 1 < len(entries):
                held[slot][1] = i + 1
                tree.set(slot, entries[i + 1][: len(KEY)])
            else:
                del held[slot]
                tree.leave(slot)
            if len(out) >= BLOCK:
                yield rows(out, first)
                first, out = at, []
        if out:
            yield rows(out, first)
        # After the last draw nothing is merged any more; what is left has no rank.
        for entries, i in held.values():
            yield rows(entries[i:], None)
        while blocks.range == number:
            yield rows(blocks.take(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Waiting(batches)
        while blocks.range is not None:
            yield from merged(blocks, blocks.range)

    return run


def draw(rows: DataFrame, draws: int, eligible: str) -> DataFrame:
    """``rows`` of ``scored`` with rank: 1, 2, 3 ... for the ``draws`` best rows that are ``eligible``, else null."""
    spark = rows.sparkSession
    unranked = rows.withColumn("rank", F.lit(None).cast("long"))
    if draws < 1:
        return unranked
    # Scores are whole numbers in a span that gains and a 32-bit draw bound, whatever the number of rows.
    levels = sorted(((r["score"], r["n"]) for r in rows.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    total = cut = 0
    for score, n in levels:
        total, cut = total + n, score
        if total >= draws:
            break
    in_play = F.expr(eligible) & (F.col("score") >= cut)
    runs = (
        rows.where(in_play)
        .withColumns({"neg": -F.col("score"), "is_null": F.col("id").isNull().cast("long"), "ident": F.coalesce("id", F.lit(0)), "run": F.spark_partition_id().cast("long")})
        .sortWithinPartitions("neg", "is_null", "ident", "n_features")
        .withColumn("pos", F.monotonically_increasing_id())
        .select(*ENTRY.names)
    )
    runs = stored(runs, "importance-runs")
    parts = min(MOST_RANGES, -(-total // RANGE_ROWS))
    # Sampled rows only say where ranges end; each row is merged wherever it falls.
    step = max(1, total // (parts * SAMPLES))
    sample = sorted(tuple(r) for r in runs.where(F.pmod(F.xxhash64("run", "pos"), F.lit(step)) == 0).select(*KEY).collect()) if parts > 1 else []
    bounds = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    blocks = stored(runs.mapInPandas(lean(run_blocks(bounds)), BLOCK_SCHEMA), "importance-blocks")
    before, at = {}, 0
    for r in sorted(blocks.groupBy("range").agg(F.sum("rows").alias("n")).collect()):
        before[r["range"]], at = at, at + r["n"]
    dealt = blocks.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "range").sortWithinPartitions("range", *KEY).drop("rows")
    return unranked.where(~in_play).unionByName(dealt.mapInPandas(lean(merge_blocks(before, draws)), OUT_SCHEMA))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", grams: tuple[int, int] = (1, 1),
    buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: float = PERCENT, seed: str = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): the rank of ``percent`` of the rows of ``docs`` with at least ``min_words`` words."""
    found = stored(features(docs, id_col, text_col, grams, buckets), "importance-features")
    wanted = features(target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text", grams, buckets)
    rows = stored(scored(found, gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets)), seed), "importance-scores")
    eligible = f"n_words >= {min_words}"
    return draw(rows, int(percent * rows.where(eligible).count() // 100), eligible)
