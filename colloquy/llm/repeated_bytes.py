"""Removal of repeated byte strings by window minima and hashes of growing length.

Task: every byte that is covered by a string of LENGTH bytes which also starts
anywhere else, in the same document or another, is removed.

Method: positions are ranked by the bytes that follow them, at lengths that grow
from GRAM towards LENGTH, and Spark groups equal ranks; a position whose rank
is unique leaves, because a string that begins or holds it can't repeat. To
rank few positions at first, each window of LENGTH bytes is represented by its
leftmost smallest GRAM (by hash), which equal windows share; about one position
in 70 represents a run of windows. The rounds are:

1. Rank GRAM bytes at each representative. Unique ones leave.
2. Rank (GRAM and as much to the left, GRAM and as much to the right) so that
   each window holds one of the two. A position with both unique leaves.
3. Rank the whole run (from the start of its first window to the end of its
   last). A run that repeats as a whole is settled: all its windows repeat. So
   the inside of long repeats costs one row a run.
4. Rank the single windows of one run of each kind left, at full LENGTH.

Ranks are 128-bit hashes of the bytes (64 bits in rounds 1 and 2, which only exclude).

Defined results: a null text counts as empty. Text is UTF-8 bytes. Rows that repeat a
text count as occurrences of their own, so all windows of repeated texts of LENGTH
bytes or more go. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, small_enough, stored

LENGTH = 200
GRAM = 64
#: Bytes on one side in round 2: each window has this many on one side of its GRAM.
SIDE = (LENGTH - GRAM) // 2
#: Ranks (8 bytes each) that round 1 sends to all executors at most, and runs
#: (about 20 bytes each) that round 4 does; more are joined by a shuffle.
RANKS_TO_BROADCAST = 2_000_000
RUNS_TO_BROADCAST = 2_000_000
#: Kinds of runs (16 bytes each) that are sent to all executors at most.
KINDS_TO_BROADCAST = 1_500_000
ROWS_PER_BATCH = 50_000
#: Bytes of text that are looked at in one piece; pieces overlap by a window.
PIECE = 1 << 20

U = np.uint64
BYTE_RANKS = np.random.RandomState(7).randint(0, 1 << 63, 256, dtype=np.int64).astype(U)
FACTORS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_key(data: bytes) -> int:
    """64 bits that, with the id, tell rows of one id apart if their texts differ."""
    return int.from_bytes(hashlib.md5(data).digest()[:8], "big", signed=True)


def name(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "little", signed=True)


def gram_ranks(data: np.ndarray) -> np.ndarray:
    """Ranks of the GRAM bytes from each position, by doubling: 1, 2, 4, ..."""
    ranks, width = BYTE_RANKS[data], 1
    for factor in FACTORS:
        ranks = ranks[: len(ranks) - width] * factor + ranks[width:]
        ranks ^= ranks >> U(29)
        width *= 2
    return ranks * FACTORS[0]


def leftmost_smallest(ranks: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest rank of every ``width`` consecutive ones."""
    at, low, span = np.arange(len(ranks), dtype=np.int32), ranks, 1
    while span < width:
        step = min(span, width - span)
        right = low[step:] < low[: len(low) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.where(right, low[step:], low[: len(low) - step])
        span += step
    return at


def window_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Representatives of all windows: gram rank, position, first and last window of the run."""
    found = []
    for start in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
        ranks = gram_ranks(np.frombuffer(data, np.uint8, min(len(data) - start, PIECE + LENGTH - 1), start))
        at = leftmost_smallest(ranks, LENGTH - GRAM + 1)
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([edge[1:], [len(at)]]) - 1
        found.append((ranks[at[edge]].view(np.int64), at[edge].astype(np.int64) + start, edge + start, last + start))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def round_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        held, n = [], 0
        for text in b["_text"]:
            held.append(window_runs(text_bytes(text))[0])
            n += len(held[-1])
            if n >= ROWS_PER_BATCH:
                yield pd.DataFrame({"gram": np.concatenate(held)})
                held, n = [], 0
        if held:
            yield pd.DataFrame({"gram": np.concatenate(held)})


RUN = ["gram", "_id", "key", "pos", "first", "last", "left", "right", "run_a", "run_b"]


def runs_of_texts(again: np.ndarray | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The runs of each text, with the ranks of rounds 2 and 3; only those whose gram is in ``again``, if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ident, text in zip(b["_id"], b["_text"], strict=True):
                data = text_bytes(text)
                found = window_runs(data)
                if again is not None and len(found[0]) and len(again):
                    near = np.minimum(np.searchsorted(again, found[0]), len(again) - 1)
                    found = tuple(x[again[near] == found[0]] for x in found)
                key = text_key(data) if len(found[0]) else 0
                for gram, at, first, last in zip(*(x.tolist() for x in found), strict=True):
                    left = name(data[at - SIDE : at + GRAM]) if at - first >= SIDE else None
                    right = name(data[at : at + GRAM + SIDE]) if at - last < SIDE else None
                    whole = xxhash.xxh3_128_digest(data[first : last + LENGTH] + (at - first).to_bytes(2, "little"))
                    rows.append((gram, ident, key, at, first, last, left, right, int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)))
                if len(rows) >= ROWS_PER_BATCH:
                    yield run_frame(rows)
                    rows = []
            if rows:
                yield run_frame(rows)

    return run


def run_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=RUN)
    return frame.assign(**{c: pd.array([r[RUN.index(c)] for r in rows], "Int64") for c in ("left", "right")})


def single_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Round 4: the rank of each window of the listed runs, and where it starts."""
    for b in batches:
        ranks: list[bytes] = []
        numbers, starts = [], []

        def frame() -> pd.DataFrame:
            both = np.frombuffer(b"".join(ranks), np.int64).reshape(-1, 2)  # noqa: B023
            return pd.DataFrame({"rank_a": both[:, 0], "rank_b": both[:, 1], "number": np.concatenate(numbers or [[]]).astype(np.int64), "start": np.concatenate(starts or [[]]).astype(np.int32)})  # noqa: B023

        for number, text, runs in zip(b["number"], b["_text"], b["runs"], strict=True):
            data = text_bytes(text)
            for run in runs:
                # Windows that hold the left part start SIDE or more before the gram.
                turn = run["pos"] - SIDE + 1
                a = run["first"] if run["by_left"] else max(turn, run["first"])
                z = run["last"] + 1 if run["by_right"] else min(turn, run["last"] + 1)
                ranks += [xxhash.xxh3_128_digest(data[s : s + LENGTH]) for s in range(a, z)]
                starts.append(np.arange(a, z))
                numbers.append(np.full(max(z - a, 0), number))
            if len(ranks) >= ROWS_PER_BATCH:
                yield frame()
                ranks, numbers, starts = [], [], []
        yield frame()


def repeated_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by rank whose rank has a neighbour; the last row of a batch waits for the next batch."""
    held = None
    for b in batches:
        waits = held is not None
        if waits:
            b = pd.concat([held[0], b], ignore_index=True)
        a, c = b["rank_a"].to_numpy(), b["rank_b"].to_numpy()
        next_ = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
        twice = np.concatenate([next_, [False]]) | np.concatenate([[False], next_])
        if waits:
            twice[0] |= held[1]
        held = (b.iloc[-1:], bool(twice[-1]))
        yield b.loc[twice & (np.arange(len(b)) < len(b) - 1), ["number", "start"]]
    if held and held[1]:
        yield held[0][["number", "start"]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; runs that touch are one."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def joined(of: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Spans (of, start, end), those that touch and stand side by side as one; a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                new = np.ones(len(b), bool)
                start, end = b["start"].to_numpy(), b["end"].to_numpy()
                new[1:] = (start[1:] < start[:-1]) | (start[1:] > end[:-1])
                for c in of:
                    own = b[c].to_numpy()
                    new[1:] |= own[1:] != own[:-1]
                at = np.flatnonzero(new)
                yield b.iloc[at].assign(end=np.maximum.reduceat(end, at))[[*of, "start", "end"]]

    return run


def cut(id_kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ident, text, found in zip(b["_id"], b["_text"], b["spans"], strict=True):
                data = text_bytes(text)
                spans = merged([(x["start"], x["end"]) for x in found]) if found is not None else []
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((ident, len(data), len(data) - len(kept), spans, kept))
            yield pd.DataFrame(rows, columns=["_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(_id, key, spans) of the rows of ``texts`` (_id, _text) that hold repeats."""
    kind = texts.schema["_id"].dataType.simpleString()
    again = stored(texts.select("_text").mapInPandas(round_one, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeat-grams")
    schema = f"gram long, _id {kind}, key long, pos int, first int, last int, left long, right long, run_a long, run_b long"
    if small_enough(again, RANKS_TO_BROADCAST):
        found = texts.mapInPandas(runs_of_texts(np.sort(again.toArrow().column("gram").to_numpy())), schema)
    else:
        found = texts.mapInPandas(runs_of_texts(None), schema).join(again, "gram", "left_semi")
    runs = stored(found.drop("gram"), "repeat-runs")

    run = ["run_a", "run_b"]
    kinds = stored(
        runs.groupBy(*run).agg(F.count("*").alias("n"), F.min(F.struct("_id", "key", "pos", "first", "last")).alias("at"), F.first("left").alias("left"), F.first("right").alias("right")),
        "repeat-kinds",
    )
    whole = maybe_broadcast(stored(kinds.where("n > 1").select(*run), "repeat-settled"), KINDS_TO_BROADCAST)
    settled = runs.join(whole, run, "left_semi").select("_id", "key", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    # Runs are stored text by text, so that neighbours are mostly side by side.
    settled = settled.mapInPandas(joined(["_id", "key"]), f"_id {kind}, key long, start int, end int")

    shared = lambda side: kinds.where(F.col(side).isNotNull()).groupBy(side).agg(F.count("*").alias("k")).where("k > 1").select(side, F.lit(True).alias(f"by_{side}"))
    open_ = kinds.join(stored(shared("left"), "repeat-left"), "left", "left").join(stored(shared("right"), "repeat-right"), "right", "left").where("by_left OR by_right")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    flat = stored(open_.select("at.*", flag("by_left"), flag("by_right")), "repeat-open")
    listed = stored(
        flat.groupBy("_id", "key").agg(F.collect_list(F.struct("pos", "first", "last", "by_left", "by_right")).alias("runs")).withColumn("number", F.monotonically_increasing_id()), "repeat-listed"
    )
    few = F.broadcast(listed) if small_enough(flat, RUNS_TO_BROADCAST) else listed
    windows = keyed(texts).join(few.withColumnsRenamed({"_id": "_i", "key": "_k"}), same_row("_i", "_k")).select("number", "_text", "runs")
    ranked = windows.mapInPandas(single_windows, "rank_a long, rank_b long, number long, start int")
    twice = ranked.repartition("rank_a", "rank_b").sortWithinPartitions("rank_a", "rank_b").mapInPandas(repeated_windows, "number long, start int")
    spans = stored(twice, "repeat-windows").repartition("number").sortWithinPartitions("number", "start").withColumn("end", F.col("start") + LENGTH)
    spans = stored(spans.mapInPandas(joined(["number"]), "number long, start int, end int"), "repeat-single")
    single = spans.join(listed.select("number", "_id", "key"), "number").select("_id", "key", "start", "end")
    return settled.union(single).groupBy("_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with text_key as a column."""
    digest = F.substring(F.md5(F.coalesce("_text", F.lit("")).cast("binary")), 1, 16)
    high, low = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return rows.withColumn("key", F.shiftleft(high, 32).bitwiseOR(low))


def same_row(ident: str, key: str) -> Column:
    return F.col("_id").eqNullSafe(F.col(ident)) & (F.col("key") == F.col(key))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, spans (start, end in bytes) and kept (bytes)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    spans = stored(repeated_spans(rows), "repeat-spans").withColumnsRenamed({"_id": "_i", "key": "_k"})
    return (
        keyed(rows)
        .join(spans, same_row("_i", "_k"), "left")
        .select("_id", "_text", "spans")
        .mapInPandas(cut(kind), f"_id {kind}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
        .withColumnRenamed("_id", id_col)
    )
