"""Importance resampling, line dedup and spelling variants, held against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.llm import importance, spelling
from colloquy.llm.line_dedup import dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams_of(text, grams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(words) - n + 1)]


def ranked(rows, target, grams=(1, 1), buckets=10_000, min_words=20, percent=10):
    """(id, n_features, weight, score, rank) of every row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, aim = Counter(), Counter()
    for _, text, *_ in rows:
        own.update(map(bucket, grams_of(text, grams)[1]))
    for text in target:
        aim.update(map(bucket, grams_of(text, grams)[1]))
    s_all, t_all = own.total(), aim.total()
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets))))
    out = []
    for doc, text, *_ in rows:
        words, found = grams_of(text, grams)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def drawn(df):
    return Counter((r["id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("grams", "percent"), [((1, 1), 10), ((1, 2), 60), ((1, 1), 100)])
def test_resampling(spark, docs, rows, grams, percent):
    target = ["alpha Beta gamma theta, 22", None, "", "kappa kappa"]
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, id string")
    assert drawn(importance.resample(docs, aim, grams=grams, percent=percent)) == ranked(rows, target, grams, percent=percent)


def test_resampling_of_empty_tables(spark, docs, rows, none):
    aim = spark.createDataFrame([], "text string")
    assert drawn(importance.resample(docs, aim)) == ranked(rows, [])
    assert importance.resample(none, docs).count() == 0


def test_merge_of_many_ranges_and_ties(spark, monkeypatch):
    """Small blocks and ranges; a third of all rows has one score and one id."""
    monkeypatch.setattr(importance, "RANGE_ROWS", 100)
    monkeypatch.setattr(importance, "BLOCK", 7)
    r = random.Random(4)
    rows = [(None if i % 3 == 0 else i, 30, 30, 1, 500 if i % 3 == 0 else r.randint(0, 900)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long").repartition(9)
    got = importance.draw(df, 1700, "n_words >= 20").collect()
    order = sorted(rows, key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    assert sorted((x["rank"], x["id"], x["score"]) for x in got if x["rank"]) == [(k + 1, x[0], x[4]) for k, x in enumerate(order[:1700])]
    assert Counter(tuple(x)[:5] for x in got) == Counter(rows)


def test_tournament_tree():
    r = random.Random(1)
    tree, held, out = importance.TournamentTree(2), {}, []
    runs = [sorted(r.sample(range(10_000), 40)) for _ in range(37)]
    for run in runs:
        held[tree.enter((run[0],))] = iter(run[1:])
    while (best := tree.best())[1] is not tree.EMPTY:
        out.append(best[1][0])
        following = next(held[best[0]], None)
        tree.leave(best[0]) if following is None else tree.set(best[0], (following,))
    assert out == sorted(x for run in runs for x in run)


def test_merge_opens_few_blocks(monkeypatch):
    """Blocks of runs that follow each other are never open together."""
    most = 0

    class Watched(importance.TournamentTree):
        def enter(self, key):
            nonlocal most
            slot = super().enter(key)
            most = max(most, self.size - len(self.free))
            return slot

    monkeypatch.setattr(importance, "TournamentTree", Watched)
    monkeypatch.setattr(Watched, "EMPTY", importance.TournamentTree.EMPTY)
    entries = np.zeros(5000, importance.ENTRY)
    entries["neg"], entries["pos"] = np.arange(5000), np.arange(5000)
    blocks = [{"range": 0} | {c: int(entries[c][lo]) for c in importance.KEY} | {"entries": entries[lo : lo + 100].tobytes()} for lo in range(0, 5000, 100)]
    out = pd.concat(importance.merge_blocks({0: 0}, 4950)(iter([pd.DataFrame(blocks[:20]), pd.DataFrame(blocks[20:])])))
    assert most == 1 and out["rank"].notna().sum() == 4950 and len(out) == 5000 and (out["score"].to_numpy() == -np.arange(5000)).all()


def lines_left(rows, min_chars, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    last = {k: max(ids, key=lambda d: (d is not None, d or 0)) for k, ids in holders.items() if len(ids) >= min_docs}
    out = Counter()
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize(("min_chars", "min_docs"), [(40, 5), (1, 2), (0, 3)])
def test_line_dedup(docs, rows, none, small, min_chars, min_docs, monkeypatch):
    if not small:
        monkeypatch.setattr("colloquy.llm.line_dedup.KEYS_TO_BROADCAST", -1)
    got = dedup_lines(docs, min_chars=min_chars, min_docs=min_docs).select("row.doc_id", "row._id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == lines_left(rows, min_chars, min_docs)
    assert {r["_id"] for r in got} == {"clash"} and dedup_lines(none).count() == 0


def test_line_dedup_of_long_texts_and_ends(spark):
    shared = "The Same Line of more than forty code points, é"
    rows = [(i, "\n".join([f"\t{shared}\x0b "] * 3 + [f"own {i}"] * 2 + ["", shared.upper().replace("É", "é")])) for i in range(6)]
    rows += [(9, "\n".join(f"line {k} of a long text that goes on and on and on {k % 7}" for k in range(40_000)) + "\n" + shared), (3, shared), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("_gone", F.create_map(F.lit("a"), F.lit(1)))
    got = dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter(map(tuple, got)) == lines_left(rows, 40, 5)


def spellings(rows, min_chars, min_count):
    count = Counter()
    for doc, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'null' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_chars and n >= min_count}
    letters = set("".join(words))

    def near(w):
        out = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in {"", *letters}} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return (out - {w}) & set(words)

    form = {}
    for w, n in words.items():
        best = min(near(w), key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near(w)), form[w], words.get(form[w]), root))
    return out


def text_of_variants(seed):
    r, out = random.Random(seed), []
    for _ in range(700):
        w = r.choice(["étude", "hello", "hallo", "letter", "aaaaaa", "straße", "ÀÉabc", "xylophone", "x" * 90, "y" * 200])
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            i = r.randint(0, len(w) - 1)
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeéz") + w[i:], w[:i] + r.choice("aeß") + w[i + 1 :]])
        out.append(w)
    return r.choice([" ", ", ", "ł", "\n1"]).join(out)


@pytest.mark.parametrize(("small", "bits"), [(True, 29), (False, 29), (False, 15)])
def test_spelling(spark, small, bits, monkeypatch):
    """With joins by broadcast and by shuffle, and with a filter in slices."""
    if not small:
        monkeypatch.setattr(spelling, "WORDS_TO_BROADCAST", -1)
    monkeypatch.setattr(spelling, "MOST_BITS", bits)
    monkeypatch.setattr(spelling, "COUNTED", 500)
    rows = [(None if i == 3 else i % 9, text_of_variants(i)) for i in range(14)] + [(4, None), (5, ""), (6, "1 2 łł")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("id", F.lit("clash")).withColumn("word", F.lit(1))
    got = {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.group_spellings(docs).collect()}
    assert got == spellings(rows, 5, 3) and len(got) > 100


def test_spelling_of_common_rows(docs, rows, none):
    got = {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.group_spellings(docs, min_chars=2).collect()}
    assert got == spellings(rows, 2, 3)
    assert spelling.group_spellings(none).count() == 0


def test_filter_never_misses_a_word():
    words = sorted(set(re.findall("[A-Za-zÀ-ÿ]+", text_of_variants(1))) | {f"w{'ab' * (k % 9)}{chr(97 + k % 26)}" for k in range(500)})
    test = spelling.Filter(15, 0)
    held = np.zeros(1 << 12, np.uint8)
    for _, codes in spelling.by_length(words):
        hashed = spelling.ends(codes)[1][:, 0]
        assert (hashed == spelling.ends(codes)[0][:, -1]).all()
        for p in spelling.PROBES:
            place = test.place(hashed, p)
            np.bitwise_or.at(held, (place >> np.uint64(3)).astype(int), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    for _, codes in spelling.by_length(words):
        hashed = spelling.ends(codes)[1][:, 0]
        assert len(test.passing(hashed, held, 0)) == len(hashed)
