"""Operators that find copies, held against brute force over all pairs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

from colloquy.llm import exact_dedup, ngram_join, repeated_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_of(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    return groups


def check_copies(got, rows):
    groups = groups_of(rows)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = Counter()
    for t, ids in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        left = 1
        for d in sorted(ids, key=lambda d: d != best[t]):
            kept = d == best[t] and left == 1
            left -= kept
            want[d, best[t], len(ids), kept, sha] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_hashes_of_words_know_words_wherever_they_stand(monkeypatch):
    """Equal words have equal hashes, others don't, in any piece, and beside words longer than a piece."""
    import random

    r = random.Random(3)
    for piece in (8, 50, 1 << 17):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        words = ["".join(r.choice("abé한\u00a0") for _ in range(r.randint(1, 12))) for _ in range(400)] + ["x" * 60, "x" * 61]
        text = "".join(r.choice(words) + r.choice([" ", "\t\n", "\x0b \x0c", "\r"]) for _ in range(3000))
        data = (" " + text).encode()
        got, starts = ngram_join.WordHashes().of(data)
        want = re.findall(rb"[^\x20\x09-\x0D]+", data)
        assert [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)] == starts.tolist()
        assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))
    assert len(ngram_join.WordHashes().of(b"")[0]) == len(ngram_join.WordHashes().of(b" \n")[0]) == 0


def test_exact_copies(docs, rows, none):
    check_copies(exact_dedup.find_copies(docs).collect(), rows)
    assert exact_dedup.find_copies(none).count() == 0
    kept = exact_dedup.keep_one(docs).collect()
    assert len(kept) == len(groups_of(rows)) and list(kept[0].asDict()) == docs.columns


def test_hash_collisions_do_not_merge_texts(docs, rows):
    found = exact_dedup.find_copies(docs, hasher=lambda data: bytes([len(data) % 2])).select("text_sha256", "group_size", "kept").collect()
    want = Counter({hashlib.sha256(t.encode()).hexdigest(): len(ids) for t, ids in groups_of(rows).items()})
    assert {r["text_sha256"]: r["group_size"] for r in found} == want
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(list(want))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(rows):
    """Smallest id by set, over all pairs."""
    sets = {s for s in (shingles(t) for _, t, *_ in rows) if s}
    ids = {s: [d for d, t, *_ in rows if shingles(t) == s and d is not None] for s in sets}
    up = {s: s for s in sets}

    def find(s):
        while up[s] is not s:
            s = up[s]
        return s

    listed = list(sets)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                up[find(a)] = find(b)
    low = defaultdict(list)
    for s in sets:
        low[find(s)] += ids[s]
    return {s: min(low[find(s)], default=None) for s in sets}


def check_join(got, rows):
    low = components(rows)
    want = Counter((d, len(shingles(t)), low[shingles(t)] if shingles(t) else d) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_ngram_join(docs, rows, none):
    check_join(ngram_join.similarity_join(docs).collect(), rows)
    assert ngram_join.similarity_join(none).count() == 0
    kept = ngram_join.keep_one(docs).collect()
    assert list(kept[0].asDict()) == docs.columns
    assert sum(bool(shingles(r["text"])) for r in kept) == len(set(components(rows).values()) - {None}) + sum(v is None for v in set(components(rows).values()))


def test_ngram_join_of_a_large_family_and_a_common_passage(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(60):  # a family with one to eight changes each
        words = list(base)
        for _ in range(r.randint(1, 8)):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    for i in range(100, 160):  # mostly the passage, some nearly nothing else
        own = [word() for _ in range(r.choice([2, 8, 15, 40, 80]))]
        rows.append((i, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
    check_join(ngram_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_ngram_join_of_a_family_about_the_threshold(spark, monkeypatch):
    """A family of 1 200 near copies of which many pairs are just under or just over 80 %, in small blocks."""
    r = np.random.RandomState(6)
    base = r.randint(0, 10**6, 150)
    rows = []
    for i in range(1200):
        words = base.copy()
        words[r.choice(150, r.choice([1, 2, 3, 4, 6]), replace=False)] = r.randint(0, 10**6)
        rows.append((i, " ".join(map(str, words))))
    sets = [shingles(t) for _, t in rows]
    place = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        held[i, [place[x] for x in s]] = 1
    both = held @ held.T
    sizes = held.sum(axis=1)
    link = 100 * both >= 80 * (sizes[:, None] + sizes - both)
    low = np.arange(len(rows))
    for _ in rows:
        low, was = np.where(link, low, len(rows)).min(axis=1), low
        if (low == was).all():
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_FEATURES", 8_000)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similarity_join(docs).collect()}
    assert got == dict(enumerate(low.tolist()))
    assert 1 < len(set(low)) < len(rows)


def test_pairs_of_signatures_do_not_depend_on_batches():
    import pandas as pd

    r = np.random.RandomState(3)
    sizes = r.choice([1, 2, 3, 6, 7, 8, 40], 60)
    groups = [(sig, sorted(set(r.randint(0, 50, n).tolist()))) for sig, n in enumerate(sizes)]
    frame = pd.DataFrame([(s, x) for s, names in groups for x in names for _ in range(r.randint(1, 3))], columns=["sig", "name"])

    def read(step):
        out = pd.concat(ngram_join.pairs_of_runs(frame.iloc[i : i + step] for i in range(0, len(frame), step)))
        pairs = {(a, b) for s, a, b in out.itertuples(index=False) if pd.isna(s)}
        return pairs, {(s, a, b) for s, a, b in out.itertuples(index=False) if not pd.isna(s)}

    pairs, members = set(), set()
    for s, names in groups:
        large = len(names) > ngram_join.SMALL_GROUP
        pairs |= {(a, b) for i, a in enumerate(names[:1] if large else names) for b in names[i + 1 :]}
        members |= {(s, x, names[0]) for x in names if large}
    for step in (1, 2, 5, 17, len(frame)):
        assert read(step) == (pairs, members)


def test_sets_that_link_share_a_signature():
    r = np.random.RandomState(8)
    bands = ngram_join.Bands()
    for n in [*range(4, 40), 100, 300, 1000]:
        for _ in range(5):
            pool = np.unique(r.randint(0, 1 << 62, 3 * n).astype(np.uint64))
            a = np.sort(r.choice(pool, n, replace=False))
            k = n // 5  # a larger set may hold n / 4 more, a smaller one lack n / 5
            for b in (np.sort(r.choice(a, n - k, replace=False)), np.sort(np.concatenate([a, np.setdiff1d(pool, a)[: n // 4]]))):
                values = [set(ngram_join.Signatures(x, np.array([0, len(x)]), bands).values.tolist()) for x in (a, b)]
                assert values[0] & values[1] or len(a) == len(b)


def removed(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (doc, *_), t in zip(rows, texts, strict=True):
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[doc, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_bytes(docs, rows, none, monkeypatch):
    read = lambda: Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in repeated_bytes.remove_repeats(docs).collect())
    want = removed(rows, repeated_bytes.LENGTH)
    assert read() == want
    # Both ways of joining give the same.
    monkeypatch.setattr(repeated_bytes, "RANKS_TO_BROADCAST", 0)
    monkeypatch.setattr(repeated_bytes, "RUNS_TO_BROADCAST", 0)
    monkeypatch.setattr(repeated_bytes, "KINDS_TO_BROADCAST", 0)
    assert read() == want
    assert repeated_bytes.remove_repeats(none).count() == 0
