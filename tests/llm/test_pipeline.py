"""The pipeline against plain Python, stage by stage."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from test_copies import components, groups_of, shingles
from test_text_operators import WORD, library, repeated, water_fill

import corpus_pipeline
from colloquy.llm import line_rules

SF = "/root/testdata/sf0.001"


def ruled(rows):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    lines = lambda t: [x for x in t.split("\n") if WORD.search(x)]
    hosts = defaultdict(set)
    for _, text, source in rows:
        hosts[source].add(text or "")
    held = Counter((s, x) for s, texts in hosts.items() for t in texts for x in {norm(x) for x in lines(t)})
    frequent = {k for k, n in held.items() if n > line_rules.MAX_DOCS and 100 * n > line_rules.MAX_DOCS_PERCENT * len(hosts[k[0]])}
    for doc, text, source in rows:
        words = WORD.findall(text or "")
        gone = [x for x in lines(text or "") if (source, norm(x)) in frequent]
        left = len(words) - sum(len(WORD.findall(x)) for x in gone)
        if len(words) >= 50 and 100 * repeated(words) <= 50 * len(words) and 100 * left >= line_rules.MIN_LEFT_PERCENT * len(words):
            yield doc, "\n".join(x for x in text.split("\n") if x not in gone) if gone else text, source


def brute_force(rows):
    rows = list(ruled(rows))
    last = {max(ids) for ids in groups_of(rows).values()}
    rows = [r for r in rows if r[0] in last]
    low = components(rows)
    rows = [r for r in rows if not shingles(r[1]) or low[shingles(r[1])] == r[0]]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text))
    target, t = water_fill(sizes), library("word_bpe_49k.json")
    out = Counter()
    for doc, text, source in rows:
        rate = target[source] / sizes[source]
        draw = int(hashlib.md5(f"mix:{doc}".encode()).hexdigest()[:8], 16) / 2**32
        ids = t.encode(text, add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out[doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())] += int(rate) + (draw < rate - int(rate))
    return +out


def test_pipeline_equals_plain_python(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute_force(rows)


def test_stages_bear_odd_rows_and_empty_tables(spark, docs, none):
    for given in (docs, none):
        df = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == given.columns
            df = spark.createDataFrame(df.collect(), given.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).columns[0] == "doc_id"
