"""Beginnings of chats, numbers of documents, wide tables, growing files, cards with vectors, blocks for sentences."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions.documents import collect_numbers
from colloquy.operators import narrative, prefixes, sequence
from colloquy.plans import display, further_queries, report
from colloquy.sources.tables import csv_messages, csv_rows
from colloquy.streaming import records
from colloquy.streaming.sessions import run_once

ROW = "chat long, seq long, who string, ts long, date string, time string, type string, text string, char_count int, emoji_desc string, valence double, intensity double, confidence double"


def chat_of(spark, seed, n=260):
    r = random.Random(seed)
    rows, at = [], 1_700_000_000_000
    for i in range(n):
        at += r.choice([60_000, 600_000, 30_000_000, 900_000_000])
        kind = r.choice(["text", "text", "text", "emoticon", "photo"])
        t = r.choice(["응", "그래 그럼 내일 보자", "진짜?"]) if kind == "text" else None
        stamp = None if seed == 2 and i > 100 else at
        day = [f"20{20 + i // 90:02d}-{i % 90 // 8 + 1:02d}-05", f"{i % 24:02d}:10"]
        rows.append((seed, i, r.choice(["me", "other"]), stamp, day[0], day[1], kind, t, len(t or ""), "곰" if kind == "emoticon" else None, 0.5 if kind == "emoticon" else None, 0.5 if kind == "emoticon" else None, 1.0))
    return rows


def test_gates_of_every_beginning(spark):
    """Against the gates of whole chats: each beginning is made a chat of its own."""
    rows = chat_of(spark, 1) + chat_of(spark, 2, 150)
    got = {(x["chat"], x["metric"]): x["opens_at"] for x in prefixes.openings(sequence.enriched(spark.createDataFrame(rows, ROW)), report.CATALOG, report.NUMBER_NEEDS).collect()}
    cuts = [2, 10, 29, 30, 59, 60, 61, 119, 120, 121, 130, 150]
    begun = [(c * 1000 + n, *r[1:]) for c in (1, 2) for n in cuts for r in rows if r[0] == c and r[1] < n]
    df = sequence.enriched(spark.createDataFrame(begun, ROW))
    status = {(x["chat"], x["metric"]): x["status"] for x in report.metric_status(df).collect()}
    for (chat, metric), at in got.items():
        for n in cuts:
            known = status.get((chat * 1000 + n, metric))
            assert known is None or (known == "OK") <= (at is not None and at <= n), (chat, metric, n)
            if at == n and known:
                assert known == "OK"
    floor = {x["chat"]: x["below_floor"] for x in report.single_fact(df).collect()}
    assert all(floor[c * 1000 + n] == (n < got[c, "report"]) for c in (1, 2) for n in cuts) and got[1, "number"] == 60
    assert got[1, "syncAsym"] is None and got[1, "msgCount"] == 30


@pytest.mark.parametrize(("document", "numbers"), [
    ({"a": [1, -2.5, {"b 9": "7 \\\" 8", "c": [[3e2]]}], "d": None, "e": True, "0": "1"}, [1.0, -2.5, 300.0]), ([], []), (4, [4.0]), ({"s": '\\"5', "t": "\\\\", "u": 6}, [6.0]),
])
def test_numbers_of_documents(spark, document, numbers):
    df = spark.createDataFrame([(json.dumps(document),)], "document string")
    assert df.select(collect_numbers(F.col("document"))).collect()[0][0] == numbers


def test_what_is_no_document_has_no_numbers(spark):
    df = spark.createDataFrame([("not 5",), (None,), ('{"a": 1e999, "b": 2}',)], "document string")
    assert [r[0] for r in df.select(collect_numbers(F.col("document"))).collect()] == [None, None, [2.0]]


def test_a_sentence_is_checked_against_a_whole_report(spark):
    rows = sequence.enriched(spark.createDataFrame(chat_of(spark, 1), ROW))
    made = report.report(rows).select("chat", collect_numbers(F.col("report")).alias("numbers"))
    counts = report.reported(rows).select("count_me").collect()[0][0]
    said = made.withColumn("text", F.explode(F.array(F.lit(f"당신은 {counts}번 말했다."), F.lit("당신은 987654번 말했다."))))
    assert sorted((r["text"].endswith("987654번 말했다."), r["ok"]) for r in narrative.verified(said).collect()) == [(False, True), (True, False)]


def test_wide_tables(spark, tmp_path):
    """Thirty columns before the three that count, in one file of two; empty fields stay, short rows are short."""
    head = ",".join(f"k{i}" for i in range(30))
    (tmp_path / "wide.csv").write_text(f"{head},Date,User,Message\n" + "".join(f"{','.join('x' * (i % 3 == 0) for _ in range(30))},2024-01-0{i} 09:00,a{i % 2},hello {i}\n" for i in range(1, 6)))
    (tmp_path / "narrow.csv").write_text("Date,User,Message\n2024-01-01 10:00,a,hi,,\n2024-01-02 10:00,b\n")
    rows = csv_rows(spark, str(tmp_path)).withColumn("chat", F.regexp_extract("chat", r"([a-z]+)\.csv$", 1)).cache()
    assert {(r["chat"], r["n"]) for r in rows.select("chat", F.size("fields").alias("n")).collect()} == {("wide", 33), ("narrow", 3), ("narrow", 2)}
    assert [(r["name"], r["text"]) for r in csv_messages(rows).where("chat = 'wide'").orderBy("pos").collect()] == [(f"a{i % 2}", f"hello {i}") for i in range(1, 6)]


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_a_file_that_grows(spark, tmp_path, part):
    """Three writes that end inside a record, inside a letter, and between CR and LF; a restart repeats nothing."""
    text = "\r\n".join([f"{'레코드' * (i % 4)} {i}\nstill {i}" for i in range(40)] + [""]).encode()
    cr = text.index(b"\r\n", 300) + 1
    letter = text.index("레".encode(), 600) + 1
    folder, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    folder.mkdir()
    spark.dataSource.register(records.RecordFiles)
    for end in (cr, letter, len(text)):
        (folder / "chat.txt").write_bytes(text[:end])
        (folder / "other.txt").write_bytes(b"one\r\ntwo"[: 4 + end % 3])
        stream = spark.readStream.format("crlf_records").option("path", str(folder)).option("part", part).load()
        stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    got = [(r["offset"], r["record"]) for r in spark.read.parquet(out).where("file = 'chat.txt'").orderBy("offset").collect()]
    assert [x for _, x in got] == text.decode().split("\r\n")[:-1] and got[0][0] == 0
    table = spark.read.format("crlf_records").option("path", str(folder)).option("part", part).load()
    assert {r["record"] for r in table.where("file = 'other.txt'").collect()} in ({"one\r"}, {"one"}, {"one", "t"})
    assert table.where("file = 'chat.txt'").count() == 40


def test_records_equal_a_split_at_any_stretch(tmp_path):
    r = random.Random(6)
    for size in range(40):
        data = bytes(r.choice(b"ab\r\n\n\r") for _ in range(size))
        (tmp_path / "x").write_bytes(data)
        path = str(tmp_path / "x")
        want = data.split(b"\r\n")
        want = want if want[-1] else want[:-1]
        for part in (1, 2, 3, 5, 100):
            got = [x for s in records.stretches(path, 0, size, part, tail=True) for x in records.records(s)]
            assert [g[2].encode() for g in got] == want
        assert records.last_end(path, 0) == data.rfind(b"\r\n") + 2 * (b"\r\n" in data) + (b"\r\n" not in data)


def test_cards_of_all_metrics(spark):
    """With vectors and words of one side alone, all 14 are there; none has a null value beside its text."""
    rows = chat_of(spark, 1, 900)
    rows = [(*r[:7], (r[7] + (" 있잖아요" if r[2] == "me" and r[1] % 2 else " 그러니까") if r[7] else None), *r[8:]) for r in rows]
    df = spark.createDataFrame(rows, ROW)
    r = random.Random(1)
    vectors = spark.createDataFrame([(x[0], x[1], x[2], [r.random() for _ in range(4)]) for x in rows if x[7]], "chat long, seq long, who string, v array<double>")
    got = {x["metric"]: x for x in display.metric_cards(sequence.enriched(df), vectors).collect()}
    assert set(got) == {m.key for m in report.CATALOG}
    assert {k: x["kind"] for k, x in got.items() if x["kind"] != "pair"} == {"styleSep": "single", "deletedCount": "single", "monthly": "single", "phraseGap": "chips", "changePoint": got["changePoint"]["kind"]}
    assert got["styleSep"]["max"] == 100 and got["phraseGap"]["chips_me"] is not None and len(got["phraseGap"]["chips_me"]) <= 3
    assert got["questionRate"]["me"] == int(got["questionRate"]["me"]) and got["initiation"]["note"].startswith("세션 ")
    block = further_queries.sentence_block(sequence.enriched(df), vectors).collect()[0]["block"]
    assert block.startswith("기울기: ") and "말투 분리도: " in block and "\n\n# 아래는" in block and "이모티콘 온도차" in block


def test_a_coarse_block_has_no_number(spark):
    df = sequence.enriched(spark.createDataFrame(chat_of(spark, 1, 40), ROW))
    lines = further_queries.sentence_block(df, crush=True).collect()[0]["block"].split("\n")
    assert lines[0].startswith("기울기 방향: ") and lines[1] == narrative.HIDDEN_TILT and lines[2].split(": ")[1].split("   ")[0] in narrative.CRUSH_LABELS.values()


def test_stream_of_records_by_the_runner(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"1\r\n2\r\n3")
    spark.dataSource.register(records.RecordFiles)
    got = run_once(spark.readStream.format("crlf_records").option("path", f"file://{tmp_path}/in").load(), spark).collect()
    assert sorted((r["offset"], r["record"]) for r in got) == [(0, "1"), (3, "2")]


def test_tiles_and_what_they_read_twice(spark):
    from colloquy.operators import pages

    made = pages.tiles(spark.createDataFrame([(1, 3000), (2, 3001), (3, 5700), (4, 5701), (5, 10)], "page long, height long")).collect()
    want = {}
    for page, height in ((1, 3000), (2, 3001), (3, 5700), (4, 5701), (5, 10)):
        top, cuts = 0, []
        while True:
            cuts.append((float(top), float(min(height, top + 3000))))
            if top + 3000 >= height:
                break
            top += 2700
        want[page] = cuts
    assert {p: sorted((r["top"], r["bottom"]) for r in made if r["page"] == p) for p in want} == want


def test_duplicates_go_from_the_surest_down(spark):
    """Against a walk over lines by confidence: a line that has gone hides no other."""
    from colloquy.operators import pages

    r = random.Random(11)
    rows = [(p, i, r.choice(["a", "a ", "b"]), float(r.randint(0, 60)), float(r.randint(0, 60)), 0.0, 0.0, r.choice([0.5, 0.6, 0.7]), 600.0) for p in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "page long, line long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, width double")
    kept = set()
    for p in range(6):
        done = []
        for x in sorted((x for x in rows if x[0] == p), key=lambda x: (-x[7], x[1])):
            if not any(k[2].strip() == x[2].strip() and abs(k[3] - x[3]) <= 12 and abs(k[4] - x[4]) <= 12 for k in done):
                done.append(x)
        kept |= {(p, x[1]) for x in done}
    got = pages.without_duplicates(df)
    assert {(x["page"], x["line"]) for x in got.collect()} == kept and got.columns == df.columns


def test_what_a_file_is(spark, tmp_path):
    from colloquy.sources import chats

    files = {
        "a.txt": "﻿Date,User,Message\n2024-01-01 10:00,나,안녕\n2024-01-01 10:01,하늘,응\n", "b.csv": "x\n", "c.txt": "하늘 님과 카카오톡 대화\n저장한 날짜 : 2025, 1, 2, 3\n", "d.txt": "a,b,c\n", "e.txt": "a,b\nc\n",
        "f.txt": '"date" , x\n', "g.txt": "",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = {r["file"].rsplit("/", 1)[1]: r["kind"] for r in chats.kinds_of_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "csv", "b.csv": "csv", "c.txt": "text", "d.txt": "csv", "e.txt": "text", "f.txt": "csv"}


def test_exports_and_tables_of_one_folder(spark, tmp_path):
    from colloquy.sources import chats, exports

    (tmp_path / "table.csv").write_text("Date,User,Message\n2024-01-01 10:00,나,안녕\n2024-01-01 10:01,하늘,응\n")
    rows = spark.createDataFrame([(1, i, "me" if i % 2 else "other", 1_700_000_000_000 + i * 60_000, "2023-11-14", f"22:{13 + i:02d}", "text", f"t{i}", 2, None, None, None, 1.0) for i in range(4)], ROW)
    (tmp_path / "talk.txt").write_text(exports.rendered(rows, "pc").collect()[0]["content"], newline="")
    chosen = chats.kinds_of_files(spark, str(tmp_path)).where("kind = 'csv'").select("chat", F.lit("나").alias("name"))
    got = chats.read_chats(spark, str(tmp_path), chosen).groupBy("chat").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [2, 4]


def test_recognition_scores(spark):
    from colloquy.operators import scoring

    kind = "page long, seq long, who string, time string, type string, text string"
    truth = spark.createDataFrame([(1, 0, "me", "10:00", "text", "안 녕"), (1, 1, "me", None, "text", "응"), (1, 2, "other", "10:02", "text", "응"), (1, 3, "me", None, "photo", None), (2, 0, "me", "1:00", "text", "x")], kind)
    found = spark.createDataFrame([(1, 0, "me", "10:00", "text", "안녕"), (1, 1, "other", "10:02", "text", "응\n"), (1, 2, "me", None, "nontext", None), (1, 3, "me", None, "nontext", None)], kind)
    got = {r["page"]: tuple(r)[1:] for r in scoring.scores(found, truth).collect()}
    assert got == {1: (3, 3, 2, 2, 2, 2, 1, 2), 2: (1, 0, 0, 0, 1, 0, 0, 0)}


def test_progress_of_stages_and_batches(spark, tmp_path):
    import time

    from colloquy.plans import progress
    from colloquy.storage import run_folder

    stages, batches = progress.Stages(), progress.Batches()
    with run_folder(spark) as folder:
        rows = stages.done("messages", sequence.enriched(spark.createDataFrame(chat_of(spark, 1, 90), ROW)))
        gates = stages.done("gates", report.metric_status(rows))
        stages.done("report", report.report(rows))
        assert gates.count() == 14
        local = folder.removeprefix("file:")
        import os

        assert len([x for x in os.listdir(local) if x.startswith("stage-")]) == 3
    assert not os.path.exists(local)
    assert [tuple(r) for r in stages.rows(spark).orderBy("place").collect()] == [(0, "messages", 90), (1, "gates", 14), (2, "report", 1)]
    spark.streams.addListener(batches)
    try:
        for part in range(3):
            spark.range(5 + part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={part}"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        run_once(stream, spark)
        for _ in range(50):
            if sum(x[2] for x in batches.seen) >= 18:
                break
            time.sleep(0.2)
        assert sum(r["rows"] for r in batches.rows(spark).collect()) == 18 and batches.rows(spark).count() == 3
    finally:
        spark.streams.removeListener(batches)


def test_the_seeded_baseline(spark):
    """Against shuffles made here from the fixed generator and seeds."""
    import math

    from colloquy.operators import semantic

    r = random.Random(4)
    rows = [(7, i, r.choice(["me", "other"]), [r.uniform(-1, 1) for _ in range(5)]) for i in range(60)]
    got = {x["responder"]: x for x in semantic.sync_seeded(semantic.reply_pairs(spark.createDataFrame(rows, "chat long, seq long, who string, v array<double>"))).collect()}
    one = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for who, seed in semantic.SEEDS.items():
        pairs = [(one(a[3]), one(b[3])) for a, b in zip(rows, rows[1:], strict=False) if a[2] != b[2] == who]
        draw, means = semantic.mulberry(seed), []
        for _ in range(semantic.SHUFFLES):
            order = list(range(len(pairs)))
            for i in reversed(range(1, len(pairs))):
                j = math.floor(next(draw) * (i + 1))
                order[i], order[j] = order[j], order[i]
            far = [dot(pairs[i][0], pairs[j][1]) for i, j in enumerate(order) if i != j]
            means.append(sum(far) / len(far))
        raw = sum(dot(a, b) for a, b in pairs) / len(pairs)
        assert got[who]["pairs"] == len(pairs) and abs(got[who]["raw"] - raw) < 6e-4 and abs(got[who]["net"] - (raw - sum(means) / len(means))) < 6e-4


def test_tables_that_are_written_are_read_back(spark, tmp_path):
    from colloquy.sources.tables import csv_message_rows, written_csv

    texts = ["plain", 'a "quoted", word', "two\nlines", "끝,", None]
    rows = spark.createDataFrame([(1, i, "me" if i % 2 else "other", 1_700_000_000_000 + i * 60_000, "2023-11-14", f"22:{13 + i:02d}", "text" if t else "photo", t, 2, None, None, None, 1.0) for i, t in enumerate(texts)], ROW)
    (tmp_path / "a.csv").write_text(written_csv(rows).collect()[0]["content"], newline="")
    read = csv_rows(spark, str(tmp_path))
    chosen = read.select("chat", F.lit("나야").alias("name")).distinct()
    got = csv_message_rows(read, chosen).orderBy("seq").collect()
    assert [(r["who"], r["time"], r["type"], r["text"]) for r in got] == [(("me" if i % 2 else "other"), f"22:{13 + i:02d}", "text" if t else "photo", t) for i, t in enumerate(texts)]
