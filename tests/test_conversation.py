"""Conversation operators on small made-up chats, and queries against their SQL."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from colloquy.operators import metrics, pages, sequence
from colloquy.operators import pages as G
from colloquy.operators.semantic import mulberry
from colloquy.plans import report
from colloquy.plans.queries import REGISTERED, highlights
from colloquy.schema import MESSAGES
from colloquy.sources import exports

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: Queries that cover one family each; all of them run against their SQL at a larger scale outside the tests.
CHECKED = ["headline", "headline_turns", "metric_status", "metric_status_turns", "odds_orders", "strongest_signal", "single_fact", "phrase_gap", "change_point", "axis_corr", "export_pc", "export_ios", "export_android", "merge_suggestions", "group_check", "page_overlap", "page_merge", "page_bubbles", "style_sep", "sync_exact", "stream_sessions"]


def message(seq, who, minute, text="hello there", kind="text", chat=1, valence=None, desc=None):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)
    text = text if kind == "text" else None
    return (chat, seq, who, int(at.timestamp() * 1000), f"{at:%Y-%m-%d}", f"{at:%H:%M}", kind, text, len(text or ""), desc, valence, None if valence is None else 1.0, 1.0)


@pytest.fixture
def chat(spark):
    return lambda rows: sequence.enriched(spark.createDataFrame(rows, MESSAGES))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_a_pause_of_exactly_six_hours_ends_a_session(chat):
    e = chat([message(0, "me", 0), message(1, "other", 360), message(2, "me", 719), message(3, "me", 1079)])
    got = [(r["opener"], r["closer"], r["messages"]) for r in sequence.sessions(e).orderBy("session").collect()]
    assert got == [("me", "me", 1), ("other", "me", 2), ("me", "me", 1)]


def test_a_negative_gap_has_no_delta_and_a_long_one_counts_in_n_only(chat):
    e = chat([message(0, "me", 100), message(1, "other", 90), message(2, "me", 1000), message(3, "other", 1003)])
    assert [r["delta_min"] for r in sequence.transitions(e).orderBy("seq").collect()] == [None, 910.0, 3.0]
    r = one(metrics.reply_distribution(e))
    assert (r["me_fast"], r["me_slow"], r["me_n"], r["other_fast"], r["other_n"]) == (0, 0, 1, 1, 1)


def test_clock_times_alone_pass_midnight(spark):
    rows = [(1, i, w, None, None, t, "text", "x", 1, None, None, None, 1.0) for i, (w, t) in enumerate([("me", "23:58"), ("other", "00:03"), ("me", "09:00")])]
    e = sequence.enriched(spark.createDataFrame(rows, MESSAGES))
    assert [r["delta_min"] for r in sequence.transitions(e).orderBy("seq").collect()] == [5.0, None]


def test_headline_uses_the_last_120_and_cuts_bursts_at_its_edge(chat):
    rows = [message(i, "me", i, "?") for i in range(5)] + [message(5 + i, "me" if i < 10 or i % 2 else "other", 5 + i) for i in range(120)]
    r = one(report.headline(chat(rows)))
    assert r["window_filled"] == 120 and r["axis_question"] == 0.0
    assert r["axis_count"] == round((65 - 55) / 120, 2) and r["band"] == "even"


def test_an_axis_that_is_missing_is_not_zero(chat):
    r = one(report.headline(chat([message(i, "me", i) for i in range(4)])))
    assert (r["axis_count"], r["axis_length"], r["axis_question"], r["axes_used"], r["tilt"]) == (1.0, 1.0, None, 2, 100)


def test_the_last_session_counts_as_unanswered(chat):
    r = one(metrics.no_reply(chat([message(0, "me", 0), message(1, "other", 400), message(2, "other", 1000)])))
    assert (r["me_closed"], r["me_unanswered"], r["other_closed"], r["other_unanswered"]) == (1, 0, 2, 2)


def test_gates_lock_before_they_count(chat):
    status = {r["metric"]: r["status"] for r in report.metric_status(chat([message(0, "me", 0)])).collect()}
    assert status["syncAsym"] == "LOCKED:embedding" and status["emojiAffect"] == "LOCKED:affect"
    assert status["msgCount"] == "INSUFFICIENT:1/30" and status["deletedCount"] == "OK" and len(status) == 14


def test_report_holds_every_metric_and_vectors_open_theirs(spark, chat):
    import json

    rows = [message(i, "me" if i % 2 else "other", i * 200 * 60, f"abc {i % 3}") for i in range(130)] + [message(130 + i, "me", 1_560_000 + i, kind="deleted") for i in range(2)]
    rows += [message(132 + i, "me" if i % 2 else "other", 1_570_000 + i, kind="emoticon", valence=i / 10, desc=f"e{i}") for i in range(10)]
    e = chat(rows)
    vectors = spark.createDataFrame([(1, i, "me" if i % 2 else "other", [1.0, float(i // 2 % 3), float(i % 2)]) for i in range(130)], "chat long, seq long, who string, v array<double>")
    got = json.loads(one(report.report(e, vectors))["report"])
    assert {"reply_me_n", "months", "variety_me", "deleted", "sync_me", "style_score", "axis_sync"} <= set(got)
    assert got["deleted"] == 2 and got["status"]["syncAsym"] == got["status"]["styleSep"] == "OK" and got["axes_used"] == got["axes_total"] == 4
    assert len(got["status"]) == 14 and sum(m["messages"] for m in got["months"]) == len(rows) and "phrases" not in got


def test_floor_and_single_fact(chat):
    r = one(report.single_fact(chat([message(i, "me" if i % 5 else "other", i, "ab") for i in range(20)])))
    assert (r["info_units"], r["below_floor"], r["fact"]) == (8.0, True, "me sends more")


def test_variety_of_one_emoticon_is_zero(chat):
    r = one(metrics.emoji_variety(chat([message(0, "me", 0, kind="emoticon", valence=0.5, desc="a"), message(1, "other", 1, kind="emoticon", valence=1.0), message(2, "other", 2, kind="emoticon", valence=0.0)])))
    assert (r["me"], r["other"], r["other_unique"], r["other_total"]) == (0.0, 0.25, 1, 2)


def test_highlights_are_the_longest(chat):
    got = highlights(chat([message(i, "me", i, "x" * (10 + i)) for i in range(10)]), top=2).orderBy("place").collect()
    assert [(r["seq"], r["char_count"]) for r in got] == [(9, 19), (8, 18)]


PC = "\r\n".join([
    "하늘 님과 카카오톡 대화", "저장한 날짜 : 2025. 1. 8.", "", "[하늘] [오전 9:00] too early", "--------------- 2025년 1월 6일 월요일 ---------------",
    "[하늘] [오전 12:05] first\nsecond", "third", "[나] [오후 12:30] 사진 2장", "after a photo", "[나]x] [오후 1:02] 이모티콘", "메시지가 삭제되었습니다.", "하늘님이 나갔습니다.",
])


def test_reading_a_text_export(spark):
    df = spark.createDataFrame([(1, PC)], "chat long, content string")
    raw = [(r["name"], r["date"], r["time"], r["type"], r["text"]) for r in exports.raw_messages(df).orderBy("pos").collect()]
    assert raw == [("하늘", "2025-01-06", "00:05", "text", "first\nsecond\nthird"), ("나", "2025-01-06", "12:30", "photo", None), ("나]x", "2025-01-06", "13:02", "emoticon", None)]
    r = one(exports.parse_stats(df))
    assert (r["layout"], r["title"], r["messages"], r["multiline"], r["midnight"], r["unparsed"], r["deleted"], r["system"]) == ("pc", "하늘", 3, 1, 1, 2, 1, 1)
    assert exports.messages_of(df).count() == 0  # three speakers are a group


def test_unknown_layouts_and_titles(spark):
    df = spark.createDataFrame([(1, "nothing\r\nhere"), (2, "2025. 1. 6. 9:05, a : x\r\n2025. 1. 6. 오후 9:05, b : y"), (3, "")], "chat long, content string")
    assert {r["chat"]: r["layout"] for r in exports.layout_of(exports.records(df)).collect()} == {1: "unknown", 2: "ios", 3: "unknown"}
    assert [r["time"] for r in exports.raw_messages(df).orderBy("pos").collect()] == ["09:05", "21:05"]
    assert exports.messages_of(df).count() == 0


def test_lines_of_tiles_that_overlap_stay_once(spark):
    rows = [(1, 0, "hi", 10.0, 100.0, 50.0, 120.0, 0.8, 600.0), (1, 1, "hi ", 12.0, 105.0, 52.0, 125.0, 0.9, 600.0), (1, 2, "hi", 10.0, 160.0, 50.0, 180.0, 0.7, 600.0)]
    df = spark.createDataFrame(rows, "page long, line long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, width double")
    assert sorted(r["line"] for r in pages.without_duplicates(df).collect()) == [1, 2]


@pytest.mark.parametrize(("last", "overlap"), [(3, 3), (1, 0), (0, 0), (15, 15), (17, 0)])
def test_page_overlap(spark, last, overlap):
    first = [(1, 0, i, f"k{i}") for i in range(20)]
    second = [(1, 1, j, f"k{20 - last + j}") for j in range(last)] + [(1, 1, 90 + j, f"new{j}") for j in range(3)]
    got = one(pages.page_overlaps(spark.createDataFrame(first + second, "chat long, page long, seq long, key string")))
    assert got["overlap"] == overlap


def test_the_seeded_generator_is_the_fixed_one():
    draw = mulberry(1)
    assert [round(next(draw), 6) for _ in range(3)] == [0.627074, 0.002736, 0.527447]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x if x is None or isinstance(x, (bool, str)) else round(float(x), 6)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    query, sql = REGISTERED[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    key = lambda r: tuple(map(repr, r))
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lines_that_are_not_of_the_conversation(spark):
    rows = [(1, i, t, float(x0), float(y), float(x1), float(y + h), 0.9, 600.0, 1000.0) for i, (t, x0, x1, y, h) in enumerate([
        ("LTE 98%", 500, 580, 10, 20), ("메시지 입력", 62, 200, 960, 20), ("오전 9:11", 230, 290, 200, 16), ("안녕", 62, 120, 200, 20), ("지연", 62, 100, 180, 20),
        ("응 그래", 500, 578, 260, 20), ("WOW", 80, 300, 330, 90), ("배너", 220, 290, 400, 20), ("지연", 62, 100, 440, 20), ("또 봐", 62, 130, 470, 20),
    ])]
    df = spark.createDataFrame(rows, "page long, line long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, width double, height double")
    got = {r["line"]: r["dropped"] for r in pages.prepared(df).collect()}
    assert got == {0: "top", 1: "control", 2: None, 3: None, 4: None, 5: None, 6: "sticker", 7: "column", 8: None, 9: None}
    assert [r["text"] for r in pages.name_labels(df).collect()] == ["지연"]


def test_pages_overlap_with_all_that_came_before(spark):
    """A short page between two others is no gap."""
    pages = {0: ["abcdefgh", "gh", "fghij"], 1: ["abc", "xyz", "yzq"], 2: ["a", "ab"], 3: ["x" * 40, "x" * 20]}
    rows = [(chat, page, seq, key) for chat, texts in pages.items() for page, text in enumerate(texts) for seq, key in enumerate(text)]
    paged = spark.createDataFrame(rows, "chat long, page long, seq long, key string")
    got = {}
    for r in G.merged_pages(paged).orderBy("chat", "seq").collect():
        got[r["chat"]] = got.get(r["chat"], "") + r["key"]
    assert got == {0: "abcdefghij", 1: "abcxyzq", 2: "aab", 3: "x" * 45}
    assert {tuple(r) for r in G.page_gaps(paged).collect()} == {(1, 1), (2, 1)}


def test_late_messages_do_not_open_a_session_again(spark, tmp_path):
    from colloquy.streaming import sessions

    days = [["2024-01-01 10:00", "2024-01-01 11:00", "2024-01-05 10:00"], ["2024-01-09 10:00", "2024-01-09 10:30"], ["2024-01-01 12:00", "2024-01-20 00:00"]]
    for part, stamps in enumerate(days):
        frame = spark.createDataFrame([(1, t) for t in stamps], "chat long, t string").select("chat", F.to_timestamp("t").alias("at"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={part}"))
    stream = spark.readStream.schema("chat long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = sessions.run_once(sessions.session_counts(stream), spark).orderBy("first_at").collect()
    assert [r["messages"] for r in got] == [2, 1, 2]


def test_lines_of_a_screen_become_messages(spark):
    """A row in two pieces, a name label, times beside bubbles, a glyph and the input field."""
    from colloquy.operators import screens

    lines = [
        ("2024년 3월 1일 금요일", 200, 10, 400, 40), ("지연", 62, 100, 120, 120), ("안녕하세요", 62, 130, 180, 160), ("반가워요", 190, 130, 300, 160), ("다음 줄이에요", 62, 168, 250, 198), ("오전 9:05", 310, 170, 370, 190),
        ("네 안녕하세요", 400, 300, 578, 330), ("오전 9:07", 320, 306, 380, 326), ("지연", 62, 400, 120, 420), ("ㅇㅇ TT", 62, 430, 180, 460), ("오전 9:08", 190, 436, 250, 456), ("#", 560, 470, 578, 490), ("메시지 입력", 62, 600, 200, 630),
    ]
    rows = [(1, i, t, float(a), float(b), float(c), float(d), 0.9, 600.0, 700.0) for i, (t, a, b, c, d) in enumerate(lines)]
    got = screens.screen_messages(spark.createDataFrame(rows, screens.LINE_SCHEMA)).orderBy("seq").collect()
    assert [(r["who"], r["date"], r["time"], r["text"]) for r in got] == [
        ("other", "2024-03-01", "09:05", "안녕하세요 반가워요\n다음 줄이에요"),
        ("me", "2024-03-01", "09:07", "네 안녕하세요"),
        ("other", "2024-03-01", "09:08", "ㅇㅇ ㅜㅜ"),
    ]
    stamps = [(1, i, "오전 9:05", 0.0, y - 8, 60.0, y + 8, 0.9, 600.0, 700.0) for i, y in enumerate([620.0, 500.0, 10.0, 585.0, 540.0])]
    assert sorted(r["at"] for r in screens.times_of(spark.createDataFrame(stamps, screens.LINE_SCHEMA)).collect()) == [500.0, 540.0, 585.0, 620.0]


def test_a_report_below_the_floor_holds_one_fact(chat):
    import json

    got = json.loads(one(report.report(chat([message(i, "me" if i % 5 else "other", i, "ab") for i in range(20)])))["report"])
    assert got == {"kind": "hard_floor", "info_units": 8.0, "single_fact": "me sends more"}
