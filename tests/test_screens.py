"""Screens: bubbles, names, times, what has no text, order of pages, and readings of pictures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import intervals, pages, promotion, screens

READ = "chat long, place int, i int, kind string, emoji_desc string, valence double, intensity double, confidence double"
MESSAGE = "chat long, seq long, type string, text string, emoji_desc string, valence double, intensity double, confidence double"


def page_of(spark, *pages_):
    """Lines of pages of (height, [(text, x0, y0, x1, y1), ...]), all 600 wide."""
    rows = [(p, i, t, *map(float, box), 0.95, 600.0, float(h)) for p, (h, lines) in enumerate(pages_) for i, (t, *box) in enumerate(lines)]
    return spark.createDataFrame(rows, screens.LINE_SCHEMA)


TALK = (460, [
    ("2018년 9월 29일 토요일", 200, 30, 400, 50), ("오빠", 530, 66, 578, 88), ("뭐해?", 520, 102, 578, 124), ("오후 9:11", 455, 106, 512, 122),
    ("민준오빠", 62, 138, 118, 154), ("나 집에서 쉬고 있어!", 62, 168, 240, 190), ("어제 회식 타격이 너무 커서ㅠㅠㅋㅋ", 62, 204, 300, 226), ("오후 9:13", 308, 210, 365, 226),
    ("아 진짜 괜찮은거야", 430, 250, 578, 272), ("걱정되서 그래", 430, 276, 578, 298), ("오후 9:14", 365, 282, 422, 298),
    ("민준오빠", 62, 320, 118, 336), ("아니야 지금은 괜찮아ㅎㅎ", 62, 350, 260, 372), ("너는 뭐해?", 62, 386, 165, 408), ("오후 9:14", 173, 392, 230, 408),
])
GROUP = (400, [
    ("최정수", 62, 40, 110, 56), ("어떻게 너는 매번 사람이 그래?", 62, 70, 320, 92), ("오전 12:16", 328, 76, 395, 92), ("김록수", 62, 120, 110, 136), ("그러니까 괜찮다고 했잖아", 62, 150, 300, 172),
    ("오전 12:16", 308, 156, 375, 172), ("야 싸우지마", 480, 200, 578, 222), ("오전 12:16", 410, 206, 477, 222), ("최정수", 62, 250, 110, 266), ("그러다간 너 잃어 사람의 신용", 62, 280, 330, 302),
    ("김록수", 62, 320, 110, 336), ("없다고 말했잖아 부작용", 62, 350, 290, 372),
])
STICKER = (500, [
    ("완전 좋아", 500, 40, 578, 62), ("오후 11:14", 420, 46, 490, 62), ("나도 그래", 505, 92, 578, 114), ("오후 11:15", 420, 250, 490, 266),
    ("그래 내일 보자", 450, 302, 578, 324), ("잘 자", 530, 354, 578, 376), ("오후 11:20", 455, 360, 525, 376),
])
EVEN = (300, [("완전 좋아", 500, 40, 578, 62), ("나도 그래", 505, 92, 578, 114), ("그래 내일 보자", 450, 144, 578, 166)])
PHOTO = (900, [
    ("오후 2:54", 100, 470, 170, 486), ("졸지마졸지마", 62, 540, 200, 562), ("오후 2:55", 210, 546, 280, 562), ("힐링타임이구나", 62, 592, 210, 614), ("오후 2:56", 220, 598, 290, 614),
    ("하핫", 520, 644, 578, 666), ("오후 3:00", 450, 650, 512, 666), ("고생이 많다", 62, 700, 190, 722), ("오후 3:01", 200, 706, 270, 722),
])
THEIRS = (900, [("오후 2:54", 480, 470, 550, 486), *PHOTO[1][1:]])
DIVIDED = (400, [
    ("오후 4:36", 200, 40, 270, 56), ("충전~~", 62, 34, 140, 56), ("2026년 7월 24일 금요일", 200, 96, 400, 118), ("엄마 오늘 출근하나?", 420, 152, 578, 174),
    ("오후 10:42", 340, 158, 412, 174), ("집이여", 62, 204, 140, 226), ("오후 10:43", 150, 210, 222, 226),
])


def test_a_page_of_two(spark):
    df = page_of(spark, TALK, GROUP)
    got = screens.screen_messages(df).orderBy("seq").collect()
    assert {r["page"] for r in got} == {0}  # three speakers have no rows
    assert [(r["who"], r["time"], r["text"]) for r in got] == [
        ("me", None, "오빠"), ("me", "21:11", "뭐해?"), ("other", None, "나 집에서 쉬고 있어!"), ("other", "21:13", "어제 회식 타격이 너무 커서ㅠㅠㅋㅋ"),
        ("me", "21:14", "아 진짜 괜찮은거야\n걱정되서 그래"), ("other", None, "아니야 지금은 괜찮아ㅎㅎ"), ("other", "21:14", "너는 뭐해?"),
    ]
    assert {r["date"] for r in got} == {"2018-09-29"} and got[0]["char_count"] == 2
    assert {(r["page"], r["speakers"]) for r in screens.speakers_of(df, df).collect()} == {(0, 2), (1, 3)}


def test_the_same_short_text_twice_is_no_name(spark):
    """A time label beside the other's bubble stands on my side, but it is no line of mine."""
    lines = [("ㅇㅇ", 62, 40, 100, 62), ("오후 9:11", 310, 42, 380, 60), ("ㅇㅇ", 62, 100, 100, 122), ("오후 9:12", 310, 102, 380, 120), ("그래", 530, 160, 578, 182), ("오후 9:13", 450, 162, 520, 180)]
    got = screens.screen_messages(page_of(spark, (300, lines))).orderBy("seq").collect()
    assert [(r["who"], r["text"], r["time"]) for r in got] == [("other", "ㅇㅇ", "21:11"), ("other", "ㅇㅇ", "21:12"), ("me", "그래", "21:13")]


def test_what_stands_between_bubbles(spark):
    got = {r["page"]: r for r in screens.screen_holes(page_of(spark, STICKER, EVEN, PHOTO, THEIRS, DIVIDED)).collect()}
    assert set(got) == {0, 2, 3}
    assert (got[0]["who"], got[0]["time"], got[0]["confidence"], got[0]["y0"], got[0]["y1"]) == ("me", "23:15", 0.8, 114, 248)
    assert (got[2]["who"], got[2]["time"], got[3]["who"], got[2]["confidence"]) == ("me", "14:54", "other", 0.5)
    rows = screens.screen_messages(page_of(spark, STICKER)).orderBy("seq").collect()
    assert [r["type"] for r in rows] == ["text", "text", "nontext", "text", "text"]
    assert (rows[2]["text"], rows[2]["char_count"], rows[2]["date"]) == (None, 0, None)


def test_screens_without_lines(spark):
    none = spark.createDataFrame([], screens.LINE_SCHEMA)
    assert screens.screen_messages(none).count() == 0 and screens.screen_holes(none).count() == 0
    odd = spark.createDataFrame([(1, 0, None, 1.0, 1.0, 2.0, 2.0, 0.9, 600.0, 300.0), (2, 0, "  ", 1.0, 1.0, 2.0, 2.0, 0.9, 600.0, 300.0)], screens.LINE_SCHEMA)
    assert screens.screen_messages(odd).count() == 0


def test_bubbles_of_one_height_have_an_order(spark):
    lines = [("왼쪽", 62, 40, 100, 62), ("오른쪽", 520, 40, 578, 62), ("아래", 62, 100, 100, 122)]
    assert [r["text"] for r in screens.screen_messages(page_of(spark, (300, lines))).orderBy("seq").collect()] == ["왼쪽", "오른쪽", "아래"]


def test_filters_follow_each_other(spark):
    """A banner leaves the heights before the median is taken: with it, the sticker's text would pass."""
    lines = [(f"말풍선 {i}", 62, 200 + 50 * i, 200, 220 + 50 * i) for i in range(3)] + [("배너", 240, 400 + 60 * i, 299, 450 + 60 * i) for i in range(3)] + [("쿼카칵!", 70, 700, 250, 745)]
    got = {r["text"]: r["dropped"] for r in pages.prepared(page_of(spark, (2000, lines))).collect()}
    assert got == {"말풍선 0": None, "말풍선 1": None, "말풍선 2": None, "배너": "column", "쿼카칵!": "sticker"}


def folded(lines, gap=0.35, align=12):
    """Bubbles of one page's (y0, x0, line, who, y1), one line after the other."""
    out = []
    for y0, x0, _, who, y1 in sorted(lines):
        last = out[-1] if out else None
        if last and last[0] == who and y0 - last[2] <= gap * (y1 - y0) and abs(x0 - last[1]) <= align:
            last[1], last[2], last[3] = min(last[1], x0), max(last[2], y1), last[3] + 1
        else:
            out.append([who, x0, y1, 1])
    return out


def test_bubbles_equal_a_walk_down_the_page(spark):
    r = random.Random(5)
    pages_ = []
    for _ in range(20):
        y, lines = 0, []
        for i in range(40):
            y += r.choice([4, 10, 24, 24, 30, 60])
            x = r.choice([60, 62, 70, 80, 480, 490, 500])
            lines.append((f"t{i}", x, y, x + 60, y + r.choice([18, 20, 26])))
        pages_.append((3000, lines))
    got = pages.bubbles(page_of(spark, *pages_)).orderBy("page", "bubble").collect()
    for p, (_, lines) in enumerate(pages_):
        want = folded([(y0, x0, i, "me" if 600 - x1 < x0 else "other", y1) for i, (_, x0, y0, x1, y1) in enumerate(lines)])
        assert [(b["who"], b["x0"], b["y1"], b["lines"]) for b in got if b["page"] == p] == [tuple(w) for w in want]


def test_free_bands(spark):
    r = random.Random(2)
    bands = [(p, 0, float(a := r.randint(0, 50)), float(a + r.randint(0, 60))) for p in range(60)]
    spans = [(p, float(a := r.randint(-20, 120)), float(a + r.randint(0, 15))) for p in range(60) for _ in range(r.randint(0, 6))]
    got = intervals.free_bands(spark.createDataFrame(bands, "page int, band int, lo double, hi double"), spark.createDataFrame(spans, "page int, lo double, hi double"), ["page"], pad=2.0).collect()
    for g in got:
        met = [(a - 2, b + 2) for p, a, b in spans if p == g["page"] and b > g["lo"] and a < g["hi"]]
        edges = sorted({g["lo"], g["hi"], *(x for s in met for x in s if g["lo"] <= x <= g["hi"])})
        free = [(a, b) for a, b in itertools.combinations(edges, 2) if b > a and not any(x < b and y > a for x, y in met)]
        best = max(free, key=lambda f: (f[1] - f[0], -f[0]), default=(None, None))
        assert (g["free_lo"], g["free_hi"]) == best


@pytest.mark.parametrize("including", [True, False])
def test_as_of(spark, including):
    r = random.Random(3)
    points = [(r.randint(0, 3), r.randint(0, 20), i) for i in range(80)]
    values = [(r.randint(0, 3), r.randint(0, 20), i, None if i % 7 == 0 else f"v{i}") for i in range(30)]
    df = intervals.as_of(spark.createDataFrame(points, "k int, at int, id int"), spark.createDataFrame(values, "k int, at int, n int, v string"), ["k"], "at", ["v"], including, ["n"])
    got = {x["id"]: x["v"] for x in df.collect()}
    for k, at, i in points:
        before = [(a, n, v) for kk, a, n, v in values if kk == k and (a <= at if including else a < at)]
        assert got[i] == (max(before)[2] if before else None)
    assert len(got) == len(points)


def all_orders(n, links):
    score = lambda o: sum(links.get(x, 0) for x in itertools.pairwise(o))
    return list(max(itertools.permutations(range(n)), key=lambda o: (score(o), [-x for x in o])))


def test_best_order():
    r = random.Random(8)
    for n in range(2, 7):
        for _ in range(30):
            links = {(a, b): r.randint(1, 4) for a in range(n) for b in range(n) if a != b and r.random() < 0.4}
            assert pages.best_order(n, links) == all_orders(n, links)
    assert pages.best_order(3, {}) == [0, 1, 2]
    chain = list(range(30))
    r.shuffle(chain)
    assert pages.best_order(30, {x: 5 for x in itertools.pairwise(chain)}) == chain


def test_pages_find_their_order(spark):
    """Two pages of twelve that share four are put right and merge without doubles; pages that share nothing stay."""
    first, second = [f"a{i}" for i in range(12)], [f"a{i}" for i in range(8, 20)]
    rows = [(1, p, i, k) for p, keys in enumerate([second, first]) for i, k in enumerate(keys)] + [(2, p, 0, f"p{p}") for p in range(3)]
    paged = spark.createDataFrame(rows, "chat long, page long, seq long, key string")
    assert {(r["page"], r["place"]) for r in pages.page_order(paged).where("chat = 1").collect()} == {(1, 0), (0, 1)}
    assert {(r["page"], r["place"]) for r in pages.page_order(paged).where("chat = 2").collect()} == {(0, 0), (1, 1), (2, 2)}
    merged = pages.merged_pages(pages.reordered(paged)).where("chat = 1").orderBy("seq").collect()
    assert [r["key"] for r in merged] == [f"a{i}" for i in range(20)]
    assert pages.merged_pages(paged).where("chat = 1").count() == 24


def test_readings_of_pictures(spark):
    rows = spark.createDataFrame([(1, i, t, None, None, None, None, 0.8) for i, t in enumerate(["text", "nontext", "nontext", "text", "nontext", "nontext"])], MESSAGE)
    said = spark.createDataFrame([
        (1, 0, -1, "emoticon", "웃는 곰" + "ㅎ" * 40, 0.5, 0.6, 0.9), (1, 1, -1, "photo", "바다", 1.5, 0.5, 0.9), (1, 2, 3, "photo", "산", -1.0, 0.0, 1.0), (1, 3, 9, "video", "x", 0.0, 0.0, 0.0),
        (1, 4, 2, "photo", "강", float("nan"), 0.5, 0.5), (1, 5, -1, "photo", "남는 것", 0.1, 0.1, 0.1), (2, 0, 0, "photo", "다른 방", 0.1, 0.1, 0.1),
    ], READ)
    got = promotion.promote(rows, said).orderBy("seq").collect()
    assert [r["type"] for r in got] == ["text", "emoticon", "nontext", "text", "nontext", "photo"]
    assert len(got[1]["emoji_desc"]) == 30 and (got[1]["valence"], got[1]["confidence"]) == (0.5, 0.9)
    assert (got[5]["emoji_desc"], got[2]["emoji_desc"], got[2]["confidence"], got[0]["confidence"]) == ("산", None, 0.8, 0.8)
    assert promotion.promote(rows, said.limit(0)).count() == 6


def test_a_read_sticker_opens_the_affect_of_a_screen(spark):
    """From lines to messages to readings: stickers of a page become emoticons with an affect."""
    from colloquy.operators import metrics, sequence

    messages = screens.screen_messages(page_of(spark, STICKER)).select(F.col("page").alias("chat"), "seq", "who", F.lit(None).cast("long").alias("ts"), "date", "time", "type", "text", "char_count", F.lit(None).cast("string").alias("emoji_desc"), F.lit(None).cast("double").alias("valence"), F.lit(None).cast("double").alias("intensity"), "confidence")
    said = spark.createDataFrame([(0, 0, 0, "emoticon", "하트", 1.0, 0.5, 0.9)], READ)
    r = metrics.emoji_affect(sequence.enriched(promotion.promote(messages, said))).collect()[0]
    assert (r["me"], r["other"]) == (0.5, 0.0)
