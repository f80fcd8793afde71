"""How often a query computes what it reads, and odd texts and pages that short cuts must not change."""

import time

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import pages
from colloquy.operators import sequence as S
from colloquy.plans import more_queries, queries, report
from colloquy.sources import exports
from colloquy.sources.adapters import from_events
from colloquy.storage import stored

SMALL = "/root/testdata/sf0.001"
LINE = "page long, line long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, width double, height double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lengths_of_odd_texts(spark):
    odd = ["가나다ᅡ", "ᄀ가나다", "abćdef", "ab\r\n\r\ncd", "🇰🇷🇰 xyz", "©abc©", "a‍b‍👩", "؀abc", "👩‍👩‍👧 여기", "12#*3abc", ""]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    whole = F.regexp_count("t", F.lit(r"\X")).cast("int")
    bare = F.regexp_count(T.trim(F.regexp_replace("t", f"[{T.EMOJI}{T.PARTS}]", "")), F.lit(r"\X")).cast("int")
    got = df.select(T.grapheme_count(F.col("t")), whole, T.countable_length(F.col("t")), bare, T.has_emoji(F.col("t")), F.col("t").rlike(f"[{T.EMOJI}]")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in got)


def test_a_long_text_is_not_held_against_every_emoji(spark):
    df = spark.range(8).select(F.repeat(F.lit("ein langer Text "), 20_000).alias("t")).cache()
    df.count()

    def took(c):
        best = 1e9
        for _ in range(3):
            began = time.time()
            df.agg(F.sum(c)).collect()
            best = min(best, time.time() - began)
        return best

    assert took(T.countable_length(F.col("t"))) < 0.5 * took(F.length(F.regexp_replace("t", f"[{T.EMOJI}{T.PARTS}]", "")))


def test_forms_of_numbers_are_made_once_a_text(spark):
    named = str(T.unknown_numbers(F.col("t"), F.col("v")))
    assert "format_string" in named and "format_string" not in named.split("filter(")[1]
    df = spark.createDataFrame([("7, 7 and 12.5%, -4 or 2", [12.5])], "t string, v array<double>")
    assert df.select(T.unknown_numbers(F.col("t"), F.col("v"))).first()[0] == ["7", "7", "-4"]


def test_lines_are_read_three_times_not_once_for_every_join(spark):
    lines = stored(spark.createDataFrame([(0, i, f"말 {i}", 62.0, 40.0 * i, 200.0, 40.0 * i + 32, 0.9, 600.0, 900.0) for i in range(9)], LINE), "lines")
    found = pages.prepared(lines)
    assert plan(found).count("Relation [") <= 3
    assert found.where("dropped IS NULL").count() == 9


def test_the_densest_column_counts_equal_edges(spark):
    at = [60.0, 60.0, 60.0, 75.0, 300.0, 301.0, 302.0, 319.0]
    lines = spark.createDataFrame([(0, i, "말", x, 40.0 * i, x + 90, 40.0 * i + 32, 0.9, 400.0, 900.0) for i, x in enumerate(at)], LINE)
    assert tuple(pages.column_of(lines).first()) == (0, 4, 302.0)  # as many in both: the right one, its upper median


def test_exports_are_read_once(spark):
    found = exports.messages_of(exports.rendered(from_events(spark, SMALL), "ios"))
    assert "Generate" not in plan(found) and "events.parquet" not in plan(found)
    assert found.count() == from_events(spark, SMALL).count()


def test_events_are_numbered_once_for_all_layouts(spark):
    found = more_queries.detect(spark, SMALL)
    assert "get_json_object" not in plan(found) and "row_number" not in plan(found)
    assert found.where("layout <> written").isEmpty()


def test_a_report_sorts_messages_once(spark):
    found = queries.REGISTERED["report"][0](spark, SMALL)
    assert "get_json_object" not in plan(found) and "events.parquet" not in plan(found)


def test_gates_count_pairs_without_the_seeded_baseline(spark):
    rows = S.enriched(spark.createDataFrame([(1, i, "me" if i % 3 else "other", None, None, None, "text", f"말이 {i}", 2, None, None, None, 1.0) for i in range(40)], "chat long, seq long, who string, ts long, date string, time string, type string, text string, char_count int, emoji_desc string, valence double, intensity double, confidence double"))
    vectors = rows.where("seq % 5 > 0").select("chat", "seq", "who", F.array(F.lit(1.0), F.col("seq").cast("double")).alias("v"))
    counts = report.sample_counts(rows, vectors)
    assert "InPandas" not in plan(counts)
    assert counts.first()["window_pairs"] == report.semantic(rows, vectors).first()["pairs"]
