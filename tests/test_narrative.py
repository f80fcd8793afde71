"""Sentences, text lengths and the streamed window."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.numbers import rate_display
from colloquy.operators.narrative import verified
from colloquy.sources.tables import DATE_NAMES, csv_message_rows, csv_messages, csv_rows, csv_stats, find_column, parse_stamp
from colloquy.streaming.window import last_window


@pytest.mark.parametrize(
    ("text", "ok", "unknown"),
    [("32 of 100", False, ["100"]), ("About 0.3 here. And 2 more.", True, []), ("87", False, ["87"]), ("항상 그래요.", False, []), ("One. Two. Three.", False, []), ("", False, [])],
)
def test_a_sentence_may_use_known_numbers_only(spark, text, ok, unknown):
    df = spark.createDataFrame([(text, [0.317])], "text string, numbers array<double>")
    r = verified(df).first()
    assert (r["ok"], r["unknown"]) == (ok, unknown)


@pytest.mark.parametrize(("text", "length", "only"), [("완전 좋아 😃", 5, False), ("😃😃😃😃", 0, True), ("10시", 1, False), ("👨‍👩‍👧", 0, True), ("", 0, False)])
def test_visible_length(spark, text, length, only):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(T.countable_length(F.col("t")).alias("n"), T.is_emoji_only(F.col("t")).alias("only"), T.grapheme_count(F.col("t")).alias("g")).first()
    assert (r["n"], r["only"]) == (length, only)


def test_particles_follow_the_last_sound(spark):
    df = spark.createDataFrame([("당신",), ("상대",), ("Bob",)], "w string")
    assert [r[0] for r in df.select(T.with_particle(F.col("w"), "이", "가")).collect()] == ["당신이", "상대가", "Bob가"]


def test_stamps_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("2018. 6. 25. 오후 8:23",), ("2018-06-25 20:23:59",), ("x",), ("2018-13-45 20:23",)], "t string")
    got = [r[0] for r in df.select(parse_stamp(F.col("t"))).collect()]
    assert got[0] == got[1] is not None and got[2:] == [None, None]


def test_csv_files_become_messages(spark, tmp_path):
    """Columns are found by the order of names, not of the header; without a header by the values of the first row."""
    files = {
        "named.csv": 'time,Date,speaker,msg\nx,2024-01-01 09:00,a,"one, ""two""\nthree"\n,2024-01-01 00:30,b,half past\ny,2024-01-01 00:10,b,zero\nz,bad,b,lost\n',
        "bare.csv": "안녕하세요 반갑습니다,2018. 6. 25. 오후 8:23,나\n네,2018. 6. 25. 오후 8:24,하늘이\n",
        "short.csv": "Date,User,Message\n",
        "undated.csv": "a,b,c\nd,e,f\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content, encoding="utf-8")
    rows = csv_rows(spark, str(tmp_path)).withColumn("chat", F.regexp_extract("chat", r"([a-z]+)\.csv$", 1)).cache()
    got = [tuple(r) for r in csv_messages(rows).orderBy("chat", "pos").select("chat", "pos", "name", "date", "time", "text").collect()]
    assert got == [
        ("bare", 0, "나", "2018-06-25", "20:23", "안녕하세요 반갑습니다"),
        ("bare", 1, "하늘이", "2018-06-25", "20:24", "네"),
        ("named", 0, "b", "2024-01-01", "00:10", "zero"),
        ("named", 1, "b", "2024-01-01", "00:30", "half past"),
        ("named", 2, "a", "2024-01-01", "09:00", 'one, "two"\nthree'),
    ]
    stats = {r["chat"]: (r["messages"], r["unparsed"], r["deleted"], r["multiline"], r["midnight"], r["failure"]) for r in csv_stats(rows).collect()}
    assert stats == {"named": (3, 1, 0, 1, 2, None), "bare": (2, 0, 0, 0, 0, None), "short": (0, 0, 0, 0, 0, "too few rows"), "undated": (0, 0, 0, 0, 0, "no date column")}
    me = spark.createDataFrame([("bare", "나"), ("named", "nobody")], "chat string, name string")
    assert [(r["chat"], r["seq"], r["who"]) for r in csv_message_rows(rows, me).orderBy("seq").collect()] == [("bare", 0, "me"), ("bare", 1, "other")]


def test_columns_are_found_by_whole_names_first(spark):
    df = spark.createDataFrame([(["보낸 날짜", "x"],), (["datetime", "Date (UTC)", "time"],), (["x"],)], "h array<string>")
    assert [r[0] for r in df.select(find_column(F.col("h"), DATE_NAMES)).collect()] == [1, 3, None]


@pytest.mark.parametrize(("text", "masked"), [(" ab", "a●"), ("", ""), ("  ", ""), ("안녕", "안●")])
def test_masks(spark, text, masked):
    assert spark.createDataFrame([(text,)], "t string").select(T.mask_text(F.col("t"))).first()[0] == masked


@pytest.mark.parametrize(
    ("value", "text", "unknown"),
    [(5.0, "5.0 or 5", []), (0.317, "32 but not 31.7", ["31.7"]), (-4.0, "-4 or 4 but not -5", ["-5"]), (0.317, "0.3 and 0.317", []), (31.74, "31.7", []), (31.74, "-31", ["-31"])],
)
def test_forms_of_numbers(spark, value, text, unknown):
    df = spark.createDataFrame([(text, [value])], "t string, v array<double>")
    assert df.select(T.unknown_numbers(F.col("t"), F.col("v"))).first()[0] == unknown


@pytest.mark.parametrize(("x", "n", "shown"), [(30, 60, "50"), (60, 60, "94.1"), (0, 60, "5.9"), (5, 5, "mostly me"), (0, 5, "mostly other"), (2, 5, "similar")])
def test_rates_are_percentages_to_one_place(spark, x, n, shown):
    assert spark.range(1).select(rate_display(F.lit(x), F.lit(n), 20)).first()[0] == shown


def test_streamed_window_equals_the_batch_one(spark, tmp_path):
    for part, seqs in enumerate([range(0, 90), range(90, 200)]):
        rows = [(c, i, "me" if (i * c) % 3 else "other") for c in (1, 2) for i in seqs]
        spark.createDataFrame(rows, "chat long, seq long, who string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chat long, seq long, who string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = last_window(stream).writeStream.outputMode("update").format("memory").queryName("last_window").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = {r["chat"]: r for r in spark.sql("SELECT max_by(struct(*), last_seq) AS r FROM last_window GROUP BY chat").select("r.*").collect()}
    for c in (1, 2):
        assert got[c]["messages"] == 120 and got[c]["me"] == sum(1 for i in range(80, 200) if (i * c) % 3)
