"""Text exports of chats in three layouts: reading, speakers, and writing them back.

An export is one row (chat, content). Records end with CR LF; a bare LF stays inside its
message. All steps are windows over (chat, pos), so many exports are read at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.display import WEEKDAYS
from ..functions.text import countable_length, trim
from ..storage import stored

#: Fixed patterns of the layouts. Java's $ would allow a last line break, so \z ends them.
TITLE = r"\A(.+?) 님과 카카오톡 대화\z"
DAY_DIVIDER = r"\A-{5,}\s*(\d{4})년 (\d{1,2})월 (\d{1,2})일 [월화수목금토일]요일\s*-{5,}\z"
PC_MESSAGE = r"\A\[(.+?)\] \[(오전|오후) (\d{1,2}):(\d{2})\] ([\s\S]*)\z"
ANDROID_MESSAGE = r"\A(\d{4})년 (\d{1,2})월 (\d{1,2})일 (오전|오후) (\d{1,2}):(\d{2}), (.+?) : ([\s\S]*)\z"
ANDROID_NOTICE = r"\A(\d{4})년 (\d{1,2})월 (\d{1,2})일 (오전|오후) (\d{1,2}):(\d{2}), (.+)\z"
ANDROID_STAMP = r"\A(\d{4})년 (\d{1,2})월 (\d{1,2})일 (오전|오후) (\d{1,2}):(\d{2})\z"
IOS_MESSAGE = r"\A(\d{4})\. (\d{1,2})\. (\d{1,2})\. (?:(오전|오후) )?(\d{1,2}):(\d{2}), (.+?) : ([\s\S]*)\z"
IOS_DAY = r"\A(\d{4})년 (\d{1,2})월 (\d{1,2})일 [월화수목금토일]요일\z"
IOS_SAVED = r"\A(.+?) : (\d{4})\. (\d{1,2})\. (\d{1,2})\. (?:(오전|오후) )?\d{1,2}:\d{2}\z"
NOTICE = r"\A(.+님이 (들어왔|나갔)습니다\.|메시지가 삭제되었습니다\.|관리자가 메시지를 가렸습니다\.|방장이 [\s\S]*변경되었습니다\.[\s\S]*)\z"
SAVED = r"\A저장한 날짜 : "
DELETED, DELETED_PART = "메시지가 삭제되었습니다", "삭제되었습니다"
MEDIA = ((r"\A사진( \d+장)?\z", "photo"), (r"\A동영상\z", "photo"), (r"\A이모티콘\z", "emoticon"), (r"\A음성메시지\z", "voice"), (r"\A파일: ", "file"), (r"\A샵검색: #", "file"))
DETECT_RECORDS = 200
MAX_SPEAKERS = 2


def records(exports: DataFrame) -> DataFrame:
    """(chat, pos, rec): non-empty records in order, without a byte order mark."""
    lines = F.split(F.regexp_replace("content", r"\A\x{FEFF}", ""), "\r\n")
    return exports.select("chat", F.posexplode(lines).alias("pos", "rec"))


def layout_of(rows: DataFrame) -> DataFrame:
    """The layout of each export by its first records; iOS lines also look like others, so they are first."""
    ios, pc = F.col("rec").rlike(IOS_MESSAGE), F.col("rec").rlike(PC_MESSAGE)
    android = F.col("rec").rlike(ANDROID_MESSAGE)
    counts = rows.where(F.col("pos") < DETECT_RECORDS).groupBy("chat").agg(F.count_if(ios).alias("i"), F.count_if(~ios & pc).alias("p"), F.count_if(~ios & ~pc & android).alias("a"))
    kind = F.when((F.col("i") > F.col("p")) & (F.col("i") > F.col("a")), "ios").when((F.col("p") == 0) & (F.col("a") == 0), "unknown").when(F.col("p") >= F.col("a"), "pc").otherwise("android")
    return counts.select("chat", kind.alias("layout"))


def hour24(half: Column, hour: Column) -> Column:
    h = hour.cast("int")
    return F.when((half == "오전") & (h == 12), 0).when((half == "오후") & (h != 12), h + 12).otherwise(h)


def body_type(body: Column) -> Column:
    b, out = trim(body), F.lit("text")
    for pattern, kind in reversed(MEDIA):
        out = F.when(b.rlike(pattern), kind).otherwise(out)
    return out


def laid_out(exports: DataFrame) -> DataFrame:
    """``records`` with the layout of their export; stored, since an export is told by its records before they are read."""
    rows = stored(records(exports), "export-records")
    return rows.join(layout_of(rows), "chat")


def classified(exports: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Records with what each is: message, day, skip, title, deleted, system or rest. ``rows`` are the ``laid_out`` exports."""
    rows = rows or laid_out(exports)
    rec, layout = F.col("rec"), F.col("layout")
    order = Window.partitionBy("chat").orderBy("pos")
    is_message = F.when(layout == "pc", rec.rlike(PC_MESSAGE)).when(layout == "ios", rec.rlike(IOS_MESSAGE)).otherwise(rec.rlike(ANDROID_MESSAGE))
    titled = rec.rlike(TITLE) | ((layout == "ios") & rec.rlike(IOS_SAVED))
    divider = F.when(rec.rlike(DAY_DIVIDER), F.struct(*[F.regexp_extract(rec, DAY_DIVIDER, i).cast("int").alias(n) for i, n in ((1, "y"), (2, "m"), (3, "d"))]))
    rows = rows.withColumns({"day": F.last(divider, ignorenulls=True).over(order), "_message": is_message, "_titled": titled & ~rec.rlike(DAY_DIVIDER)})
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    first_title = rows["_titled"] & ~F.coalesce(F.max("_titled").over(earlier), F.lit(False))
    begun = F.coalesce(F.max("_message").over(earlier), F.lit(False))
    kind = (
        F.when(rec == "", "skip")
        .when(rec.rlike(DAY_DIVIDER), "day")
        .when(rec.rlike(ANDROID_STAMP), "skip")
        .when((layout == "ios") & (rec.rlike(IOS_DAY) | (~begun & rec.rlike(r"(?i)\.txt\z"))), "skip")
        .when(first_title, "title")
        .when(rec.rlike(SAVED), "skip")
        .when(F.col("_message") & ((layout != "pc") | F.col("day").isNotNull()), "message")
        .when(F.col("_message"), "unparsed")
        .when(rec.rlike(NOTICE), F.when(rec.startswith(DELETED), "deleted").otherwise("system"))
        .when((layout == "android") & rec.rlike(ANDROID_NOTICE), F.when(F.regexp_extract(rec, ANDROID_NOTICE, 7).contains(DELETED_PART), "deleted").otherwise("system"))
        .otherwise("rest")
    )
    return rows.withColumn("kind", kind).drop("_message", "_titled")


def raw_messages(exports: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(chat, pos, name, ts, date, time, type, text), and continuation records joined to their message."""
    rows = classified(exports, rows)
    rec, layout = F.col("rec"), F.col("layout")
    part = lambda pc, other: F.when(layout == "pc", F.regexp_extract(rec, PC_MESSAGE, pc)).when(layout == "ios", F.regexp_extract(rec, IOS_MESSAGE, other)).otherwise(F.regexp_extract(rec, ANDROID_MESSAGE, other))
    when = lambda name, i: F.when(layout == "pc", F.col(f"day.{name}")).otherwise(part(1, i).try_cast("int"))
    message = F.col("kind") == "message"
    half = part(2, 4)
    hour = hour24(half, part(3, 5).try_cast("int"))
    order = Window.partitionBy("chat").orderBy("pos")
    rows = rows.withColumns({
        "name": F.when(message, part(1, 7)),
        "y": F.when(message, when("y", 1)),
        "mo": F.when(message, when("m", 2)),
        "d": F.when(message, when("d", 3)),
        "h": F.when(message, hour),
        "mi": F.when(message, part(4, 6).try_cast("int")),
        "body": F.when(message, part(5, 8)),
        "head": F.last(F.when(message, F.col("pos")), ignorenulls=True).over(order),
    })
    rows = rows.withColumn("type", F.when(message, body_type(F.col("body"))))
    joined = rows.where("head IS NOT NULL AND kind IN ('message', 'rest')").groupBy("chat", "head").agg(
        *[F.max(c).alias(c) for c in ("name", "y", "mo", "d", "h", "mi", "type", "body")], F.array_sort(F.collect_list(F.when(F.col("kind") == "rest", F.struct("pos", "rec")))).alias("more")
    )
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    whole = F.when(F.col("type") == "text", F.concat_ws("\n", F.concat(F.array("body"), F.transform("more", lambda x: x["rec"]))))
    return joined.select(
        "chat",
        F.col("head").alias("pos"),
        "name",
        F.unix_millis(F.make_timestamp_ntz("y", "mo", "d", "h", "mi", F.lit(0).cast("decimal(8,6)")).cast("timestamp")).alias("ts"),
        F.concat_ws("-", F.col("y").cast("string"), two("mo"), two("d")).alias("date"),
        F.concat_ws(":", two("h"), two("mi")).alias("time"),
        "type",
        whole.alias("text"),
        F.when(F.col("type") == "text", 0).otherwise(F.size("more")).alias("unparsed"),
    )


def parse_stats(exports: DataFrame) -> DataFrame:
    """What became of the records of each export."""
    rows = laid_out(exports)
    kinds = classified(exports, rows)
    order = Window.partitionBy("chat").orderBy("pos")
    headless = kinds.withColumn("_head", F.max((F.col("kind") == "message").cast("int")).over(order)).groupBy("chat").agg(
        F.count_if(F.col("kind") == "deleted").alias("deleted"),
        F.count_if(F.col("kind") == "system").alias("system"),
        F.count_if((F.col("kind") == "unparsed") | ((F.col("kind") == "rest") & (F.col("_head") == 0))).alias("_unparsed"),
        F.max(F.when(F.col("kind") == "title", F.coalesce(F.nullif(F.regexp_extract("rec", TITLE, 1), F.lit("")), trim(F.regexp_extract("rec", IOS_SAVED, 1))))).alias("title"),
        F.first("layout").alias("layout"),
    )
    messages = raw_messages(exports, rows).groupBy("chat").agg(
        F.count("*").alias("messages"), F.count_if(F.col("text").contains("\n")).alias("multiline"), F.count_if(F.col("time").startswith("00")).alias("midnight"), F.sum("unparsed").alias("_more")
    )
    return headless.join(messages, "chat", "left").select(
        "chat", "layout", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("messages", "multiline", "midnight")], (F.col("_unparsed") + F.coalesce("_more", F.lit(0))).alias("unparsed"), "deleted", "system"
    )


def speakers(raw: DataFrame) -> DataFrame:
    """Speakers of each chat by count, first use breaking ties."""
    each = raw.groupBy("chat", "name").agg(F.count("*").alias("messages"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("pos").alias("_first"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("messages"), "_first"))).drop("_first")


def merge_suggestions(found: DataFrame) -> DataFrame:
    """Minor speakers whose days don't overlap with a major one's: probably the same person renamed."""
    minor, major = found.where(f"place > {MAX_SPEAKERS}").alias("a"), found.where(f"place <= {MAX_SPEAKERS}").alias("b")
    apart = (F.col("a.last_date") < F.col("b.first_date")) | (F.col("b.last_date") < F.col("a.first_date"))
    pairs = minor.join(major, (F.col("a.chat") == F.col("b.chat")) & apart)
    first = Window.partitionBy("a.chat", "a.name").orderBy("b.place")
    return pairs.withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("a.chat").alias("chat"), F.col("a.name").alias("name"), F.col("b.name").alias("same_as"))


def group_check(found: DataFrame, merges: DataFrame) -> DataFrame:
    """Chats that still have more than two speakers after merging are group chats."""
    left = found.join(merges, ["chat", "name"], "left")
    return left.groupBy("chat").agg(F.count_if(F.col("same_as").isNull()).alias("speakers")).withColumn("is_group", F.col("speakers") > MAX_SPEAKERS)


def resolved_sides(found: DataFrame, titles: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(chat, name, who): me is the first speaker who isn't named by the title, or the one whom ``chosen`` (chat, name) names.

    Group chats have no rows, nor have chats without a title or choice, or in which nobody has the name that was chosen.
    """
    merges = merge_suggestions(found)
    pairs = group_check(found, merges).where("NOT is_group").select("chat")
    titled = titles.where(F.col("title").isNotNull())
    if chosen is not None:
        titled = titled.join(chosen.select("chat"), "chat", "left_anti")
    mine = found.join(titled, "chat").where("name <> title").groupBy("chat").agg(F.min_by("name", "place").alias("mine"))
    if chosen is not None:
        mine = mine.union(found.join(chosen, ["chat", "name"], "left_semi").select("chat", F.col("name").alias("mine")))
    sides = found.join(pairs, "chat").join(mine, "chat").join(merges, ["chat", "name"], "left")
    return sides.select("chat", "name", F.when(F.coalesce("same_as", "name") == F.col("mine"), "me").otherwise("other").alias("who"))


def titles_of(exports: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(chat, title): the first title line of each export; null if there is none."""
    rows = rows or laid_out(exports)
    is_title = (F.col("rec").rlike(TITLE) | ((F.col("layout") == "ios") & F.col("rec").rlike(IOS_SAVED))) & ~F.col("rec").rlike(DAY_DIVIDER)
    title = F.coalesce(F.nullif(F.regexp_extract("rec", TITLE, 1), F.lit("")), trim(F.regexp_extract("rec", IOS_SAVED, 1)))
    return rows.groupBy("chat").agg(F.min_by(title, F.when(is_title, F.col("pos"))).alias("title"))


def messages_of(exports: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Message rows of all exports whose sides can be told, by their titles or by ``chosen`` (chat, name)."""
    rows = laid_out(exports)
    return message_rows(stored(raw_messages(exports, rows), "export-messages"), titles_of(exports, rows), chosen)


def message_rows(raw: DataFrame, titles: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Rows of the message schema out of (chat, pos, name, ts, date, time, type, text); names don't go any further."""
    sides = resolved_sides(stored(speakers(raw), "export-speakers"), titles, chosen)
    order = Window.partitionBy("chat").orderBy("pos")
    return raw.join(sides, ["chat", "name"]).select(
        "chat",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "who",
        "ts",
        "date",
        "time",
        "type",
        "text",
        F.coalesce(countable_length(F.col("text")), F.lit(0)).alias("char_count"),
        F.lit(None).cast("string").alias("emoji_desc"),
        F.lit(None).cast("double").alias("valence"),
        F.lit(None).cast("double").alias("intensity"),
        F.lit(1.0).alias("confidence"),
    )


def rendered(messages: DataFrame, layout: str, me: str = "나야", other: str = "하늘") -> DataFrame:
    """Exports (chat, content) of message rows: the reverse of reading, for pc, android and ios."""
    name = F.when(F.col("who") == "me", me).otherwise(other)
    body = F.when(F.col("type") == "photo", "사진").when(F.col("type") == "emoticon", "이모티콘").otherwise(F.col("text"))
    stamp = F.to_timestamp_ntz(F.concat_ws(" ", "date", "time"), F.lit("yyyy-MM-dd HH:mm"))
    hour = F.hour(stamp)
    half = F.when(hour < 12, "오전").otherwise("오후")
    clock = F.concat(half, F.lit(" "), F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":"), F.lpad(F.minute(stamp).cast("string"), 2, "0"))
    y, m, d = (f(stamp).cast("string") for f in (F.year, F.month, F.day))
    new_day = F.lag("date").over(Window.partitionBy("chat").orderBy("seq"))
    if layout == "pc":
        divider = F.when(new_day.isNull() | (new_day != F.col("date")), F.concat(F.lit("--------------- "), y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일 "), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(stamp) + 1), F.lit(" ---------------\r\n"))).otherwise("")
        line = F.concat(divider, F.lit("["), name, F.lit("] ["), clock, F.lit("] "), body)
        head = f"{other} 님과 카카오톡 대화\r\n저장한 날짜 : 2025. 1. 1.\r\n\r\n"
    elif layout == "android":
        line = F.concat(y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일 "), clock, F.lit(", "), name, F.lit(" : "), body)
        head = f"﻿{other} 님과 카카오톡 대화\r\n저장한 날짜 : 2025. 1. 1.\r\n\r\n"
    else:
        line = F.concat(y, F.lit(". "), m, F.lit(". "), d, F.lit(". "), hour.cast("string"), F.lit(":"), F.lpad(F.minute(stamp).cast("string"), 2, "0"), F.lit(", "), name, F.lit(" : "), body)
        head = f"Talk_2025.1.1.txt\r\n{other} : 2025. 1. 1. 10:00\r\n\r\n"
    lines = messages.withColumn("_line", line).groupBy("chat").agg(F.array_sort(F.collect_list(F.struct("seq", "_line"))).alias("_lines"))
    return lines.select("chat", F.concat(F.lit(head), F.array_join(F.transform("_lines", lambda x: x["_line"]), "\r\n")).alias("content"))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(chat, content) of text files, one export a file."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("chat"), F.col("value").alias("content"))


def pair_only(raw: DataFrame, found: DataFrame, first: int = 1, second: int = 2) -> DataFrame:
    """Messages of two speakers of a group, by their places."""
    return raw.join(found.where(F.col("place").isin(first, second)).select("chat", "name"), ["chat", "name"], "left_semi")
