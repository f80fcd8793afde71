"""Queries of screens: lines as a recogniser would give them, drawn from all events, and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display as D
from ..operators import intervals as I
from ..operators import pages as G
from ..operators import promotion as A
from ..operators import screens as V
from ..sources.adapters import from_events
from . import oracle as O
from .queries import register

#: What a page is drawn with: heights of a line, of two lines, of a picture and of a divider; gaps; the first place.
ONE, TWO, PICTURE, DIVIDER, GAP, ROOM, TOP = 32.0, 68.0, 100.0, 30.0, 28.0, 60.0, 100.0
BODY, MORE, NAME = "안녕하세요 정말로반갑습니다", "두 번째 줄입니다", "지연"


def drawn(spark: SparkSession, d: str) -> DataFrame:
    """All events as messages with their place on the page of their chat.

    Stickers are pictures, but for the first and last message; every fifth text has two lines; a second divider
    stands in the middle, between two texts; names stand over texts that answer a text, if there are two such.
    """
    m = from_events(spark, d).select(F.col("chat").alias("page"), "seq", "who", "time", "date", "type")
    page, order = Window.partitionBy("page"), Window.partitionBy("page").orderBy("seq")
    m = m.withColumn("last", F.max("seq").over(page)).withColumn("tx", (F.col("type") != "emoticon") | (F.col("seq") == 0) | (F.col("seq") == F.col("last")))
    after_text = F.coalesce(F.lag("tx").over(order), F.lit(False)) & F.col("tx")
    m = m.withColumns({"after": after_text, "answers": after_text & (F.col("who") == "other") & (F.lag("who").over(order) == "me")})
    m = m.withColumn("divider", F.min(F.when(F.col("after") & (F.col("seq") * 2 > F.col("last")), F.col("seq"))).over(page))
    m = m.withColumn("named", F.col("answers") & ~F.col("seq").eqNullSafe(F.col("divider"))).withColumn("named", F.col("named") & (F.sum(F.col("named").cast("int")).over(page) > 1))
    tall = F.when(~F.col("tx"), PICTURE).when(F.col("seq") % 5 == 0, TWO).otherwise(ONE)
    gap = F.when(F.col("seq") == 0, TOP).when(F.col("seq") == F.col("divider"), GAP + ROOM).otherwise(GAP)
    return m.withColumn("tall", tall).withColumn("bottom", F.sum(tall + gap).over(order)).withColumn("y", F.col("bottom") - F.col("tall"))


def screen_table(spark: SparkSession, d: str) -> DataFrame:
    """Lines of ``drawn`` pages: texts in two pieces, names, dates, glyphs, the input field; every seventh page has no times."""
    m = drawn(spark, d)
    mine, text, picture, timed = F.col("who") == "me", F.col("tx"), ~F.col("tx"), F.col("page") % 7 != 3

    def line(there: Column, number: Column, said: Column, x0: Column, x1: Column, y0: Column, tall: float) -> Column:
        """A line of a message, null where it isn't there."""
        y = y0.cast("double")
        return F.when(there, F.struct(number.cast("long").alias("line"), said.alias("text"), x0.cast("double").alias("x0"), y.alias("y0"), x1.cast("double").alias("x1"), (y + tall).alias("y1")))

    number = lambda k: F.col("seq") * 8 + k
    body = F.concat(F.lit(BODY), (F.col("seq") % 10).cast("string"))
    left = F.when(mine, 330).otherwise(62)
    at = F.when(mine, 240).otherwise(420)
    clock = D.display_time(F.col("time"))
    last = F.col("seq") == F.col("last")
    parts = [
        line(text, number(0), F.substring_index(body, " ", 1), left, left + 120, F.col("y"), ONE),
        line(text, number(1), F.substring_index(body, " ", -1), left + 130, F.when(mine, 578).otherwise(310), F.col("y"), ONE),
        line(text & (F.col("seq") % 5 == 0), number(2), F.lit(MORE), left, F.when(mine, 560).otherwise(290), F.col("y") + TWO - ONE, ONE),
        line(text & timed, number(3), clock, at, at + 70, F.col("y") + 10, 18.0),
        line(picture & timed, number(3), clock, at, at + 70, F.col("y") + 78, 18.0),
        line(picture, number(4), F.lit("↑"), F.lit(300), F.lit(318), F.col("y") + 20, 20.0),
        line(F.col("named"), number(5), F.lit(NAME), F.lit(62), F.lit(100), F.col("y") - 24, 16.0),
        line(F.col("seq") == F.col("divider"), number(6), D.display_date(F.col("date")), F.lit(200), F.lit(400), F.col("y") - GAP - DIVIDER - 1, DIVIDER),
        line(F.col("seq") == 0, F.lit(-2), D.display_date(F.col("date")), F.lit(200), F.lit(400), F.lit(10), DIVIDER),
        line(last, F.lit(-1), F.lit("메시지 입력"), F.lit(62), F.lit(200), F.col("bottom") + 200, ONE),
    ]
    # Every message gives its lines in one pass; the last one's bottom tells the height of the page.
    tall = (F.max(F.when(last, F.col("bottom"))).over(Window.partitionBy("page")) + 400) / 0.9
    lines = m.withColumn("height", tall).select("page", "height", F.inline(F.array_compact(F.array(*parts))))
    return lines.select("page", "line", "text", "x0", "y0", "x1", "y1", F.lit(0.9).alias("confidence"), F.lit(600.0).alias("width"), "height")


DRAWN = f"""
d0 AS (SELECT chat AS page, seq, who, time, date, type, max(seq) OVER (PARTITION BY chat) AS last FROM m),
d1 AS (SELECT *, type <> 'emoticon' OR seq = 0 OR seq = last AS tx FROM d0),
d2 AS (SELECT *, tx AND coalesce(lag(tx) OVER o, false) AS after FROM d1 WINDOW o AS (PARTITION BY page ORDER BY seq)),
d3 AS (SELECT *, min(seq) FILTER (after AND seq * 2 > last) OVER (PARTITION BY page) AS divider FROM d2),
d4 AS (SELECT *, CASE WHEN NOT tx THEN {PICTURE} WHEN seq % 5 = 0 THEN {TWO} ELSE {ONE} END::DOUBLE AS tall, CASE WHEN seq = 0 THEN {TOP} WHEN seq = divider THEN {GAP + ROOM} ELSE {GAP} END::DOUBLE AS gap FROM d3),
d5 AS (SELECT *, sum(tall + gap) OVER o - tall AS y, count(*) FILTER (tx) OVER o AS k FROM d4 WINDOW o AS (PARTITION BY page ORDER BY seq)),
used AS (SELECT DISTINCT page, time FROM d5 WHERE tx),
pic AS (SELECT p.page, p.k, count(*) AS n, min(p.y) AS y1, min(p.seq) AS seq, arg_min(p.time, p.seq) FILTER (u.time IS NULL AND p.page % 7 <> 3) AS time FROM d5 p LEFT JOIN used u ON u.page = p.page AND u.time = p.time WHERE NOT p.tx GROUP BY ALL),
bub AS (SELECT page, k, seq, who, y, y + tall AS low, CASE WHEN page % 7 <> 3 THEN time END AS time, CASE WHEN seq >= divider THEN max(date) FILTER (seq = divider) OVER (PARTITION BY page) ELSE min(date) FILTER (seq = 0) OVER (PARTITION BY page) END AS date FROM d5 WHERE tx),
hol AS (SELECT p.page, p.k, p.seq, b.who, p.time, a.date, CASE WHEN p.page % 7 = 3 THEN a.low WHEN p.n = 1 THEN a.low ELSE p.y1 + 98 END AS y0, CASE WHEN p.page % 7 = 3 THEN b.y WHEN p.n = 1 THEN p.y1 + 76 ELSE p.y1 + {PICTURE + GAP} + 76 END AS y1,
  CASE WHEN a.who = b.who THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM pic p JOIN bub a ON a.page = p.page AND a.k = p.k JOIN bub b ON b.page = p.page AND b.k = p.k + 1)"""
register("screen_holes", lambda spark, d: V.screen_holes(screen_table(spark, d)), O.on_events("SELECT page, who, y0, y1, time, confidence FROM hol", DRAWN))
register(
    "screen_messages",
    lambda spark, d: V.screen_messages(screen_table(spark, d)).select("page", "seq", "who", "date", "time", "type", "text"),
    O.on_events(
        f"""SELECT page, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS seq, who, date, time, type, text FROM (
  SELECT page, seq AS pos, who, date, time, 'text' AS type, '{BODY}' || (seq % 10) || CASE WHEN seq % 5 = 0 THEN chr(10) || '{MORE}' ELSE '' END AS text FROM bub
  UNION ALL SELECT page, seq, who, date, time, 'nontext', NULL FROM hol)""",
        DRAWN,
    ),
)


def order_spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Four months from each order on, and spans of as many days as there are pieces from the day on which an item was sent."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("double")
    bands = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page"), F.lit(0).alias("band"), day("o_orderdate").alias("lo"), (day("o_orderdate") + 120).alias("hi"))
    ways = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("page"), day("l_shipdate").alias("lo"), (day("l_shipdate") + F.col("l_quantity").cast("double")).alias("hi"))
    return bands, ways


register(
    "free_bands",
    lambda spark, d: I.free_bands(*order_spans(spark, d), ["page"], pad=1.0).select("page", "lo", "hi", "free_lo", "free_hi"),
    """WITH b AS (SELECT o_orderkey AS page, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS lo, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE + 120 AS hi FROM orders),
w AS (SELECT l_orderkey AS page, (l_shipdate::DATE - DATE '1970-01-01')::DOUBLE AS a, (l_shipdate::DATE - DATE '1970-01-01')::DOUBLE + l_quantity AS z FROM lineitem),
e AS (SELECT b.page, b.lo, b.hi, greatest(w.a - 1, b.lo) AS a, least(w.z + 1, b.hi) AS z FROM b JOIN w ON w.page = b.page AND w.z > b.lo AND w.a < b.hi),
p AS (SELECT page, lo, hi, lo AS s FROM b UNION SELECT page, lo, hi, z FROM e),
f AS (SELECT p.page, p.lo, p.hi, p.s, coalesce((SELECT min(e.a) FROM e WHERE e.page = p.page AND e.a >= p.s), p.hi) AS t FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page = p.page AND e.a <= p.s AND e.z > p.s)),
g AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY t - s DESC, s) AS k FROM f WHERE t > s)
SELECT b.page, b.lo, b.hi, g.s AS free_lo, g.t AS free_hi FROM b LEFT JOIN g ON g.page = b.page AND g.k = 1""",
)


def last_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Every error with the value of the user's last purchase before it."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "ts", "value")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"), F.col("value").alias("paid"))
    return I.as_of(e.where("event_type = 'error'").select("user_id", "event_id", "ts"), bought, ["user_id"], "ts", ["paid"], tie=["purchase"]).select("user_id", "event_id", "paid")


register(
    "as_of_purchase",
    last_purchases,
    "SELECT e.user_id, e.event_id, p.value AS paid FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON p.user_id = e.user_id AND p.ts < e.ts",
)


def shuffled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Messages on pages that share 5 with the next, numbered out of order; pages of even chats are longer, so there are few."""
    m = from_events(spark, d).withColumn("key", G.message_key(F.col("who"), F.col("text"), F.col("type"), F.col("time")))
    step = F.when(F.col("chat") % 2 == 0, 40).otherwise(20)
    # A page begins only where five messages are left, so that all neighbours share as many.
    m = m.withColumn("last", F.max("seq").over(Window.partitionBy("chat")))
    own = F.least(F.floor(F.col("seq") / step), F.greatest(F.floor((F.col("last") - 4) / step), F.lit(0))).cast("long")
    again = F.when((F.col("seq") - own * step < 5) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    paged = m.select("chat", F.explode(again).alias("true"), "seq", "key")
    # Five and the next prime above any number of pages of a chat have no factor in common.
    return paged.select("chat", ((F.col("true") * 5 + 3) % 10_007).alias("page"), "true", "seq", "key").withColumn("page", F.when(F.col("chat") % 3 == 0, 10_007 - F.col("page")).otherwise((F.col("true") + 1) * 7919 % 10_007))


SHUFFLED = r"""
ky AS (SELECT chat, seq, CASE WHEN chat % 2 = 0 THEN 40 ELSE 20 END AS step, who || ' ' || coalesce(regexp_replace(trim(text), '\s+', ' ', 'g'), '#' || type) || ' ' || coalesce(time, '') AS key FROM m),
kz AS (SELECT *, least(seq // step, greatest(floor((max(seq) OVER (PARTITION BY chat) - 4) / step), 0))::BIGINT AS own FROM ky),
sp AS (SELECT chat, own AS tru, seq, key FROM kz UNION ALL SELECT chat, own - 1, seq, key FROM kz WHERE seq - own * step < 5 AND own > 0),
sq AS (SELECT *, CASE WHEN chat % 3 = 0 THEN 10007 - (tru * 5 + 3) % 10007 ELSE (tru + 1) * 7919 % 10007 END AS page FROM sp),
sk AS (SELECT chat, tru, page, list(key ORDER BY seq) AS ks FROM sq GROUP BY ALL)"""
register(
    "page_links",
    lambda spark, d: G.page_links(shuffled_pages(spark, d)),
    O.on_events("SELECT chat, a, b, overlap FROM (SELECT x.chat, x.page AS a, y.page AS b, list_max(list_filter(range(2, 16), lambda k: k <= len(x.ks) AND k <= len(y.ks) AND x.ks[len(x.ks) - k + 1:] = y.ks[1:k]))::INT AS overlap FROM sk x JOIN sk y ON x.chat = y.chat AND x.page <> y.page) WHERE overlap IS NOT NULL", SHUFFLED),
)
register("page_order", lambda spark, d: G.page_order(shuffled_pages(spark, d)), O.on_events("SELECT chat, page, row_number() OVER (PARTITION BY chat ORDER BY tru) - 1 AS place FROM sk", SHUFFLED))
register(
    "page_restore",
    lambda spark, d: G.merged_pages(G.reordered(shuffled_pages(spark, d).drop("true"))).select("chat", "seq", "key"),
    O.on_events("SELECT chat, seq, key FROM ky", SHUFFLED),
)


def read_pictures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chats whose photos and stickers are not read yet, and what a reader said about each; some of it isn't valid."""
    m = from_events(spark, d)
    bare = F.col("type") != "text"
    nothing = {"type": F.when(bare, "nontext").otherwise(F.col("type")), "emoji_desc": F.lit(None).cast("string"), "valence": F.lit(None).cast("double"), "intensity": F.lit(None).cast("double")}
    place = F.row_number().over(Window.partitionBy("chat").orderBy("seq")) - 1
    v = F.pmod(F.col("seq") * 37, F.lit(250)) / 100.0 - 1.0
    said = m.where(bare).select(
        "chat", place.alias("place"), F.when(F.col("seq") % 4 == 0, place).otherwise(F.lit(-1)).alias("i"), F.when(F.col("seq") % 13 == 0, "video").when(F.col("type") == "photo", "photo").otherwise("emoticon").alias("kind"),
        F.when(F.col("seq") % 17 == 0, "").otherwise(F.concat(F.lit("그림 "), F.repeat(F.lit("가"), (F.col("seq") % 40).cast("int")))).alias("emoji_desc"), v.alias("valence"), F.lit(0.5).alias("intensity"), F.lit(0.75).alias("confidence"),
    )
    return m.withColumns(nothing), said


READ = """
pc AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY seq) - 1 AS place FROM m WHERE type <> 'text'),
rd_ AS (SELECT chat, seq, CASE WHEN seq % 13 = 0 THEN 'video' WHEN type = 'photo' THEN 'photo' ELSE 'emoticon' END AS kind, CASE WHEN seq % 17 = 0 THEN '' ELSE '그림 ' || repeat('가', (seq % 40)::INT) END AS said, (seq * 37 % 250) / 100.0::DOUBLE - 1.0::DOUBLE AS v FROM pc),
ok_ AS (SELECT * FROM rd_ WHERE kind <> 'video' AND said <> '' AND v BETWEEN -1 AND 1)"""
register(
    "promoted",
    lambda spark, d: A.promote(*read_pictures(spark, d)).select("chat", "seq", "type", "emoji_desc", "valence", "intensity", "confidence"),
    O.on_events("SELECT m.chat, m.seq, CASE WHEN m.type = 'text' THEN 'text' ELSE coalesce(o.kind, 'nontext') END AS type, o.said[1:30] AS emoji_desc, o.v AS valence, CASE WHEN o.seq IS NOT NULL THEN 0.5::DOUBLE END AS intensity, CASE WHEN o.seq IS NOT NULL THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence FROM m LEFT JOIN ok_ o ON o.chat = m.chat AND o.seq = m.seq", READ),
)

register(
    "screen_trace",
    lambda spark, d: V.traced(screen_table(spark, d)).groupBy("page", "fate").agg(F.count("*").alias("lines")),
    O.on_events(
        f"""SELECT page, fate, count(*) AS lines FROM (
  SELECT page, unnest(CASE WHEN tx THEN list_concat(['body', 'joined'], CASE WHEN seq % 5 = 0 THEN ['body'] ELSE [] END, CASE WHEN page % 7 <> 3 THEN ['time'] ELSE [] END, CASE WHEN nm AND nn > 1 THEN ['name'] ELSE [] END, CASE WHEN seq = 0 THEN ['date'] ELSE [] END, CASE WHEN seq = last THEN ['control'] ELSE [] END, CASE WHEN seq = divider THEN ['date'] ELSE [] END)
    ELSE list_concat(['glyph'], CASE WHEN page % 7 <> 3 THEN ['time'] ELSE [] END) END) AS fate
  FROM (SELECT *, count(*) FILTER (nm) OVER (PARTITION BY page) AS nn FROM (SELECT *, coalesce(after AND who = 'other' AND lag(who) OVER (PARTITION BY page ORDER BY seq) = 'me' AND seq IS DISTINCT FROM divider, false) AS nm FROM d5))) GROUP BY ALL""",
        DRAWN,
    ),
)


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as JSON documents of pages, one an order; a line without a full box and a broken document are among them."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    box = F.when(F.col("q") % 7 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.5), F.col("q"), F.lit(2.0), F.col("q") + 20))
    text = F.concat(F.lit('line "'), F.col("l_linenumber").cast("string"), F.lit('"'))
    pages = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q", text.alias("text"), box.alias("box"), F.lit(0.5).alias("confidence")))).alias("ls"))
    whole = F.to_json(F.struct(F.lit(600).alias("width"), F.lit(900).alias("height"), F.transform("ls", lambda x: F.struct(x["text"].alias("text"), x["box"].alias("box"), x["confidence"].alias("confidence"))).alias("lines")))
    return pages.select(F.col("l_orderkey").alias("page"), F.when(F.col("l_orderkey") % 10 == 0, F.substring(whole, 1, 30)).otherwise(whole).alias("document"))


register(
    "document_lines",
    lambda spark, d: V.lines_of_documents(page_documents(spark, d)),
    """SELECT page, line, text, 1.5::DOUBLE AS x0, q AS y0, 2.0::DOUBLE AS x1, q + 20 AS y1, 0.5::DOUBLE AS confidence, 600.0::DOUBLE AS width, 900.0::DOUBLE AS height FROM (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS line, 'line "' || l_linenumber || '"' AS text, l_quantity::DOUBLE AS q FROM lineitem) WHERE q % 7 <> 0 AND page % 10 <> 0""",
)
