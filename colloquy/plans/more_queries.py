"""Queries of sources, pages, vectors, texts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import rate_display
from ..operators import pages as G
from ..operators import semantic as V
from ..sources import exports as X
from ..sources import tables as C
from ..sources.adapters import from_events
from ..storage import stored
from ..streaming import sessions as L
from . import oracle as O
from .queries import register

LAYOUTS = ("pc", "android", "ios")


def round_trip(layout: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return X.messages_of(X.rendered(from_events(spark, d), layout)).select("chat", "seq", "who", "ts", "date", "time", "type", "text", "char_count")

    return run


for layout in LAYOUTS:
    register(f"export_{layout}", round_trip(layout), O.on_events("SELECT chat, seq, who, ts, date, time, type, text, char_count FROM m"))


def detect(spark: SparkSession, d: str) -> DataFrame:
    events = stored(from_events(spark, d).select("chat", "seq", "who", "date", "time", "type", "text"), "detect-events")  # read once for each layout
    found = None
    for layout in LAYOUTS:
        one = X.layout_of(X.records(X.rendered(events, layout))).withColumn("written", F.lit(layout))
        found = one if found is None else found.unionByName(one)
    return found


register("detect_format", detect, O.on_events("SELECT chat, l AS layout, l AS written FROM (SELECT DISTINCT chat FROM m) CROSS JOIN (SELECT unnest(['pc', 'android', 'ios']) AS l)"))
register(
    "parse_stats",
    lambda spark, d: X.parse_stats(X.rendered(from_events(spark, d), "pc")),
    O.on_events("SELECT chat, 'pc' AS layout, '하늘' AS title, count(*) AS messages, 0::BIGINT AS multiline, count(*) FILTER (time[1:2] = '00') AS midnight, 0::BIGINT AS unparsed, 0::BIGINT AS deleted, 0::BIGINT AS system FROM m GROUP BY chat"),
)
register(
    "speaker_stats",
    lambda spark, d: X.speakers(X.raw_messages(X.rendered(from_events(spark, d), "android"))),
    O.on_events("SELECT chat, CASE WHEN who = 'me' THEN '나야' ELSE '하늘' END AS name, count(*) AS messages, min(date) AS first_date, max(date) AS last_date, row_number() OVER (PARTITION BY chat ORDER BY count(*) DESC, min(seq)) AS place FROM m GROUP BY chat, who"),
)

#: A speaker for each event type, with days that may or may not overlap.
SPEAKERS = "SELECT *, row_number() OVER (PARTITION BY chat ORDER BY messages DESC, name) AS place FROM (SELECT user_id // 3 AS chat, spoken AS name, count(*) AS messages, strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date FROM (SELECT *, event_type || CASE WHEN day(ts) <= 10 THEN ' early' WHEN day(ts) <= 20 THEN '' ELSE ' late' END AS spoken FROM events) GROUP BY ALL)"


def speakers(spark: SparkSession, d: str) -> DataFrame:
    """A speaker for each kind of event in each third of the month, so that days of some don't overlap."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.dayofmonth("ts")
    name = F.concat("event_type", F.when(day <= 10, " early").when(day <= 20, "").otherwise(" late"))
    each = e.groupBy(F.floor(F.col("user_id") / 3).cast("long").alias("chat"), name.alias("name")).agg(
        F.count("*").alias("messages"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_date")
    )
    return each.withColumn("place", F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("messages"), "name")))


MERGES = f"sp AS ({SPEAKERS}), mg AS (SELECT a.chat, a.name, arg_min(b.name, b.place) AS same_as FROM sp a JOIN sp b ON a.chat = b.chat AND a.place > 2 AND b.place <= 2 AND (a.last_date < b.first_date OR b.last_date < a.first_date) GROUP BY ALL)"
register("merge_suggestions", lambda spark, d: X.merge_suggestions(speakers(spark, d)), O.q("SELECT chat, name, same_as FROM mg", MERGES))
register(
    "group_check",
    lambda spark, d: X.group_check(s := speakers(spark, d), X.merge_suggestions(s)),
    O.q("SELECT sp.chat, count(*) FILTER (mg.name IS NULL) AS speakers, count(*) FILTER (mg.name IS NULL) > 2 AS is_group FROM sp LEFT JOIN mg ON mg.chat = sp.chat AND mg.name = sp.name GROUP BY sp.chat", MERGES),
)


def stamps(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    half = F.when(F.hour("ts") < 12, "오전").otherwise("오후")
    h12 = F.when(F.hour("ts") % 12 == 0, 12).otherwise(F.hour("ts") % 12).cast("string")
    iso = F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    ko = F.concat(F.date_format("ts", "yyyy. M. d. "), half, F.lit(" "), h12, F.lit(":"), F.date_format("ts", "mm"))
    return e.select("event_id", C.parse_stamp(iso).alias("iso"), C.parse_stamp(ko).alias("korean"), C.parse_stamp(F.lit("no date")).alias("none"))


register("csv_stamp", stamps, "SELECT event_id, epoch_ms(date_trunc('minute', ts)) AS iso, epoch_ms(date_trunc('minute', ts)) AS korean, NULL::BIGINT AS none FROM events")

EMOJI_TEXT = "text || CASE WHEN doc_id % 3 = 0 THEN ' 😃 10시' WHEN doc_id % 3 = 1 THEN '👍🏽' ELSE '' END"


def lengths(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{EMOJI_TEXT} AS t")
    return t.select("doc_id", T.grapheme_count(F.col("t")).alias("graphemes"), T.countable_length(F.col("t")).alias("countable"), T.has_emoji(F.col("t")).alias("emoji"))


register("text_lengths", lengths, f"SELECT doc_id, length_grapheme(t) AS graphemes, {O.visible('t')} AS countable, regexp_matches(t, '[{T.EMOJI}]') AS emoji FROM (SELECT doc_id, {EMOJI_TEXT} AS t FROM documents)")
register(
    "mask_text",
    lambda spark, d: spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", T.mask_text(F.col("text")).alias("masked")),
    r"SELECT conv_id, turn, CASE WHEN t = '' THEN t ELSE t[1:1] || repeat('●', length(t) - 1) END AS masked FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)",
)
#: Sentences about an order line: its discount as a percentage, its quantity, its price to one place, and a difference.
LINE_NOTE = "'off ' || cast(cast(floor(l_discount * 100 + 0.5) AS int) AS string) || ', ' || cast(cast(l_quantity AS int) AS string) || ' at ' || cast(l_extendedprice AS string) || ' or ' || cast(cast(l_quantity AS int) - 25 AS string) || ', 2 of 87.5'"


def verify_numbers(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("note", F.expr(LINE_NOTE))
    known = F.array(F.col("l_discount").cast("double"), F.col("l_quantity").cast("double"), -F.col("l_quantity").cast("double"), F.lit(87.45))
    return lines.select("l_orderkey", "l_linenumber", F.array_join(T.unknown_numbers(F.col("note"), known), ",").alias("unknown"))


FORM = "list_transform([x.d, x.q, -x.q, 87.45::DOUBLE], lambda v: [regexp_replace(v::VARCHAR, '\\.0$', ''), floor(v + 0.5)::BIGINT::VARCHAR, floor(v * 100 + 0.5)::BIGINT::VARCHAR, printf('%.1f', v), abs(floor(v + 0.5))::BIGINT::VARCHAR, regexp_replace(abs(v)::VARCHAR, '\\.0$', '')])"
register(
    "verify_numbers",
    verify_numbers,
    f"""SELECT l_orderkey, l_linenumber, array_to_string(list_filter(found, lambda n: NOT list_contains(list_concat(flatten({FORM}), ['0', '1', '2', '3']), n)), ',') AS unknown
FROM (SELECT *, regexp_extract_all(note, '-?[0-9]+(?:\\.[0-9]+)?') AS found FROM (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS d, l_quantity::DOUBLE AS q, {LINE_NOTE} AS note FROM lineitem)) x""",
)
register(
    "rate_display",
    lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 25).alias("x"), F.count("*").alias("n")).select("l_orderkey", rate_display(F.col("x"), F.col("n"), 4).alias("shown")),
    f"SELECT l_orderkey, CASE WHEN n < 6 THEN CASE WHEN p >= 0.6 THEN 'mostly me' WHEN p <= 0.4 THEN 'mostly other' ELSE 'similar' END ELSE regexp_replace(({O.up('p * 1000')} / 10)::DOUBLE::VARCHAR, '\\.0$', '') END AS shown FROM (SELECT l_orderkey, count(*) AS n, (count(*) FILTER (l_quantity > 25) + 4.0::DOUBLE) / (count(*) + 8) AS p FROM lineitem GROUP BY 1)",
)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("label").cast("long").alias("chat"), F.col("vec_id").alias("seq"), F.when(F.col("vec_id") % 2 == 0, "me").otherwise("other").alias("who"), F.col("embedding").cast("array<double>").alias("v"))


VECTORS = """
ve AS (SELECT label::BIGINT AS chat, vec_id AS seq, CASE WHEN vec_id % 2 = 0 THEN 'me' ELSE 'other' END AS who, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
vl AS (SELECT *, lag(who) OVER o AS who0, lag(v) OVER o AS v0 FROM ve WINDOW o AS (PARTITION BY chat ORDER BY seq)),
vp AS (SELECT chat, seq, who AS responder, v0 AS a, v AS b, sqrt(list_inner_product(v0, v0)) AS na, sqrt(list_inner_product(v, v)) AS nb FROM vl WHERE who0 <> who),
vd AS (SELECT chat, responder, i, sum(a[i] / na) AS sa, sum(b[i] / nb) AS sb, sum(a[i] / na * (b[i] / nb)) AS own, count(*) AS n FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM vp) GROUP BY ALL),
vs AS (SELECT chat, responder, sum(own) AS own, sum(sa * sb) AS al, max(n) AS n FROM vd GROUP BY ALL)"""
BASE = "(CASE WHEN n < 2 THEN 0 ELSE (al - own) / (n * (n - 1)) END)"
register("sync_exact", lambda spark, d: V.sync_exact(V.reply_pairs(vectors(spark, d))), O.q(f"SELECT chat, responder, n AS pairs, {O.up('own / n', 3)} AS raw, {O.up(BASE, 3)} AS base, {O.up(f'own / n - {BASE}', 3)} AS net FROM vs", VECTORS))
register("sync_seeded", lambda spark, d: V.sync_seeded(V.reply_pairs(vectors(spark, d))))
register(
    "style_sep",
    lambda spark, d: V.style_separation(vectors(spark, d)),
    O.q(
        f"SELECT chat, {O.up('100 * tanh(ratio)')}::BIGINT AS score, {O.up('ratio', 3)} AS ratio, vectors_me, vectors_other FROM (SELECT chat, CASE WHEN w = 0 OR vectors_me = 0 OR vectors_other = 0 THEN 0 ELSE b / w END AS ratio, vectors_me, vectors_other FROM sd JOIN sc USING (chat))",
        VECTORS,
        """sx AS (SELECT chat, i, avg(v[i]) FILTER (who = 'me') AS mm, avg(v[i]) FILTER (who = 'other') AS mo, avg(v[i] * v[i]) FILTER (who = 'me') AS qm, avg(v[i] * v[i]) FILTER (who = 'other') AS qo FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ve) GROUP BY ALL),
sd AS (SELECT chat, sqrt(sum((mm - mo) ** 2)) AS b, (sqrt(greatest(sum(qm - mm ** 2), 0)) + sqrt(greatest(sum(qo - mo ** 2), 0))) / 2 AS w FROM sx GROUP BY chat),
sc AS (SELECT chat, count(*) FILTER (who = 'me') AS vectors_me, count(*) FILTER (who = 'other') AS vectors_other FROM ve GROUP BY chat)""",
    ),
)


def screen_lines(spark: SparkSession, d: str) -> DataFrame:
    """Messages as lines on a screen of 600 pixels: mine end at 578, the other's begin at 62."""
    m = from_events(spark, d)
    wide = 20.0 + 9.0 * F.col("char_count")
    mine = F.col("who") == "me"
    return m.select(
        F.col("chat").alias("page"),
        F.col("seq").alias("line"),
        F.coalesce("text", "type").alias("text"),
        F.when(mine, 578.0 - wide).otherwise(62.0).alias("x0"),
        (F.col("seq") * 40.0).alias("y0"),
        F.when(mine, 578.0).otherwise(62.0 + wide).alias("x1"),
        (F.col("seq") * 40.0 + 32.0).alias("y1"),
        F.lit(0.9).alias("confidence"),
        F.lit(600.0).alias("width"),
    )


SCREEN = "ln AS (SELECT chat AS page, seq AS line, who, CASE WHEN who = 'me' THEN 578.0 - 20 - 9 * char_count ELSE 62.0 END::DOUBLE AS x0, CASE WHEN who = 'me' THEN 578.0 ELSE 82.0 + 9 * char_count END::DOUBLE AS x1 FROM m)"
register("page_sides", lambda spark, d: G.side(screen_lines(spark, d)).select("page", "line", "who"), O.on_events("SELECT page, line, CASE WHEN 600 - x1 < x0 THEN 'me' ELSE 'other' END AS who FROM ln", SCREEN))
register(
    "page_columns",
    lambda spark, d: G.column_of(screen_lines(spark, d)),
    O.on_events(
        "SELECT page, k AS lines, xs[(k // 2 + 1)::INT] AS column FROM (SELECT a.page, a.x0 AS low, count(*) AS k, list_sort(list(b.x0)) AS xs, row_number() OVER (PARTITION BY a.page ORDER BY count(*) DESC, a.x0 DESC) AS r FROM (SELECT DISTINCT page, x0 FROM ln) a JOIN ln b ON a.page = b.page AND b.x0 >= a.x0 AND b.x0 <= a.x0 + 30 GROUP BY 1, 2) WHERE r = 1",
        SCREEN,
    ),
)
register(
    "page_bubbles",
    lambda spark, d: G.bubbles(screen_lines(spark, d)).select("page", "bubble", "who", "lines"),
    O.on_events(
        "SELECT page, g - 1 AS bubble, any_value(side) AS who, count(*) AS lines FROM (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY line) AS g FROM (SELECT *, CASE WHEN side = lag(side) OVER w AND abs(x0 - lag(x0) OVER w) <= 12 THEN 0 ELSE 1 END AS b FROM sd WINDOW w AS (PARTITION BY page ORDER BY line))) GROUP BY page, g",
        SCREEN,
        "sd AS (SELECT *, CASE WHEN 600 - x1 < x0 THEN 'me' ELSE 'other' END AS side FROM ln)",
    ),
)


def paged(spark: SparkSession, d: str) -> DataFrame:
    """Messages on pages of 25 of which the last 5 stand on the next page too."""
    m = from_events(spark, d).withColumn("key", G.message_key(F.col("who"), F.col("text"), F.col("type"), F.col("time")))
    own = F.floor(F.col("seq") / 20).cast("long")
    again = F.when((F.col("seq") % 20 < 5) & (F.col("seq") >= 20), F.array(own - 1, own)).otherwise(F.array(own))
    return m.select("chat", F.explode(again).alias("page"), "seq", "key")


PAGED = r"""
ky AS (SELECT chat, seq, who || ' ' || coalesce(regexp_replace(trim(text), '\s+', ' ', 'g'), '#' || type) || ' ' || coalesce(time, '') AS key FROM m),
pg AS (SELECT chat, seq // 20 AS page, seq, key FROM ky UNION ALL SELECT chat, seq // 20 - 1, seq, key FROM ky WHERE seq % 20 < 5 AND seq >= 20),
pl AS (SELECT chat, page, list(key ORDER BY seq) AS ks FROM pg GROUP BY ALL),
pb AS (SELECT *, lag(ks) OVER (PARTITION BY chat ORDER BY page) AS b FROM pl)"""
OVERLAP = "coalesce(list_max(list_filter(range(2, 16), lambda k: k <= len(ks) AND k <= len(b) AND b[len(b) - k + 1:len(b)] = ks[1:k])), 0)::INT"
MERGED = f"pm AS (SELECT pg.*, row_number() OVER (PARTITION BY pg.chat, pg.page ORDER BY seq) AS nth, o.overlap FROM pg LEFT JOIN (SELECT chat, page, {OVERLAP} AS overlap FROM pb WHERE b IS NOT NULL) o ON o.chat = pg.chat AND o.page = pg.page)"
register(
    "page_overlap",
    lambda spark, d: G.page_overlaps(paged(spark, d)),
    O.on_events(f"SELECT chat, page, {OVERLAP} AS overlap FROM pb WHERE b IS NOT NULL", PAGED),
)
register("page_merge", lambda spark, d: G.merged_pages(paged(spark, d)).select("chat", "seq", "key"), O.on_events("SELECT chat, row_number() OVER (PARTITION BY chat ORDER BY page, nth) - 1 AS seq, key FROM pm WHERE nth > coalesce(overlap, 0)", PAGED, MERGED))


def labels(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    half = F.when(F.hour("ts") < 12, "오전").otherwise("오후")
    h12 = F.when(F.hour("ts") % 12 == 0, 12).otherwise(F.hour("ts") % 12).cast("string")
    return e.select(
        "event_id",
        G.time_label(F.concat(half, F.lit(" "), h12, F.lit(":"), F.date_format("ts", "mm"))).alias("time"),
        G.date_label(F.concat(F.date_format("ts", "yyyy"), F.lit("년 "), F.month("ts").cast("string"), F.lit("월 "), F.dayofmonth("ts").cast("string"), F.lit("일 토요일>"))).alias("date"),
    )


register("screen_labels", labels, "SELECT event_id, strftime(ts, '%H:%M') AS time, strftime(ts, '%Y-%m-%d') AS date FROM events")
register(
    "stream_sessions",
    lambda spark, d: L.run_once(L.session_counts(L.event_stream(spark, d)), spark).select("chat", "messages", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("last_at").alias("last_ms")),
    O.q(
        "SELECT chat, count(*) AS messages, min(t) AS first_ms, max(t) AS last_ms FROM (SELECT *, sum(CASE WHEN t - p >= 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY chat ORDER BY t, id) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY chat ORDER BY t, id) AS p FROM tt)) GROUP BY chat, g HAVING max(t) + 21600000 <= (SELECT max(t) FROM tt) - 86400000",
        "tt AS (SELECT user_id // 3 AS chat, epoch_ms(date_trunc('minute', ts)) AS t, event_id AS id FROM events)",
    ),
)
