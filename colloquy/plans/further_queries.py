"""Queries of beginnings of chats, blocks for sentences, numbers of documents, payloads and record streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import collect_numbers
from ..operators import metrics as M
from ..operators import narrative as N
from ..operators import pages as Pg
from ..operators import prefixes as P
from ..operators import scoring as G
from ..operators import semantic as E
from ..operators import sequence as S
from ..sources.adapters import from_events
from ..storage import shared_folder, stored
from ..streaming.records import RecordFiles
from ..streaming.sessions import run_once
from . import display
from . import oracle as O
from . import report as R
from .queries import ALL, over_events, over_stored, over_turns, register


def openings(rows: DataFrame) -> DataFrame:
    return P.openings(rows, R.CATALOG, R.NUMBER_NEEDS)


WIN = "e.rk > z.rk - 120"
SAID = "e.type = 'text' AND e.text IS NOT NULL"
#: The counters of every beginning, each counted over its own messages anew.
BEGINNINGS = f"""
pf AS (SELECT z.chat, z.rk AS n, count(*) FILTER ({WIN}) AS wm, count(*) FILTER ({WIN} AND (e.who0 IS NULL OR e.who <> e.who0 OR e.rk = greatest(z.rk - 120, 0) + 1)) AS wbs,
  least(count(*) FILTER ({SAID} AND e.who = 'me'), count(*) FILTER ({SAID} AND e.who = 'other')) AS tx, least(count(*) FILTER ({WIN} AND {SAID} AND e.who = 'me'), count(*) FILTER ({WIN} AND {SAID} AND e.who = 'other')) AS wt,
  count(*) FILTER (e.type = 'emoticon' AND e.valence IS NOT NULL) AS em, count(DISTINCT e.date[1:7]) AS mo, count(DISTINCT e.sess) AS ss, count(t.d) AS rp,
  sum(CASE e.type WHEN 'text' THEN CASE WHEN e.char_count >= 10 THEN 10 WHEN e.char_count >= 3 THEN 7 ELSE 4 END WHEN 'emoticon' THEN CASE WHEN e.valence IS NOT NULL THEN 12 ELSE 1 END WHEN 'photo' THEN 3 WHEN 'nontext' THEN 1 ELSE 0 END) AS tenths,
  ['who', 'type', CASE WHEN bool_and(e.ts IS NOT NULL) THEN 'ts' END, CASE WHEN bool_and(e.date IS NOT NULL) THEN 'date' END, CASE WHEN bool_or(e.time IS NOT NULL) THEN 'time' END, CASE WHEN bool_or(e.text IS NOT NULL) THEN 'text' END,
    CASE WHEN bool_or(e.valence IS NOT NULL) THEN 'affect' END, CASE WHEN bool_and(e.ts IS NOT NULL AND e.date IS NOT NULL) THEN 'continuity' END] AS fields
  FROM e z JOIN e ON e.chat = z.chat AND e.rk <= z.rk LEFT JOIN t ON t.chat = e.chat AND t.seq = e.seq GROUP BY z.chat, z.rk),
pw AS (SELECT *, greatest(wbs - 1, 0) AS wp FROM pf)"""
OPENINGS = " UNION ALL ".join(
    [f"SELECT chat, '{key}' AS metric, min(n) FILTER (list_has_all(fields, {needs}) AND {'true' if counter is None else f'{counter} >= {least}'}) AS opens_at FROM pw GROUP BY chat" for key, needs, least, counter in O.GATES]
    + ["SELECT chat, 'report', min(n) FILTER (tenths >= 100 AND n >= 2) FROM pw GROUP BY chat", "SELECT chat, 'number', min(n) FILTER (wm >= 60) FROM pw GROUP BY chat"]
)
register("openings", over_events(openings), O.on_events(f"SELECT * FROM ({OPENINGS})", BEGINNINGS))
register("openings_turns", over_turns(openings), O.on_turns(f"SELECT * FROM ({OPENINGS})", BEGINNINGS))


def sentence_block(rows: DataFrame, vectors: DataFrame | None = None, crush: bool = False) -> DataFrame:
    """The block of each chat, from its headline, the values of its open gates and its figures."""
    opened = M.initiation(rows).select("chat", F.col("sessions").alias("initiation_sessions"))
    r = R.reported(rows, vectors).withColumns(R.figure_columns()).join(opened, "chat", "left")
    if vectors is not None:
        style = R.semantic(rows, vectors).select("chat", "style_score")
        open_ = R.metric_status(rows, vectors).where("metric = 'styleSep' AND status = 'OK'").select("chat")
        r = r.join(style.join(open_, "chat"), "chat", "left")
    return N.metric_block(r, crush)


def _shown(x: str) -> str:
    return f"regexp_replace(({x})::DOUBLE::VARCHAR, '\\.0$', '')"


def _filled(line: str, *columns: str) -> str:
    parts = line.split("{}")
    return f"'{parts[0]}'" + "".join(f" || {_shown(c)} || '{p}'" for c, p in zip(columns, parts[1:], strict=True))


_LABEL = "CASE band " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.BAND_LABELS.items()) + " END"
_DERIVED = f"concat_ws(chr(10), {', '.join(_filled(*line) for line in N.DERIVED_LINES)})"
BLOCK = f"""SELECT chat, concat_ws(chr(10), CASE WHEN coarse THEN '기울기 방향: ' || CASE WHEN tilt > 0 THEN '당신 쪽' WHEN tilt < 0 THEN '상대 쪽' ELSE '균형' END || chr(10) || '{N.HIDDEN_TILT}' ELSE {_filled("기울기: {}   # -100(상대 쪽) ~ +100(당신 쪽), 0이 균형", "tilt")} END,
  '판정: ' || {_LABEL} || '   # 완결된 문장이다. 그대로 쓰거나 안 쓴다', {_filled("근거 축: {}개 / {}개", "axes_used", "axes_total")}, {_filled("표본: 최근 {}개 메시지", "window_filled")},
  {", ".join(_filled(*line) for line in N.VALUE_LINES[:-1])}, CASE WHEN {_DERIVED} <> '' THEN chr(10) || '{N.DERIVED_HEAD}' || chr(10) || {_DERIVED} END) AS block
FROM (SELECT r.* EXCLUDE (affect_gap, change_month, change_drop), fg.* EXCLUDE (chat), init.sessions AS initiation_sessions, CASE WHEN fg.affect_gap IS NOT NULL THEN ea.me END AS affect_me
  FROM r JOIN fg USING (chat) LEFT JOIN init USING (chat) LEFT JOIN ea USING (chat))"""
register("sentence_block", over_stored(sentence_block), O.on_events(BLOCK, *ALL))
register("sentence_block_turns", over_turns(sentence_block), O.on_turns(BLOCK, *ALL))


def client_payload(rows: DataFrame) -> DataFrame:
    """What a client keeps of a chat: messages by side and type, bursts by side, sessions, months and information units."""
    bursts = S.bursts(rows).groupBy("chat").agg(*[F.count_if(F.col("who") == w).alias(f"bursts_{w}") for w in M.SIDES])
    kinds = ("text", "photo", "emoticon", "file", "voice", "deleted", "nontext")
    counts = rows.groupBy("chat").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("who") == w).alias(w) for w in M.SIDES],
        *[F.count_if(F.col("type") == k).alias(f"type_{k}") for k in kinds],
        F.count_distinct("session").alias("sessions"),
        F.count_distinct(F.substring("date", 1, 7)).alias("months"),
        (F.sum(M.info_tenths()) / 10.0).alias("info_units"),
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("in_window"), F.struct("seq", "who", "type"))))).alias("window"),
    )
    return counts.join(bursts, "chat")


register(
    "client_payload",
    over_events(client_payload),
    O.on_events(
        """SELECT chat, count(*) AS total, count(*) FILTER (who = 'me') AS me, count(*) FILTER (who = 'other') AS other, count(*) FILTER (type = 'text') AS type_text, count(*) FILTER (type = 'photo') AS type_photo, count(*) FILTER (type = 'emoticon') AS type_emoticon,
  0 AS type_file, 0 AS type_voice, 0 AS type_deleted, 0 AS type_nontext, count(DISTINCT sess) AS sessions, count(DISTINCT date[1:7]) AS months, any_value(info_units) AS info_units, '[' || string_agg('{"seq":' || seq || ',"who":"' || who || '","type":"' || type || '"}', ',' ORDER BY seq) FILTER (win) || ']' AS window,
  count(DISTINCT burst) FILTER (who = 'me') AS bursts_me, count(DISTINCT burst) FILTER (who = 'other') AS bursts_other FROM e JOIN (SELECT chat, info_units FROM iu) USING (chat) GROUP BY chat"""
    ),
)


def order_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a nested document whose names and texts hold digits too."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q1"), F.concat(F.lit('say "'), "l_linenumber", F.lit('" \\ 7')).alias("note 2")))).alias("items"))
    return lines.select("l_orderkey", F.to_json(F.struct(F.lit(-1.5).alias("level0"), F.struct("items", F.lit(None).cast("int").alias("none")).alias("in 3"))).alias("document"))


register(
    "document_numbers",
    lambda spark, d: order_documents(spark, d).select("l_orderkey", F.array_join(F.transform(collect_numbers(F.col("document")), lambda x: F.format_string("%.2f", x)), " ").alias("numbers")),
    "SELECT l_orderkey, '-1.50 ' || string_agg(printf('%.2f %.2f', l_linenumber::DOUBLE, l_quantity::DOUBLE), ' ' ORDER BY l_linenumber, l_quantity) AS numbers FROM lineitem GROUP BY l_orderkey",
)


def record_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of text files, read back as a stream of records; the files are cut into small stretches."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    line = F.concat_ws("\t", "event_id", "event_type", F.when(F.col("event_id") % 9 == 0, F.lit("한\n글")).otherwise(F.lit("-")))
    spark.read.parquet(f"{d}/events.parquet").select(line.alias("value")).write.option("lineSep", "\r\n").text(folder)
    spark.dataSource.register(RecordFiles)
    found = run_once(spark.readStream.format("crlf_records").option("path", folder).option("part", 1 << 16).load(), spark)
    parts = F.split("record", "\t")
    return found.select(parts[0].cast("long").alias("event_id"), parts[1].alias("event_type"), F.length(parts[2]).alias("rest"))


register("record_stream", record_stream, "SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN 3 ELSE 1 END AS rest FROM events")


def known_vectors(spark: SparkSession, d: str, texts: DataFrame) -> DataFrame:
    """(text, v): each distinct text with the vector that its length names in the table of vectors."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("_n"), F.col("embedding").cast("array<double>").alias("v"))
    return texts.withColumn("_n", F.length("text") % 50).join(v, "_n").select("text", "v")


def with_known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(S.enriched(from_events(spark, d)), "messages")
    return rows, E.with_vectors(rows, known_vectors(spark, d, E.texts_to_embed(rows)))


SPOKEN = rf"""
em_ AS (SELECT chat, seq, who, win, text FROM e WHERE type = 'text' AND text IS NOT NULL AND length_grapheme(regexp_replace(text, '[{O.BLANKS}.,!?~]', '', 'g')) > 2),
ew_ AS (SELECT *, lag(who) OVER (PARTITION BY chat ORDER BY seq) AS w0 FROM em_ WHERE win),
flv AS (SELECT chat, CASE WHEN chat IN (SELECT chat FROM em_) THEN list_append(fields, 'embedding') ELSE fields END AS fields FROM fl),
ctv AS (SELECT ct.* EXCLUDE (wp), coalesce(p.n, 0) AS wp FROM ct LEFT JOIN (SELECT chat, count(*) FILTER (w0 <> who) AS n FROM ew_ GROUP BY chat) p USING (chat)),
st AS ("""
register("texts_to_embed", lambda spark, d: E.texts_to_embed(from_events(spark, d)), O.on_events("SELECT DISTINCT text FROM em_", O.STATUS.replace("\nst AS (", SPOKEN)))
register(
    "metric_status_vectors",
    lambda spark, d: R.metric_status(*with_known(spark, d)),
    O.on_events("SELECT chat, metric, status FROM st", O.STATUS.replace("\nst AS (", SPOKEN).replace("FROM fl f JOIN ct c", "FROM flv f JOIN ctv c")),
)
register("headline_vectors", lambda spark, d: R.headline(*with_known(spark, d)))
register("metric_cards_vectors", lambda spark, d: display.metric_cards(*with_known(spark, d)).where("metric IN ('syncAsym', 'styleSep')").select("chat", "metric", "kind", "me", "other", "value", "max", "note"))
register("tilt_spread", over_events(lambda e: G.spread(R.headline(e), "tilt", "window_filled")), O.on_events("SELECT count(*) AS chats, max(tilt) - min(tilt) AS tilt_spread, max(window_filled) - min(window_filled) AS window_filled_spread FROM hd"))


def damaged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Messages as they were, and as a bad recogniser gives them: some lost, blanks set, sides and times wrong."""
    m = from_events(spark, d).withColumn("page", F.col("chat"))
    truth = m.select("page", "seq", "who", F.when(F.col("seq") % 3 > 0, F.col("time")).alias("time"), "type", F.concat("text", F.lit(" "), (F.col("seq") % 9).cast("string")).alias("text"))
    found = truth.where("seq % 7 <> 0").select(
        "page", "seq", F.when(F.col("seq") % 11 == 0, "me").otherwise(F.col("who")).alias("who"), F.when(F.col("seq") % 5 > 0, F.col("time")).alias("time"), F.when(F.col("type") == "text", "text").otherwise("nontext").alias("type"), F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("\n "))).alias("text")
    )
    return found, truth


DAMAGED = """
tr AS (SELECT chat AS page, seq, who, CASE WHEN seq % 3 > 0 THEN time END AS time, type, replace(text || ' ' || (seq % 9), ' ', '') AS k FROM m),
fo AS (SELECT page, seq, CASE WHEN seq % 11 = 0 THEN 'me' ELSE who END AS who, CASE WHEN seq % 5 > 0 THEN time END AS time, type, k FROM tr WHERE seq % 7 <> 0),
f1 AS (SELECT page, k, count(*) AS n, arg_min(who, seq) AS who, arg_min({'t': time}, seq).t AS time FROM fo WHERE type = 'text' GROUP BY ALL),
tm AS (SELECT t.page, t.who, t.time, f.k IS NOT NULL AS hit, f.who AS fw, f.time AS ft, coalesce(t.nth <= f.n, false) AS paired FROM (SELECT *, row_number() OVER (PARTITION BY page, k ORDER BY seq) AS nth FROM tr WHERE type = 'text') t LEFT JOIN f1 f ON f.page = t.page AND f.k = t.k)"""
register(
    "recognition_scores",
    lambda spark, d: G.scores(*damaged(spark, d)),
    O.on_events(
        """SELECT page, texts, text_hits, paired, side_hits, timed, time_hits, pictures, holes FROM (SELECT page, count(*) AS texts, count(*) FILTER (hit) AS text_hits, count(*) FILTER (paired) AS paired, count(*) FILTER (fw = who) AS side_hits, count(time) AS timed, count(*) FILTER (ft = time) AS time_hits FROM tm GROUP BY page)
  JOIN (SELECT page, count(*) FILTER (type <> 'text') AS pictures FROM tr GROUP BY page) USING (page) JOIN (SELECT page, count(*) FILTER (type <> 'text') AS holes FROM fo GROUP BY page) USING (page)""",
        DAMAGED,
    ),
)


def tiled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as lines of a tall page a month, read in tiles: what stands where two tiles overlap is read twice, a little apart."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    y = (F.col("l_orderkey") * 7 + F.col("l_linenumber")).cast("double") * 20
    page = (F.col("l_orderkey") % 40).cast("long")
    at = lines.select(page.alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (y % 20_000).alias("y"), F.concat(F.lit("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).alias("text")).distinct()
    pages = at.groupBy("page").agg(F.lit(21_000.0).alias("height"))
    read = at.join(Pg.tiles(pages), "page").where((F.col("y") >= F.col("top")) & (F.col("y") + 30 <= F.col("bottom")))
    seen = read.select("page", "tile", (F.col("id") * 16 + F.col("tile")).alias("line"), "text", (F.lit(60.0) + F.col("tile") % 2 * 5).alias("x0"), (F.col("y") - F.col("top") + F.col("tile") % 2 * 9).alias("y0"), F.lit(200.0).alias("x1"), (F.col("y") - F.col("top") + 30).alias("y1"), (F.lit(0.5) + (F.col("tile") % 3) * 0.1).alias("confidence"), F.lit(600.0).alias("width"))
    return Pg.lines_of_tiles(seen, pages)


register(
    "tile_lines",
    lambda spark, d: tiled_lines(spark, d).select("page", "line", "text", "y0"),
    """WITH at_ AS (SELECT DISTINCT l_orderkey % 40 AS page, l_orderkey * 10 + l_linenumber AS id, ((l_orderkey * 7 + l_linenumber) * 20 % 20000)::DOUBLE AS y FROM lineitem),
rd_ AS (SELECT a.page, a.id, a.y, t.i, a.id * 16 + t.i AS line, 0.5 + (t.i % 3) * 0.1 AS c, row_number() OVER (PARTITION BY a.page, a.id ORDER BY (t.i % 3) DESC, t.i) AS k FROM at_ a JOIN (SELECT unnest(range(0, 8)) AS i) t ON a.y >= t.i * 2700 AND a.y + 30 <= least(21000, t.i * 2700 + 3000))
SELECT page, line, 't' || id AS text, y + i % 2 * 9 AS y0 FROM rd_ WHERE k = 1""",
)
