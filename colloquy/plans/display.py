"""Cards and badges of a conversation, out of its metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions.numbers import half_up
from ..operators import metrics as M
from ..operators import phrases as P
from ..operators import sequence as S
from ..sources import tables as C
from ..sources.adapters import from_events
from . import oracle as O
from . import report as R
from .queries import VARIETY, over_events, over_orders, over_pooled, over_stored, register


def evidence_badge(rows: DataFrame) -> DataFrame:
    """On what a reading rests: messages, window, months and sessions where dates are known, else messages alone."""
    dated = F.when(F.col("date").isNotNull(), F.col("seq"))
    c = rows.groupBy("chat").agg(
        F.count("*").alias("n"), F.count_if("in_window").alias("window"), F.min_by("date", dated).alias("first"), F.max_by("date", dated).alias("last"), F.count_distinct("session").alias("sessions"), F.bool_and(F.col("ts").isNotNull()).alias("timed")
    )
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    whole = F.concat_ws(
        " · ",
        text("메시지 ", F.format_number("n", 0), "개 중 최근 ", F.col("window").cast("string"), "개로 산출"),
        text(D.month_span(F.col("first"), F.col("last")).cast("string"), "개월"),
        text("세션 ", F.col("sessions").cast("string"), "개"),
    )
    return c.select("chat", F.when(F.col("timed"), whole).otherwise(text("메시지 ", F.col("n").cast("string"), "개 · 캡처 구간")).alias("badge"))


#: Fixed notes and texts of the cards.
QUESTION_NOTE, REPLY_NOTE, SILENT_NOTE = "질문이 담긴 차례의 비율", "5분 안에 답한 비율 · 표본 ", "말을 걸었는데 답이 안 온 비율"
SYNC_NOTE, STYLE_NOTE = "무작위 짝 기준선을 뺀 값 · 높을수록 상대에게 맞춘다", "높을수록 서로 다르게 말해요"
DELETED_NOTE, NOTHING_DELETED = "지웠다는 것만 남아 있어요", "지운 메시지가 없어요"
SESSIONS_NOTE, NO_WAKE_NOTE = ("세션 ", "개 기준"), " · 기상 보정 미적용"
AFFECT_NOTE, VARIETY_NOTE, PHRASE_NOTE = "−1(부정) ~ +1(긍정)", "같은 것만 반복하면 낮다", "상대는 안 쓰는데 나만 쓰는 말"
NO_CHANGE, COOLED, HOTTEST = "뚜렷하게 식은 지점은 없어요", "월부터 줄었어요", ("가장 뜨거웠던 달은 ", "월 (", "건)")
#: Phrases of a side on its card.
CHIPS = 3


def card(metric: str, kind: Column | str, me: Column | None = None, other: Column | None = None, value: Column | None = None, most: float | Column | None = None, unit: str = "", note: Column | str | None = None, text: Column | None = None, chips: tuple[Column, Column] | None = None) -> Column:
    column = lambda c, to: (c if isinstance(c, Column) else F.lit(c)).cast(to)
    numbers = [column(c, "double").alias(k) for k, c in (("me", me), ("other", other), ("value", value), ("max", most))]
    lists = [column(c, "array<string>").alias(k) for k, c in zip(("chips_me", "chips_other"), chips or (None, None), strict=True)]
    return F.struct(F.lit(metric).alias("metric"), column(kind, "string").alias("kind"), *numbers, column(unit, "string").alias("unit"), column(note, "string").alias("note"), column(text, "string").alias("text"), *lists)


def phrase_lists(rows: DataFrame, most: int = CHIPS) -> DataFrame:
    """(chat, chips_me, chips_other): the first phrases of each side; empty where a side has none."""
    found = P.phrase_gap(rows).where(F.col("place") <= most)
    of = lambda w: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == w, F.struct("place", "gram")))), lambda x: x["gram"]).alias(f"chips_{w}")
    return found.groupBy("chat").agg(of("me"), of("other"))


def shown_values(rows: DataFrame, vectors: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """One row a chat with what the cards of all 14 metrics show, gates aside."""
    pair = lambda df, name, me="me", other="other": df.select("chat", F.col(me).alias(f"{name}_me"), F.col(other).alias(f"{name}_other"))
    opened = M.initiation(rows)
    months = M.monthly(rows).groupBy("chat").agg(F.max("span").alias("span"), F.min(F.struct((-F.col("messages")).alias("few"), "month")).alias("top"))
    parts = [
        pair(M.message_length(rows), "length"),
        pair(M.question_rate(rows), "question"),
        opened.select("chat", F.col("me").alias("initiation_me"), F.col("other").alias("initiation_other"), F.col("sessions").alias("initiation_sessions"), "wake_adjusted"),
        pair(M.no_reply(rows), "noreply", "me_rate", "other_rate"),
        M.reply_distribution(rows).select("chat", "me_fast", "me_n", "other_fast", "other_n"),
        pair(M.emoji_affect(rows), "affect"),
        pair(M.emoji_variety(rows), "variety"),
        M.change_point(rows).select("chat", F.col("month").alias("change_month"), F.col("drop").alias("change_drop")),
        months,
        phrase_lists(rows),
        R.deleted_count(rows, counters),
    ]
    if vectors is not None:
        parts.append(R.semantic(rows, vectors).select("chat", "sync_me", "sync_other", "style_score"))
    return reduce(lambda a, b: a.join(b, "chat", "left"), parts, pair(M.message_count(rows), "count"))


def metric_cards(rows: DataFrame, vectors: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """(chat, metric, kind, me, other, value, max, unit, note, text, chips_me, chips_other): how each metric with an open gate is shown.

    A card is a pair of both sides, a single value (with a largest one for a bar), lists of
    words, or a text where there is no value.
    """
    whole = lambda c: half_up(F.col(c) * 100)
    round_ = lambda c: half_up(F.col(c))
    fast = lambda w: F.when(F.coalesce(F.col(f"{w}_n"), F.lit(0)) == 0, 0).otherwise(half_up(F.col(f"{w}_fast") / F.col(f"{w}_n") * 100))
    month = lambda c: F.substring(c, 6, 2).cast("int").cast("string")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    nothing = F.array().cast("array<string>")
    cooled = F.col("change_month").isNotNull()
    cards = [
        card("msgCount", "pair", F.col("count_me"), F.col("count_other"), unit="건"),
        card("msgLength", "pair", F.col("length_me"), F.col("length_other"), unit="자"),
        card("questionRate", "pair", whole("question_me"), whole("question_other"), unit="%", note=QUESTION_NOTE),
        card("replyDist", "pair", fast("me"), fast("other"), unit="%", note=text(REPLY_NOTE, F.coalesce("me_n", F.lit(0)) + F.coalesce("other_n", F.lit(0)))),
        card("initiation", "pair", round_("initiation_me"), round_("initiation_other"), unit="%", note=text(SESSIONS_NOTE[0], F.col("initiation_sessions"), SESSIONS_NOTE[1], F.when(F.col("wake_adjusted"), "").otherwise(NO_WAKE_NOTE))),
        card("noReply", "pair", round_("noreply_me"), round_("noreply_other"), unit="%", note=SILENT_NOTE),
        card("monthly", "single", value=F.col("span"), unit="개월", note=text(HOTTEST[0], month(F.col("top.month")), HOTTEST[1], -F.col("top.few"), HOTTEST[2])),
        card("changePoint", F.when(cooled, "single").otherwise("text"), value=F.col("change_drop"), most=F.when(cooled, 100), unit=F.when(cooled, "%"), note=F.when(cooled, text(month(F.col("change_month")), COOLED)), text=F.when(~cooled, NO_CHANGE)),
        card("phraseGap", "chips", note=PHRASE_NOTE, unit=None, chips=(F.coalesce("chips_me", nothing), F.coalesce("chips_other", nothing))),
        card("deletedCount", "single", value=F.col("deleted"), unit="건", note=F.when(F.col("deleted") > 0, DELETED_NOTE).otherwise(NOTHING_DELETED)),
        card("emojiAffect", "pair", F.col("affect_me"), F.col("affect_other"), note=AFFECT_NOTE),
        card("emojiVariety", "pair", whole("variety_me"), whole("variety_other"), unit="%", note=VARIETY_NOTE),
    ]
    if vectors is not None:
        cards.append(card("syncAsym", "pair", F.col("sync_me"), F.col("sync_other"), note=SYNC_NOTE))
        cards.append(card("styleSep", "single", value=F.col("style_score"), most=100, note=STYLE_NOTE))
    listed = shown_values(rows, vectors, counters).select("chat", F.explode(F.array(*cards)).alias("c")).select("chat", "c.*")
    return listed.join(R.metric_status(rows, vectors).where("status = 'OK'").select("chat", "metric"), ["chat", "metric"])


def hottest_month(rows: DataFrame) -> DataFrame:
    """The month with most messages, the first one on ties."""
    return M.monthly(rows).groupBy("chat").agg(F.min(F.struct((-F.col("messages")).alias("few"), "month")).alias("top")).select("chat", F.col("top.month").alias("month"), (-F.col("top.few")).alias("messages"))


register("evidence_badge", over_events(evidence_badge), O.on_events("SELECT chat, '메시지 ' || format('{:,}', count(*)) || '개 중 최근 ' || count(*) FILTER (win) || '개로 산출 · ' || (date_diff('month', min(date)::DATE, max(date)::DATE) + 1) || '개월 · 세션 ' || count(DISTINCT sess) || '개' AS badge FROM e GROUP BY chat"))
register("hottest_month", over_orders(hottest_month), O.on_orders("SELECT chat, month, messages FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY messages DESC, month) AS k FROM mo) WHERE k = 1"))


def _card_sql(metric: str, frame: str, kind: str = "'pair'", me: str = "NULL", other: str = "NULL", value: str = "NULL", most: str = "NULL", unit: str = "NULL", note: str = "NULL", text: str = "NULL", chips: tuple[str, str] = ("NULL", "NULL")) -> str:
    """The card of one metric over the chats whose gate is open."""
    return f"""SELECT s.chat, s.metric, {kind} AS kind, ({me})::DOUBLE AS me, ({other})::DOUBLE AS other, ({value})::DOUBLE AS value, ({most})::DOUBLE AS max, {unit} AS unit, {note} AS note, {text} AS text,
  ({chips[0]})::VARCHAR AS chips_me, ({chips[1]})::VARCHAR AS chips_other FROM (SELECT * FROM st WHERE metric = '{metric}' AND status = 'OK') s LEFT JOIN {frame} v ON v.chat = s.chat"""


UP, PCT = O.up, lambda c: O.up(f"({c}) * 100")
CARDS = " UNION ALL ".join([
    _card_sql("msgCount", "cnt", me="v.me", other="v.other", unit="'건'"),
    _card_sql("msgLength", "ml", me="v.me", other="v.other", unit="'자'"),
    _card_sql("questionRate", "qr", me=PCT("v.me"), other=PCT("v.other"), unit="'%'", note=f"'{QUESTION_NOTE}'"),
    _card_sql("replyDist", "rd", me=f"CASE WHEN me_n > 0 THEN {PCT('me_fast / me_n::DOUBLE')} ELSE 0 END", other=f"CASE WHEN other_n > 0 THEN {PCT('other_fast / other_n::DOUBLE')} ELSE 0 END", unit="'%'", note=f"'{REPLY_NOTE}' || (me_n + other_n)"),
    _card_sql("initiation", "init", me=UP("v.me"), other=UP("v.other"), unit="'%'", note=f"'{SESSIONS_NOTE[0]}' || sessions || '{SESSIONS_NOTE[1]}' || CASE WHEN wake_adjusted THEN '' ELSE '{NO_WAKE_NOTE}' END"),
    _card_sql("noReply", "nr", me=UP("v.me_rate"), other=UP("v.other_rate"), unit="'%'", note=f"'{SILENT_NOTE}'"),
    _card_sql("monthly", "(SELECT *, row_number() OVER (PARTITION BY chat ORDER BY messages DESC, month) AS k FROM mo QUALIFY k = 1)", kind="'single'", value="v.span", unit="'개월'", note=f"'{HOTTEST[0]}' || v.month[6:7]::INT || '{HOTTEST[1]}' || v.messages || '{HOTTEST[2]}'"),
    _card_sql("changePoint", "cp", kind="CASE WHEN v.month IS NULL THEN 'text' ELSE 'single' END", value="v.drop", most="CASE WHEN v.month IS NOT NULL THEN 100 END", unit="CASE WHEN v.month IS NOT NULL THEN '%' END", note=f"v.month[6:7]::INT || '{COOLED}'", text=f"CASE WHEN v.month IS NULL THEN '{NO_CHANGE}' END"),
    _card_sql("phraseGap", f"(SELECT chat, string_agg(gram, ' · ' ORDER BY place) FILTER (side = 'me' AND place <= {CHIPS}) AS cm, string_agg(gram, ' · ' ORDER BY place) FILTER (side = 'other' AND place <= {CHIPS}) AS co FROM pg GROUP BY chat)", kind="'chips'", note=f"'{PHRASE_NOTE}'", chips=("coalesce(cm, '')", "coalesce(co, '')")),
    _card_sql("deletedCount", "(SELECT chat, count(*) FILTER (type = 'deleted') AS n FROM e GROUP BY chat)", kind="'single'", value="v.n", unit="'건'", note=f"CASE WHEN v.n > 0 THEN '{DELETED_NOTE}' ELSE '{NOTHING_DELETED}' END"),
    _card_sql("emojiAffect", "ea", me="v.me", other="v.other", unit="''", note=f"'{AFFECT_NOTE}'"),
    _card_sql("emojiVariety", "vy", me=PCT("v.me"), other=PCT("v.other"), unit="'%'", note=f"'{VARIETY_NOTE}'"),
])
CARD_PARTS = (O.STATUS, "ml AS (SELECT chat, " + O.up("len_me", 2) + " AS me, " + O.up("len_other", 2) + " AS other FROM cnt)", f"vy AS ({VARIETY})", O.GRAMS.replace("\ntx AS", "\ntx_ AS", 1).replace("FROM tx)", "FROM tx_)"))


def listed_cards(rows: DataFrame) -> DataFrame:
    """The cards with their words in one text."""
    return metric_cards(rows).withColumns({c: F.array_join(c, " · ") for c in ("chips_me", "chips_other")})


register("metric_cards", over_stored(listed_cards), O.on_events(f"SELECT * FROM ({CARDS})", *CARD_PARTS))
register("metric_cards_orders", over_orders(listed_cards), O.on_orders(f"SELECT * FROM ({CARDS})", *CARD_PARTS))
register("metric_cards_turns", over_pooled(lambda m: listed_cards(S.enriched(m))), O.q(f"SELECT * FROM ({CARDS})", O.POOLED, O.MARKED, O.METRICS, *CARD_PARTS))
UNITS = ", ".join(f"('{k}', '{v}')" for k, v in D.SAMPLE_UNITS.items())
register(
    "status_message",
    over_events(lambda e: R.metric_status(e).select("chat", "metric", D.status_message(F.col("metric"), F.col("status")).alias("message"))),
    O.on_events(
        f"""SELECT chat, metric, CASE WHEN status LIKE 'LOCKED:%' THEN CASE WHEN list_contains(string_split(status[8:], ','), 'affect') THEN '캡처를 올리면 열립니다' ELSE '전체 대화 파일을 넣으면 열립니다' END
  WHEN status LIKE 'INSUFFICIENT:%' THEN unit || CASE WHEN (unicode(unit[-1:]) - 44032) % 28 <> 0 THEN '이' ELSE '가' END || ' 더 필요합니다 (' || floor(string_split(status[14:], '/')[1]::DOUBLE)::BIGINT || ' / ' || string_split(status, '/')[2] || ')' END AS message
FROM st JOIN (VALUES {UNITS}) u(key, unit) ON u.key = st.metric""",
        O.STATUS,
    ),
)


def shown_stamps(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_format("ts", "HH:mm").alias("time"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return e.select("event_id", D.display_time(F.col("time")).alias("time"), D.display_date(F.col("date")).alias("date"))


register(
    "display_stamps",
    shown_stamps,
    "SELECT event_id, CASE WHEN hour(ts) < 12 THEN '오전 ' ELSE '오후 ' END || CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || strftime(ts, ':%M') AS time, year(ts) || '년 ' || month(ts) || '월 ' || day(ts) || '일 ' || ['월', '화', '수', '목', '금', '토', '일'][isodow(ts)] || '요일' AS date FROM events",
)


def shares(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    percent = D.share_percent(F.col("l_quantity"), F.col("l_extendedprice") / 1000)
    return lines.select("l_orderkey", "l_linenumber", percent.alias("percent"), D.percent_phrase(percent).alias("phrase"))


PHRASES = " ".join(f"WHEN percent >= {n} THEN '{p}'" for n, p in D.PERCENT_PHRASES)
register(
    "share_phrases",
    shares,
    f"SELECT l_orderkey, l_linenumber, percent, CASE {PHRASES} ELSE '{D.LEAST_PHRASE}' END AS phrase FROM (SELECT *, {O.up('l_quantity / (l_quantity + l_extendedprice / 1000) * 100')}::INT AS percent FROM lineitem)",
)


def csv_table(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of CSV files in three layouts: named columns in either order, and no header; some stamps are broken."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("chat", F.floor(F.col("user_id") / 3).cast("long"))
    stamp = F.when(F.col("event_id") % 50 == 7, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    text = F.concat(F.lit("the event said "), "event_type", F.when(F.col("event_id") % 5 == 0, "\nand more").otherwise(""))
    name = F.concat(F.lit("n"), (F.col("event_id") % 2).cast("string"))
    kind = F.col("chat") % 3
    fields = F.when(kind == 0, F.array(stamp, name, text)).when(kind == 1, F.array(F.lit("7"), name, text, stamp)).otherwise(F.array(text, F.date_format("ts", "yyyy-MM-dd HH:mm"), name))
    data = e.select("chat", (F.col("event_id") + 1).cast("long").alias("row"), fields.alias("fields"))
    header = F.when(kind == 0, F.array(*map(F.lit, ("Date(UTC)", "Speaker", "msg")))).otherwise(F.array(*map(F.lit, ("번호", "작성자", "메시지", "일시"))))
    return data.union(e.where(kind < 2).select("chat", F.lit(0).cast("long").alias("row"), header.alias("fields")).distinct())


CSV = "cv AS (SELECT user_id // 3 AS chat, event_id, date_trunc('minute', ts) AS t, event_id % 50 = 7 AND (user_id // 3) % 3 < 2 AS bad, event_id % 5 = 0 AS many FROM events)"
register("csv_stats", lambda spark, d: C.csv_stats(csv_table(spark, d)).select("chat", "messages", "unparsed", "deleted", "multiline", "midnight"), O.q("SELECT chat, count(*) FILTER (NOT bad) AS messages, count(*) FILTER (bad) AS unparsed, 0 AS deleted, count(*) FILTER (many AND NOT bad) AS multiline, count(*) FILTER (hour(t) = 0 AND NOT bad) AS midnight FROM cv GROUP BY chat", CSV))
register("csv_messages", lambda spark, d: C.csv_messages(csv_table(spark, d)).select("chat", "pos", "name", "ts", "time"), O.q("SELECT chat, row_number() OVER (PARTITION BY chat ORDER BY t, event_id) - 1 AS pos, 'n' || event_id % 2 AS name, epoch_ms(t) AS ts, strftime(t, '%H:%M') AS time FROM cv WHERE NOT bad", CSV))
