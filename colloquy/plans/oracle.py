"""DuckDB SQL for the conversation queries, written independently of the DataFrame code."""

from __future__ import annotations

from ..functions.text import COMPONENT, PICTOGRAPHIC, char_class
from ..operators.phrases import STOPWORDS

STRIP = char_class(PICTOGRAPHIC) + char_class(COMPONENT)
BLANKS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def visible(text: str) -> str:
    """Visible length of a text without emoji parts."""
    return rf"length_grapheme(regexp_replace(regexp_replace({text}, '[{STRIP}]', '', 'g'), '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g'))"


def up(x: str, digits: int = 0) -> str:
    return f"(floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE)" if digits else f"floor(({x}) + 0.5)"


EVENTS = f"""
raw_ AS (SELECT *, (props->>'$.k')::INT AS k, date_trunc('minute', ts) AS tm, user_id // 3 AS chat FROM events),
txt_ AS (SELECT *, CASE event_type WHEN 'signup' THEN 'signup now?' WHEN 'view' THEN 'view ' || repeat('x', k % 12) WHEN 'click' THEN 'ok' END AS body FROM raw_),
m AS (SELECT chat, row_number() OVER (PARTITION BY chat ORDER BY ts, event_id) - 1 AS seq, CASE WHEN event_id % 2 = 0 THEN 'me' ELSE 'other' END AS who,
  epoch_ms(tm) AS ts, strftime(tm, '%Y-%m-%d') AS date, strftime(tm, '%H:%M') AS time,
  CASE event_type WHEN 'purchase' THEN 'photo' WHEN 'error' THEN 'emoticon' ELSE 'text' END AS type, body AS text, coalesce({visible("body")}, 0) AS char_count,
  CASE WHEN event_type = 'error' THEN 'e' || (k % 5) END AS emoji_desc, CASE WHEN event_type = 'error' THEN (k - 50) / 50.0::DOUBLE END AS valence,
  CASE WHEN event_type = 'error' THEN least(1.0::DOUBLE, value / 100.0::DOUBLE) END AS intensity FROM txt_)"""


def conversations(chat: str, seq: str) -> str:
    return f"""
m AS (SELECT {chat} AS chat, {seq} AS seq, CASE WHEN role = 'user' THEN 'me' ELSE 'other' END AS who, NULL::BIGINT AS ts, NULL::VARCHAR AS date, NULL::VARCHAR AS time,
  'text' AS type, text, {visible("text")} AS char_count, NULL::VARCHAR AS emoji_desc, NULL::DOUBLE AS valence, NULL::DOUBLE AS intensity FROM conversations WHERE role <> 'system')"""


TURNS = conversations("conv_id", "turn")
POOLED = conversations("0", "conv_id * 100000 + turn")

ORDERS = """
m AS (SELECT o_custkey % 50 AS chat, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) - 1 AS seq,
  CASE WHEN o_orderkey % 2 = 0 THEN 'me' ELSE 'other' END AS who, epoch_ms(o_orderdate::TIMESTAMP) AS ts, strftime(o_orderdate, '%Y-%m-%d') AS date,
  strftime(o_orderdate, '%H:%M') AS time, 'text' AS type, o_orderpriority AS text, length(o_orderpriority) AS char_count, NULL::VARCHAR AS emoji_desc,
  NULL::DOUBLE AS valence, NULL::DOUBLE AS intensity FROM orders)"""

MINUTE = "(string_split({0}, ':')[1]::INT * 60 + string_split({0}, ':')[2]::INT)"

MARKED = f"""
l AS (SELECT *, lag(who) OVER o AS who0, lag(ts) OVER o AS ts0, lag(time) OVER o AS time0, row_number() OVER o AS rk, count(*) OVER (PARTITION BY chat) AS n FROM m WINDOW o AS (PARTITION BY chat ORDER BY seq)),
e AS (SELECT *, rk > n - 120 AS win, who0 IS NOT NULL AND who <> who0 AS turn,
  (sum(CASE WHEN who0 IS NULL OR who <> who0 THEN 1 ELSE 0 END) OVER o)::BIGINT AS burst,
  sum(CASE WHEN who0 IS NULL OR who <> who0 OR rk = greatest(n - 120, 0) + 1 THEN 1 ELSE 0 END) OVER o AS wburst,
  (sum(CASE WHEN ts - ts0 >= 21600000 THEN 1 ELSE 0 END) OVER o)::BIGINT AS sess FROM l WINDOW o AS (PARTITION BY chat ORDER BY seq)),
s AS (SELECT chat, sess, arg_min(who, seq) AS opener, arg_max(who, seq) AS closer, count(*) AS messages, arg_min(time, seq) AS first_time, arg_min(date, seq) AS first_date, arg_max(date, seq) AS last_date FROM e GROUP BY ALL),
t AS (SELECT chat, seq, who AS responder, CASE WHEN ts IS NOT NULL AND ts0 IS NOT NULL THEN CASE WHEN ts >= ts0 THEN (ts - ts0) / 60000.0::DOUBLE END
  ELSE CASE WHEN ({MINUTE.format("time")} - {MINUTE.format("time0")} + 1440) % 1440 <= 360 THEN (({MINUTE.format("time")} - {MINUTE.format("time0")} + 1440) % 1440)::DOUBLE END END AS d FROM e WHERE turn)"""

METRICS = f"""
cnt AS (SELECT chat, count(*) FILTER (who = 'me') AS me, count(*) FILTER (who = 'other') AS other, count(*) FILTER (type = 'text') AS texts,
  coalesce(avg(char_count) FILTER (type = 'text' AND who = 'me'), 0) AS len_me, coalesce(avg(char_count) FILTER (type = 'text' AND who = 'other'), 0) AS len_other FROM e WHERE win GROUP BY chat),
wb AS (SELECT chat, wburst, any_value(who) AS who, bool_or(type = 'text' AND coalesce(contains(text, '?'), false)) AS q FROM e WHERE win GROUP BY ALL),
bq AS (SELECT chat, count(*) FILTER (who = 'me') AS b_me, count(*) FILTER (who = 'other') AS b_other, count(*) FILTER (who = 'me' AND q) AS q_me, count(*) FILTER (who = 'other' AND q) AS q_other FROM wb GROUP BY chat),
qr AS (SELECT chat, {up("CASE WHEN b_me = 0 THEN 0 ELSE q_me / b_me::DOUBLE END", 2)} AS me, {up("CASE WHEN b_other = 0 THEN 0 ELSE q_other / b_other::DOUBLE END", 2)} AS other FROM bq),
wake1 AS (SELECT chat, who, {MINUTE.format("time")} AS mn, date FROM e WHERE date IS NOT NULL AND time IS NOT NULL),
wake2 AS (SELECT chat, who, CASE WHEN count(*) >= 30 AND count(DISTINCT date) >= 14 THEN list_sort(list(mn))[least(count(*), floor(count(*) * 0.05) + 1)::INT] END AS p FROM wake1 WHERE mn >= 240 AND mn < 720 GROUP BY ALL),
wake AS (SELECT chat, max(p) FILTER (who = 'me') AS me_minute, max(p) FILTER (who = 'other') AS other_minute FROM wake2 GROUP BY chat),
sx AS (SELECT s.*, lag(last_date) OVER o AS prev_date, lead(opener) OVER o AS nxt FROM s WINDOW o AS (PARTITION BY chat ORDER BY sess)),
ho AS (SELECT sx.*, w.me_minute IS NOT NULL AND w.other_minute IS NOT NULL AS active, coalesce(w.me_minute IS NOT NULL AND w.other_minute IS NOT NULL
  AND {MINUTE.format("first_time")} <= (CASE WHEN opener = 'me' THEN me_minute ELSE other_minute END) + 120 AND first_date::DATE - prev_date::DATE = 1, false) AS h FROM sx LEFT JOIN wake w USING (chat)),
ini AS (SELECT chat, count(*) FILTER (NOT h AND opener = 'me') AS x, count(*) FILTER (NOT h) AS n, count(*) FILTER (h) AS ex, coalesce(bool_or(active), false) AS adj FROM ho GROUP BY chat),
init AS (SELECT chat, {up("(CASE WHEN n <= 0 THEN 0.5 ELSE (x + 4.0::DOUBLE) / (n + 8) END) * 1000")} / 10 AS me, {up("(1 - CASE WHEN n <= 0 THEN 0.5 ELSE (x + 4.0::DOUBLE) / (n + 8) END) * 1000")} / 10 AS other, n AS sessions, adj AS wake_adjusted, ex AS excluded_handoffs FROM ini),
nr0 AS (SELECT chat, count(*) FILTER (closer = 'me') AS me_closed, count(*) FILTER (closer = 'other') AS other_closed,
  count(*) FILTER (closer = 'me' AND (nxt IS NULL OR nxt = closer)) AS me_unanswered, count(*) FILTER (closer = 'other' AND (nxt IS NULL OR nxt = closer)) AS other_unanswered FROM sx GROUP BY chat),
nr AS (SELECT *, {up("(CASE WHEN me_closed <= 0 THEN 0.5 ELSE (me_unanswered + 4.0::DOUBLE) / (me_closed + 8) END) * 1000")} / 10 AS me_rate, {up("(CASE WHEN other_closed <= 0 THEN 0.5 ELSE (other_unanswered + 4.0::DOUBLE) / (other_closed + 8) END) * 1000")} / 10 AS other_rate FROM nr0),
rd AS (SELECT chat, {", ".join(f"count(*) FILTER (responder = '{w}' AND {c}) AS {w}_{k}" for w in ("me", "other") for k, c in (("fast", "d <= 5"), ("mid", "d > 5 AND d <= 60"), ("slow", "d > 60 AND d <= 360"), ("n", "d IS NOT NULL")))} FROM t GROUP BY chat),
mo0 AS (SELECT chat, date[1:7] AS month, count(*) AS messages FROM e WHERE date IS NOT NULL GROUP BY ALL),
mo1 AS (SELECT *, count(*) OVER (PARTITION BY chat) AS span, row_number() OVER o AS nth, sum(messages) OVER (o ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s2, sum(messages) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3 FROM mo0 WINDOW o AS (PARTITION BY chat ORDER BY month)),
mo AS (SELECT chat, month, messages, span, CASE WHEN nth >= CASE WHEN span >= 12 THEN 3 WHEN span >= 6 THEN 2 ELSE 1 END THEN
  {up("(CASE WHEN span >= 12 THEN s3 / 3.0::DOUBLE WHEN span >= 6 THEN s2 / 2.0::DOUBLE ELSE messages::DOUBLE END) * 10")} / 10 END AS ma, CASE WHEN span >= 6 THEN 'month' ELSE 'week' END AS granularity FROM mo1),
cp0 AS (SELECT *, lag(ma) OVER (PARTITION BY chat ORDER BY month) AS b FROM mo WHERE span >= 12),
cp AS (SELECT chat, month, {up("dr * 1000")} / 10 AS drop FROM (SELECT chat, month, (b - ma) / b AS dr, row_number() OVER (PARTITION BY chat ORDER BY (b - ma) / b DESC, month) AS k FROM cp0 WHERE b > 0 AND ma IS NOT NULL AND (b - ma) / b > 0) WHERE k = 1),
ea0 AS (SELECT chat, coalesce(sum(valence * intensity) FILTER (who = 'me') / nullif(count(*) FILTER (who = 'me'), 0), 0) AS a, coalesce(sum(valence * intensity) FILTER (who = 'other') / nullif(count(*) FILTER (who = 'other'), 0), 0) AS b FROM e WHERE type = 'emoticon' AND valence IS NOT NULL GROUP BY chat),
ea AS (SELECT chat, {up("a", 2)} AS me, {up("b", 2)} AS other, {up("(a - b) / 2 * 100")} AS gap FROM ea0),
iu AS (SELECT chat, sum(CASE type WHEN 'text' THEN CASE WHEN char_count >= 10 THEN 10 WHEN char_count >= 3 THEN 7 ELSE 4 END WHEN 'emoticon' THEN CASE WHEN valence IS NOT NULL THEN 12 ELSE 1 END WHEN 'photo' THEN 3 WHEN 'nontext' THEN 1 ELSE 0 END)::BIGINT / 10.0::DOUBLE AS info_units,
  count(*) FILTER (win) AS window_filled FROM e GROUP BY chat),
ax AS (SELECT chat, me + other AS window_filled, {up("CASE WHEN me + other = 0 THEN 0 ELSE (me - other) / (me + other)::DOUBLE END", 2)} AS axis_count,
  CASE WHEN texts > 0 THEN {up("CASE WHEN len_me + len_other = 0 THEN 0 ELSE (len_me - len_other) / (len_me + len_other) END", 2)} END AS axis_length,
  CASE WHEN b_me > 0 AND b_other > 0 THEN {up("CASE WHEN q_me / b_me::DOUBLE + q_other / b_other::DOUBLE = 0 THEN 0 ELSE (q_me / b_me::DOUBLE - q_other / b_other::DOUBLE) / (q_me / b_me::DOUBLE + q_other / b_other::DOUBLE) END", 2)} END AS axis_question
  FROM cnt JOIN bq USING (chat)),
hd0 AS (SELECT *, (axis_count IS NOT NULL)::INT + (axis_length IS NOT NULL)::INT + (axis_question IS NOT NULL)::INT AS axes_used, 0.0::DOUBLE + coalesce(axis_count, 0) + coalesce(axis_length, 0) + coalesce(axis_question, 0) AS tot FROM ax),
hd1 AS (SELECT *, CASE WHEN axes_used = 0 THEN 0 ELSE {up("100 * tot / axes_used")} END::BIGINT AS tilt FROM hd0),
hd AS (SELECT chat, tilt, CASE WHEN tilt >= 55 THEN 'strong_me' WHEN tilt >= 20 THEN 'lean_me' WHEN tilt > -20 THEN 'even' WHEN tilt > -55 THEN 'lean_other' ELSE 'strong_other' END AS band,
  axes_used, 4 AS axes_total, window_filled < 60 AS coarse, window_filled, axis_count, axis_length, axis_question FROM hd1)"""

#: Fixed gates: key, needed fields, least sample, counter.
GATES = (
    ("msgCount", ["who"], 30, "wm"),
    ("msgLength", ["who", "text"], 30, "wm"),
    ("questionRate", ["who", "text"], 20, "wbs"),
    ("syncAsym", ["text", "embedding"], 20, "wp"),
    ("styleSep", ["text", "embedding"], 30, "wt"),
    ("replyDist", ["time", "who"], 20, "rp"),
    ("initiation", ["ts", "date", "continuity"], 20, "ss"),
    ("noReply", ["ts", "date", "continuity"], 20, "ss"),
    ("monthly", ["date", "continuity"], 3, "mo"),
    ("changePoint", ["date", "continuity"], 12, "mo"),
    ("phraseGap", ["text"], 200, "tx"),
    ("deletedCount", ["type", "continuity"], 0, None),
    ("emojiAffect", ["affect"], 8, "em"),
    ("emojiVariety", ["affect"], 8, "em"),
)


def _gate(key: str, needs: list[str], least: int, counter: str | None) -> str:
    missing = f"list_filter({needs}, lambda x: NOT list_contains(f.fields, x))"
    enough = "true" if counter is None else f"c.{counter} >= {least}"
    short = "''" if counter is None else f"'INSUFFICIENT:' || c.{counter} || '/{least}'"
    return f"SELECT f.chat, '{key}' AS metric, CASE WHEN len({missing}) > 0 THEN 'LOCKED:' || array_to_string({missing}, ',') WHEN {enough} THEN 'OK' ELSE {short} END AS status FROM fl f JOIN ct c USING (chat)"


STATUS = f"""
fl AS (SELECT chat, list_filter(['who', 'type', CASE WHEN bool_and(ts IS NOT NULL) THEN 'ts' END, CASE WHEN bool_and(date IS NOT NULL) THEN 'date' END, CASE WHEN bool_or(time IS NOT NULL) THEN 'time' END,
  CASE WHEN bool_or(text IS NOT NULL) THEN 'text' END, CASE WHEN bool_or(valence IS NOT NULL) THEN 'affect' END, CASE WHEN bool_and(ts IS NOT NULL) AND bool_and(date IS NOT NULL) THEN 'continuity' END], lambda x: x IS NOT NULL) AS fields FROM e GROUP BY chat),
ct0 AS (SELECT chat, count(*) FILTER (win) AS wm, least(count(*) FILTER (type = 'text' AND text IS NOT NULL AND who = 'me'), count(*) FILTER (type = 'text' AND text IS NOT NULL AND who = 'other')) AS tx,
  least(count(*) FILTER (win AND type = 'text' AND text IS NOT NULL AND who = 'me'), count(*) FILTER (win AND type = 'text' AND text IS NOT NULL AND who = 'other')) AS wt,
  count(*) FILTER (type = 'emoticon' AND valence IS NOT NULL) AS em, count(DISTINCT date[1:7]) AS mo, count(DISTINCT sess) AS ss FROM e GROUP BY chat),
ct AS (SELECT ct0.*, coalesce(r.rp, 0) AS rp, b_me + b_other AS wbs, greatest(b_me + b_other - 1, 0) AS wp FROM ct0 LEFT JOIN (SELECT chat, count(d) AS rp FROM t GROUP BY chat) r USING (chat) JOIN bq USING (chat)),
st AS ({" UNION ALL ".join(_gate(*g) for g in GATES)})"""


def _open(key: str, value: str) -> str:
    return f"CASE WHEN (SELECT status FROM st WHERE st.chat = hd.chat AND metric = '{key}') = 'OK' THEN {value} END"


REPORTED = f"""
ok AS (SELECT chat, {", ".join(f"bool_or(metric = '{g[0]}' AND status = 'OK') AS ok_{g[0]}" for g in GATES)} FROM st GROUP BY chat),
ml AS (SELECT chat, {up("len_me", 2)} AS me, {up("len_other", 2)} AS other FROM cnt),
r AS (SELECT hd.*, CASE WHEN ok_msgCount THEN cnt.me END AS count_me, CASE WHEN ok_msgCount THEN cnt.other END AS count_other, CASE WHEN ok_msgLength THEN ml.me END AS length_me, CASE WHEN ok_msgLength THEN ml.other END AS length_other,
  CASE WHEN ok_questionRate THEN qr.me END AS question_me, CASE WHEN ok_questionRate THEN qr.other END AS question_other, CASE WHEN ok_initiation THEN init.me END AS initiation_me, CASE WHEN ok_initiation THEN init.other END AS initiation_other,
  CASE WHEN ok_noReply THEN nr.me_rate END AS noreply_me, CASE WHEN ok_noReply THEN nr.other_rate END AS noreply_other, CASE WHEN ok_emojiAffect THEN ea.other END AS affect_other, CASE WHEN ok_emojiAffect THEN ea.gap END AS affect_gap,
  CASE WHEN ok_changePoint THEN cp.month END AS change_month, CASE WHEN ok_changePoint THEN cp.drop END AS change_drop
  FROM hd JOIN ok USING (chat) LEFT JOIN cnt USING (chat) LEFT JOIN ml USING (chat) LEFT JOIN qr USING (chat) LEFT JOIN init USING (chat) LEFT JOIN nr USING (chat) LEFT JOIN ea USING (chat) LEFT JOIN cp USING (chat))"""

FIGURES = f"""
fg AS (SELECT chat, {up("count_me / nullif(count_me + count_other, 0)::DOUBLE * 100")}::BIGINT AS share_me, (100 - {up("count_me / nullif(count_me + count_other, 0)::DOUBLE * 100")})::BIGINT AS share_other,
  abs({up("length_me - length_other")})::BIGINT AS length_gap, abs({up("(question_me - question_other) * 100")})::BIGINT AS question_gap, {up("greatest(initiation_me, initiation_other)")}::BIGINT AS initiation_top,
  abs(affect_gap) AS affect_gap, {up("greatest(noreply_me, noreply_other)")}::BIGINT AS noreply_top, change_month[6:7]::BIGINT AS change_month, change_drop FROM r)"""


def _card(name: str, parts: list[tuple[str, int]]) -> str:
    used = " + ".join(f"(({v}) IS NOT NULL)::INT" for v, _ in parts)
    weight = " + ".join(f"CASE WHEN ({v}) IS NOT NULL THEN {w} ELSE 0 END" for v, w in parts)
    total = "0.0::DOUBLE + " + " + ".join(f"coalesce(({v}) * {w}.0::DOUBLE, 0)" for v, w in parts)
    d = f"(({total}) / ({weight}) - 0.5::DOUBLE)"
    inner = f"SELECT chat, coarse, tilt, {used} AS used, {d} AS d FROM r"
    percent = "50 + (CASE WHEN d <> 0 THEN sign(d) WHEN tilt <> 0 THEN -sign(tilt) ELSE -1 END) * (12.0::DOUBLE + 38.0::DOUBLE * tanh(abs(d) * 4.0::DOUBLE))"
    return f"SELECT chat, '{name}' AS card, CASE WHEN coarse THEN {up(f'({percent}) / 5')} * 5 ELSE {up(f'({percent}) * 10')} / 10 END AS percent, used FROM ({inner}) WHERE used >= 2"


def _clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _low_high(a: str, b: str) -> str:
    return f"CASE WHEN greatest({a}, {b}) > 0 THEN {_clamp(f'least({a}, {b}) / greatest({a}, {b})')} WHEN {a} IS NOT NULL THEN 0.0 END"


ODDS = " UNION ALL ".join([
    _card("reciprocity", [
        (_clamp("(100 - tilt) / 200.0::DOUBLE"), 3),
        (f"CASE WHEN initiation_other IS NOT NULL THEN {_clamp('initiation_other / 100')} END", 2),
        (f"CASE WHEN question_me + question_other > 0 THEN {_clamp('question_other / (question_me + question_other)')} END", 2),
        (f"CASE WHEN noreply_other IS NOT NULL THEN {_clamp('1 - noreply_other / 100')} END", 2),
        (f"CASE WHEN affect_other IS NOT NULL THEN {_clamp('(affect_other + 1) / 2')} END", 1),
    ]),
    _card("momentum", [
        (_clamp("1 - abs(tilt) / 100.0::DOUBLE"), 3),
        (f"CASE WHEN noreply_me IS NOT NULL THEN {_clamp('1 - greatest(noreply_me, noreply_other) / 100')} END", 2),
        (_low_high("question_me", "question_other"), 2),
        (_low_high("length_me", "length_other"), 1),
        (f"CASE WHEN change_drop IS NOT NULL THEN {_clamp('1 - change_drop / 100')} END", 2),
    ]),
])

SIGNAL = """
sg AS (SELECT r.chat, r.window_filled % 2 AS variant, unnest([
  {'key': 'share', 'place': 0, 's': abs(f.share_me - 50) / 25.0::DOUBLE, 'mine': f.share_me >= 50},
  {'key': 'length', 'place': 1, 's': f.length_gap / 12.0::DOUBLE, 'mine': r.length_me >= r.length_other},
  {'key': 'question', 'place': 2, 's': f.question_gap / 20.0::DOUBLE, 'mine': r.question_me >= r.question_other},
  {'key': 'initiation', 'place': 3, 's': (f.initiation_top - 50) / 25.0::DOUBLE, 'mine': r.initiation_me >= r.initiation_other},
  {'key': 'emoji', 'place': 4, 's': f.affect_gap / 0.5::DOUBLE, 'mine': r.affect_gap >= 0},
  {'key': 'cool', 'place': 5, 's': f.change_drop / 40.0::DOUBLE, 'mine': true}]) AS x FROM r JOIN fg f USING (chat)),
sg1 AS (SELECT chat, variant, x.key AS key, x.s AS s, x.mine AS mine, row_number() OVER (PARTITION BY chat ORDER BY x.s DESC NULLS LAST, x.place) AS k FROM sg)"""

GRAMS = rf"""
tx AS (SELECT chat, who, seq, trim(regexp_replace(text, '[{BLANKS}]+', ' ', 'g'), ' ') AS s FROM m WHERE type = 'text' AND text IS NOT NULL),
gr AS (SELECT chat, who, seq, n, i, s[i:i + n - 1] AS gram FROM (SELECT *, unnest(range(1, length(s) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS n FROM tx))),
gg AS (SELECT * FROM gr WHERE NOT regexp_matches(gram, '[{BLANKS}.,!?~]')),
gc AS (SELECT chat, gram, count(*) FILTER (who = 'me') AS fa, count(*) FILTER (who = 'other') AS fb, min((seq, n, i)) FILTER (who = 'me') AS first FROM gg GROUP BY ALL),
tot AS (SELECT chat, count(*) FILTER (who = 'me') AS na, count(*) FILTER (who = 'other') AS nb FROM gg GROUP BY chat),
ky AS (SELECT * FROM gc WHERE fa + fb >= 10 AND fa >= 1 AND fb >= 1 AND gram NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})),
dp AS (SELECT DISTINCT a.chat, a.gram FROM ky a JOIN ky b ON a.chat = b.chat AND length(a.gram) < length(b.gram) AND contains(b.gram, a.gram) AND b.fa + b.fb >= 0.8::DOUBLE * (a.fa + a.fb)),
kp AS (SELECT ky.* FROM ky ANTI JOIN dp ON dp.chat = ky.chat AND dp.gram = ky.gram),
zz AS (SELECT kp.*, {up("(ln((fa + 0.01::DOUBLE) / (na + 0.01::DOUBLE * v - fa - 0.01::DOUBLE)) - ln((fb + 0.01::DOUBLE) / (nb + 0.01::DOUBLE * v - fb - 0.01::DOUBLE))) * 1000")} / 1000 AS z FROM kp JOIN tot USING (chat) JOIN (SELECT chat, count(*) AS v FROM kp GROUP BY chat) vv USING (chat)),
pg AS (SELECT chat, CASE WHEN z > 0 THEN 'me' ELSE 'other' END AS side, gram, z, fa AS me, fb AS other, row_number() OVER (PARTITION BY chat, z > 0 ORDER BY abs(z) DESC, first) AS place FROM zz WHERE z <> 0)"""


def q(select: str, *parts: str) -> str:
    return f"WITH {','.join(parts)} {select}"


def on_events(select: str, *more: str) -> str:
    return q(select, EVENTS, MARKED, METRICS, *more)


def on_turns(select: str, *more: str) -> str:
    return q(select, TURNS, MARKED, METRICS, *more)


def on_orders(select: str, *more: str) -> str:
    return q(select, ORDERS, MARKED, METRICS, *more)
