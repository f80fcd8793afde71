"""DuckDB SQL for the operators that SQL can express."""

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def line_frequency(source: str = "documents") -> str:
    """The CTEs of the line rules over ``source``; the last one is ``ruled``."""
    return rf"""
rows_ AS (SELECT row_number() OVER () AS rid, *, coalesce("text", '') AS t FROM {source}),
word_ AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM rows_),
line_ AS (SELECT rid, source, md5(t) AS doc, u.ln, u.pos FROM rows_, unnest(string_split(t, chr(10))) WITH ORDINALITY AS u(ln, pos)
  WHERE regexp_matches(u.ln, '[^\x20\x09-\x0D]')),
tri_ AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM word_)),
rep_ AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tri_) WHERE k > 1) GROUP BY rid),
dup_ AS (SELECT rid, count(*) - count(DISTINCT ln) AS n FROM line_ GROUP BY rid),
norm_ AS (SELECT rid, source, doc, ln, pos, trim(regexp_replace(regexp_replace(lower(ln), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l FROM line_),
host_ AS (SELECT source, count(DISTINCT md5(t)) AS n FROM rows_ GROUP BY source),
freq_ AS (SELECT f.source, f.l FROM (SELECT source, l, count(DISTINCT doc) AS n FROM norm_ GROUP BY source, l) f JOIN host_ h ON h.source IS NOT DISTINCT FROM f.source
  WHERE f.n > 10 AND 100 * f.n > h.n),
hit_ AS (SELECT n.rid, count(*) AS lines, sum(len(regexp_extract_all(n.ln, '[^\x20\x09-\x0D]+'))) AS words FROM norm_ n JOIN freq_ f ON f.source IS NOT DISTINCT FROM n.source AND f.l = n.l GROUP BY n.rid),
clean_ AS (SELECT r.rid, string_agg(u.ln, chr(10) ORDER BY u.pos) AS clean FROM rows_ r, unnest(string_split(r.t, chr(10))) WITH ORDINALITY AS u(ln, pos)
  WHERE NOT EXISTS (SELECT 1 FROM norm_ n JOIN freq_ f ON f.source IS NOT DISTINCT FROM n.source AND f.l = n.l WHERE n.rid = r.rid AND n.pos = u.pos) GROUP BY r.rid),
measured AS (SELECT r.*, len(w.w)::BIGINT AS n_words,
    (length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    coalesce(h.lines, 0)::BIGINT AS n_removed_lines, coalesce(h.words, 0)::BIGINT AS n_removed_words
  FROM rows_ r JOIN word_ w USING (rid) LEFT JOIN dup_ d USING (rid) LEFT JOIN rep_ p USING (rid) LEFT JOIN hit_ h USING (rid)),
failed AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM measured),
ruled AS (SELECT *, (NOT base_failed AND 100 * (n_words - n_removed_words) >= 30 * n_words) AS kept FROM failed)"""


LINE_FREQUENCY = f"""WITH {line_frequency()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines, n_removed_words FROM ruled"""

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, translate(coalesce("text", ''), {LETTERS}) AS t, row_number() OVER () AS rid FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rid) AS k FROM n)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM g"""


def source_targets(source: str) -> str:
    """CTEs from (source, size) rows of ``source`` to ``target_``: one row a source."""
    return f"""
size_ AS (SELECT source, sum(size)::BIGINT AS z FROM {source} GROUP BY source),
rank_ AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w,
  row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS r FROM size_),
fill_ AS (SELECT *, (3 * z) / w::DOUBLE AS ratio, (SELECT sum(z) FROM size_)::BIGINT AS all_,
  coalesce(sum(3 * z) OVER o, 0)::BIGINT AS before_z, (SELECT sum(w) FROM rank_) - coalesce(sum(w) OVER o, 0) AS rest_w FROM rank_
  WINDOW o AS (ORDER BY (3 * z) / w::DOUBLE, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open_ AS (SELECT * FROM fill_ WHERE (all_ - before_z) * w <= 3 * z * rest_w ORDER BY ratio, r LIMIT 1),
target_ AS (SELECT f.source, f.z, CASE WHEN f.ratio > o.ratio OR (f.ratio = o.ratio AND f.r >= o.r)
  THEN ((o.all_ - o.before_z) * f.w)::DOUBLE / o.rest_w::DOUBLE ELSE (3 * f.z)::DOUBLE END AS target FROM fill_ f LEFT JOIN open_ o ON true)"""


DRAW = "('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT / 4294967296.0::DOUBLE"

SOURCE_MIX = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
{source_targets("sized")},
rated AS (SELECT s.doc_id, s.size, t.z AS source_size, t.target, CASE WHEN t.z > 0 THEN t.target / t.z ELSE 0 END AS rate FROM sized s JOIN target_ t ON t.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN {DRAW} < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated"""

LINE_DEDUP = rf"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS t FROM documents),
line_ AS (SELECT rid, doc_id, u.ln, u.pos, trim(translate(u.ln, {LETTERS}), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS k
  FROM rows_, unnest(string_split(t, chr(10))) WITH ORDINALITY AS u(ln, pos)),
held_ AS (SELECT k, max(doc_id) AS holder FROM line_ WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id IS DISTINCT FROM h.holder AS gone FROM line_ l LEFT JOIN held_ h ON h.k = l.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(ln, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY rid"""

#: CRC-32 of texts, from its table of 256 entries: ``crc_of(source)`` is a CTE (w, crc) of the distinct w of ``source``.
CRC_TABLE = """
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(9)[2:], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)))"""


def crc_of(source: str) -> str:
    return f"""SELECT w, xor(list_reduce([('0x' || hex(encode(w))[2 * k + 1 : 2 * k + 2])::BIGINT FOR k IN range(octet_length(encode(w)))],
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM (SELECT DISTINCT w FROM {source}), crc_table"""


IMPORTANCE = rf"""
WITH {CRC_TABLE},
doc_ AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce("text", ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
own_ AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM doc_) GROUP BY ALL),
aim_ AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce("text", ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
all_ AS (SELECT w FROM own_ UNION SELECT w FROM aim_),
bucket_ AS MATERIALIZED (SELECT w, crc % 10000 AS b FROM ({crc_of("all_")})),
s_ AS (SELECT b, sum(n)::BIGINT AS s FROM own_ JOIN bucket_ USING (w) GROUP BY b), t_ AS (SELECT b, sum(n)::BIGINT AS t FROM aim_ JOIN bucket_ USING (w) GROUP BY b),
sums_ AS (SELECT coalesce((SELECT sum(s) FROM s_), 0)::BIGINT AS ss, coalesce((SELECT sum(t) FROM t_), 0)::BIGINT AS tt),
gain_ AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS g FROM s_ LEFT JOIN t_ USING (b), sums_),
weight_ AS (SELECT rid, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS z FROM own_ JOIN bucket_ USING (w) JOIN gain_ USING (b) GROUP BY rid),
scored AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce((z - ((z % n) + n) % n) // n, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS noise FROM doc_ LEFT JOIN weight_ USING (rid)),
ranked AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features) AS r,
  count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked"""

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
run_ AS (SELECT doc_id, r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce("text", ''), {LETTERS}), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) GROUP BY ALL),
key_ AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') || ':' || r AS w FROM run_ WHERE length(r) >= 5),
hashed AS MATERIALIZED (SELECT r, k, crc FROM key_ JOIN ({crc_of("key_")}) USING (w)),
made AS (SELECT CASE WHEN crc % 97 = 0 THEN r[1 : crc % length(r)] || r[crc % length(r) + 2 :] ELSE r END AS word, k FROM hashed),
word_ AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word_)),
near_ AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN word_ b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN word_ b ON a.d = b.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, max(m) AS m FROM near_ GROUP BY word),
first_ AS (SELECT b.word, min(e.other) AS other FROM best b JOIN near_ e ON e.word = b.word AND e.m = b.m GROUP BY b.word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 2 * w.n THEN f.other END AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM word_ w LEFT JOIN best b ON b.word = w.word LEFT JOIN first_ f ON f.word = w.word),
path_ AS (SELECT word, word AS at FROM formed UNION ALL SELECT p.word, f.form FROM path_ p JOIN formed f ON f.word = p.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, p.at AS root FROM formed f JOIN path_ p ON p.word = f.word JOIN formed z ON z.word = p.at AND z.form IS NULL"""
