"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from itertools import permutations

from .quality_rules import RULES, STOP_WORDS, SYMBOLS
from .url_filter import BLOCKED, RULES as URL_RULES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_BOUNDS = " AND ".join(f"{r.measure} {sign} {bound}" for r in RULES for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None)

OP1 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l
  FROM documents),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_quoted(dict.fromkeys(STOP_WORDS))}))) AS stops, len(l) AS n_lines
  FROM t LEFT JOIN hit USING (r)),
f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
         coalesce(stops / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
         coalesce(n_words / nullif(n_lines, 0), 0) AS mean_line_words
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_BOUNDS} AS kept FROM f
"""

_FITS = "\n  UNION ALL ".join(
    f"SELECT page_id, '{r.target}' AS rule, '{r.verdict}' AS verdict, {k} AS k FROM u WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
    for k, r in enumerate(URL_RULES)
    for h, _, p in [r.target.partition("/")]
)

OP3 = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_AZ}), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fits AS ({_FITS}),
best AS (SELECT page_id, rule, verdict FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, k) AS n FROM fits) WHERE n = 1)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN {" OR ".join(f"contains(host, '{b.strip('*')}')" for b in BLOCKED)} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""

# levenshtein() counts bytes: it only rules out; equal characters from either end tell one edit
_SAME = "(list_position(list_transform(list_zip({a}, {b}), lambda z: coalesce(z[1] = z[2], false)), false) - 1)"
_AHEAD = _SAME.format(a="string_split(x.t, '')", b="string_split(y.t, '')")
_BEHIND = _SAME.format(a="list_reverse(string_split(x.t, ''))", b="list_reverse(string_split(y.t, ''))")

OP4 = rf"""
WITH raw AS (
  SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
l AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM raw),
f AS (SELECT t, min((doc_id, pos)) AS spot, length(t) AS n FROM l WHERE t <> '' GROUP BY t),
k AS (
  SELECT t, spot, n, m, left(t, (m // 2)::INT) AS half, 0 AS b FROM f, unnest([n, n - 1]) AS x(m)
  UNION ALL SELECT t, spot, n, m, right(t, (m - m // 2)::INT) AS half, 1 AS b FROM f, unnest([n, n - 1]) AS x(m)),
near AS (SELECT DISTINCT y.t FROM k x JOIN k y ON x.m = y.m AND x.b = y.b AND x.half = y.half AND x.spot < y.spot AND (x.n = x.m OR y.n = y.m) AND levenshtein(x.t, y.t) <= 4
  AND {_AHEAD} + {_BEHIND} >= greatest(x.n, y.n) - 1),
kept AS (SELECT l.*, t = '' OR ((doc_id, pos) = f.spot AND near.t IS NULL) AS stays FROM l LEFT JOIN f USING (t) LEFT JOIN near USING (t)),
per_doc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (stays) AS text FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(p.text, '') END AS text
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""

OP5 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""

_QUINTETS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * q + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31) + 1)::INT, 1)" for q in range(8) for j in range(4)
)

OP6 = rf"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_QUINTETS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT doc_id, m, i, item_id FROM dw JOIN bw USING (m, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM h)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SPACE = r"'[^\x20\x09-\x0D]+'"
_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))

OP11 = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_SPACE}) AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (SELECT o, s, list_transform(range(1, 6), lambda k: instr('ABCDE', substr(o, k, 1))) AS ord FROM (VALUES {_ORDERS}) AS x(o), range(1, 6) AS y(s)),
x AS (SELECT part, o, s, ord[s] AS i, n, good, toxic, fails, list_bool_or(list_transform(ord[1:s - 1], lambda i: fails[i])) IS TRUE AS before, fails[ord[s]] AS here FROM c, o),
r AS (
  SELECT part, o, s, i, sum(n) FILTER (NOT before AND NOT here) AS kept, sum(n) FILTER (here AND NOT before) AS removed, sum(n) FILTER (here AND before) AS redundant,
    sum(n) FILTER (here AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails, sum(good) FILTER (here AND NOT before) AS good_lost, sum(toxic) FILTER (here AND NOT before) AS toxic_lost
  FROM x GROUP BY ALL),
z AS (SELECT part, i, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT part, o AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(shapley, 0)::BIGINT AS shapley
FROM r JOIN z USING (part, i)
"""

# CRC-32 of a text, from a table made by its rule; {h} is a column with the hexadecimal digits of the text's bytes
_CRC_TABLE = "crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_table)"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all({h}, '..'), lambda p: ('0x' || p)::BIGINT), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _least_repairs() -> str:
    """Turn by turn, the best (cost in nine digits, audit) of each state of the grammar, as one string each, so the least string is the best."""
    plus = lambda v, cost, letter: f"(lpad((substr({v}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{letter}')"
    least = lambda *vs: f"least({', '.join(vs)})"
    insert = lambda v: plus(v, 2, "I")
    user, assistant = least("s2", insert("s0"), insert("s1"), insert("s3")), least("s3", insert("u2"))
    closed = f"SELECT *, {assistant} AS u3 FROM (SELECT *, {user} AS u2 FROM now)"
    keep = lambda v, letter: f"CASE WHEN initial = '{letter}' AND fault <> 1 THEN {plus(v, 'more', 'K')} END"
    rerole = lambda v: f"CASE WHEN fault <> 1 THEN {plus(v, '2 + more', 'R')} END"
    gone = lambda v: plus(v, 3, "D")
    to_user = [f(v, *x) for v in ("s0", "s1", "u3") for f, *x in ((keep, "u"), (rerole,))]
    return f"""s AS (
  SELECT conv_id, 0 AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM n
  UNION ALL
  SELECT conv_id, i + 1, {gone("s0")}, {least(keep("s0", "s"), gone("s1"))}, {least(*to_user, gone("u2"))}, {least(keep("u2", "a"), rerole("u2"), gone("u3"))}
  FROM ({closed.replace("FROM now", "FROM (SELECT s.*, f.initial, f.fault, CASE WHEN f.fault = 2 THEN 1 ELSE 0 END AS more FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1) now")})),
best AS (SELECT conv_id, least(s0, u3) AS b FROM ({closed.replace("FROM now", "FROM (SELECT s.* FROM s JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = n.n) now")}))"""


OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(h="h")} % 20 AS code
  FROM (SELECT *, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations), crc),
g AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM d WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM g),
k AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS kind FROM o),
f AS (SELECT *, CASE WHEN kind IN ('blank', 'duplicate') THEN 1 WHEN kind = 'truncated' THEN 2 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS last_initial FROM k),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
    count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (i > 1 AND last_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
{_least_repairs()},
p AS (SELECT conv_id, substr(b, 1, 9)::BIGINT AS cost, substr(b, 10) AS audit FROM best),
e AS (SELECT conv_id, audit, j, substr(audit, j, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM p)),
m AS (SELECT conv_id, edit, j, (SELECT length(replace(e.audit, 'D', ''))) % 2 AS odd, j - count(*) FILTER (edit = 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w - 1 AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
q AS (
  SELECT m.conv_id, m.j, CASE WHEN edit = 'K' THEN f.role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END AS line
  FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i AND edit <> 'I' WHERE edit <> 'D'),
h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS whole FROM q GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13 = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, coalesce({_CRC.format(h="h")}, 0) AS text_crc32, md5(doc_id || '-0') AS u FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), crc),
o AS (SELECT source, (row_number() OVER (ORDER BY md5(concat_ws('-', source, '0'))) - 0.5::DOUBLE) / count(*) OVER () AS phase FROM (SELECT DISTINCT source FROM d)),
r AS (SELECT d.*, (row_number() OVER (PARTITION BY d.source ORDER BY u, doc_id) - 1 + phase) / count(*) OVER (PARTITION BY d.source) AS f FROM d JOIN o ON o.source IS NOT DISTINCT FROM d.source),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, u, doc_id) - 1 AS place, count(*) OVER () AS n FROM r),
s AS (SELECT *, place * 8 // n AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM s
"""

SQL = {
    "op1_quality_rules": OP1,
    "op3_url_filters": OP3,
    "op4_line_dedup": OP4,
    "op5_ngram_jaccard_join": OP5,
    "op6_warc": OP6,
    "op10_decontamination": OP10,
    "op11_filter_audit": OP11,
    "op12_conversation_repair": OP12,
    "op13_sharding": OP13,
}
