"""SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from . import licenses
from .counts import TOKENIZERS

OP2 = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
o AS (SELECT doc_id, no, trim(raw, ' ') AS line, length(trim(raw, ' ')) AS n, row_number() OVER (ORDER BY doc_id, no) AS k FROM l WHERE length(trim(raw, ' ')) > 0),
e AS (SELECT line, n, min(k) AS k FROM o GROUP BY ALL), f AS (SELECT * FROM e WHERE n >= 20),
h AS (
  SELECT a.line AS a, b.line AS b, a.n AS la, b.n AS lb, greatest(a.k, b.k) AS late FROM f a JOIN f b ON a.n = b.n AND a.k < b.k AND left(a.line, a.n // 2) = left(b.line, a.n // 2)
  UNION ALL SELECT a.line, b.line, a.n, b.n, greatest(a.k, b.k) FROM f a JOIN f b ON a.n = b.n AND a.k < b.k AND right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)
  UNION ALL SELECT a.line, b.line, a.n, b.n, greatest(a.k, b.k) FROM f a JOIN f b ON a.n = b.n + 1 AND left(a.line, b.n // 2) = left(b.line, b.n // 2)
  UNION ALL SELECT a.line, b.line, a.n, b.n, greatest(a.k, b.k) FROM f a JOIN f b ON a.n = b.n + 1 AND right(a.line, b.n - b.n // 2) = right(b.line, b.n - b.n // 2)),
m AS (SELECT *, coalesce(list_position(list_transform(range(1, lb + 1), lambda i: a[i] = b[i]), false), lb + 1) AS c FROM h),
near AS (SELECT DISTINCT late FROM m WHERE (la = lb AND substr(a, c::BIGINT + 1) = substr(b, c::BIGINT + 1)) OR (la = lb + 1 AND substr(a, c::BIGINT + 1) = substr(b, c::BIGINT))),
x AS (SELECT o.doc_id, o.no FROM o JOIN e USING (line) WHERE o.k > e.k OR e.k IN (SELECT late FROM near)),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
  FROM (SELECT l.*, x.no IS NOT NULL AS gone FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.no = x.no) GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_dropped, 0) AS n_dropped, length(t.text)::BIGINT AS n_chars, sha256(t.text) AS text_sha256 FROM documents d LEFT JOIN t USING (doc_id)"""

OP5 = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (n + m - c)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS comp FROM s UNION SELECT e.y, r.comp FROM r JOIN e ON r.node = e.x)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.comp) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.g)"""


def _count(name: str) -> str:
    pattern = TOKENIZERS[name].replace("'", "''")
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"


_ONE, _TWO = TOKENIZERS
OP6 = f"""
WITH d AS (SELECT source, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN '{_TWO}' ELSE '{_ONE}' END AS tokenizer, {_count(_ONE)} AS one, {_count(_TWO)} AS two
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT source, lang, tokenizer, count(*) AS docs, sum(CASE WHEN tokenizer = '{_ONE}' THEN one ELSE two END)::BIGINT AS tokens FROM d GROUP BY ALL"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM p"""

OP9 = """
WITH c AS (SELECT conv_id, turn, text, 'call-' || conv_id || '-' || turn AS id FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, text, 'call-' || conv_id || '-' || (turn - 1) AS id FROM conversations WHERE role <> 'assistant' AND turn > 0),
b AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.id, r.id) AS call_id, coalesce(c.turn, r.turn) * 1048576 AS place, CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'pending' ELSE 'linked' END AS status,
  '{"arguments":' || CASE WHEN c.id IS NULL THEN 'null' ELSE '{"chars":' || length(c.text) || ',"text":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '}' END || ',"id":"' || coalesce(c.id, r.id) || '","name":' || CASE WHEN c.id IS NULL THEN 'null' ELSE '"answer"' END
  || ',"problem":null,"result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || ',"status":"' || CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'pending' ELSE 'linked' END || '"}' AS json FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.id = r.id)
SELECT conv_id, call_id, place, status, NULL::VARCHAR AS problem, strlen(json)::BIGINT AS json_bytes, sha256(json) AS json_sha256 FROM b"""


def _templates() -> str:
    rows = []
    for name, text in licenses.TEMPLATES:
        pairs = ", ".join(f"'{p}'" for p in licenses.template_pairs(text))
        rows.append(f"('{name}', [{pairs}])")
    return ", ".join(rows)


OP10 = f"""
WITH t(license, pairs) AS (VALUES {_templates()}),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
w AS (SELECT doc_id, place, list_filter(string_split(lower(regexp_replace(unit, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM l),
p AS (SELECT doc_id, place, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS own FROM w WHERE len(w) BETWEEN 1 AND 2000),
m AS (SELECT doc_id, license, place, 2.0::DOUBLE * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) AS dice FROM p JOIN t ON list_has_any(own, pairs)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, place) AS k FROM m WHERE dice >= 0.8)
SELECT doc_id, license, dice, place::INT AS place FROM r WHERE k = 1"""

def _paid(state: str, cost: object, token: str) -> str:
    """A state's best edits so far, eight digits of cost before them, and one edit more; null stays null."""
    return f"lpad((substr({state}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({state}, 9) || '{token}'"


def _row_step() -> str:
    """Best edits by state after a row, from those by state with inserts (a0 to a3); edits are two letters each, so that the least text is the least cost and then the least letters."""
    cut = "CASE fault WHEN 2 THEN 1 ELSE 0 END"
    keep = lambda state, initial: f"CASE WHEN fault IN (0, 2) AND initial = '{initial}' THEN {_paid(state, cut, 'K.')} END"
    name = lambda state, token: f"CASE WHEN fault IN (0, 2) THEN {_paid(state, f'2 + {cut}', token)} END"
    to_user = [x for q in ("a0", "a1", "a3") for x in (keep(q, "u"), name(q, "Ru"))]
    steps = [[], [keep("a0", "s")], to_user, [keep("a2", "a"), name("a2", "Ra")]]
    return ", ".join(f"least({', '.join([_paid(f'a{q}', 3, 'D.'), *ways])}) AS s{q}" if ways else f"{_paid(f'a{q}', 3, 'D.')} AS s{q}" for q, ways in enumerate(steps))


_WITH_USER = f"least(s2, {', '.join(_paid(q, 2, 'Iu') for q in ('s0', 's1', 's3'))})"
_ROLE = "CASE right(token, 1) WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE role END"
OP11 = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fate FROM conversations),
m AS (SELECT k, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE fate <> 0),
f AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM m),
t AS (SELECT *, CASE WHEN last = '' THEN 3 WHEN seen > 1 THEN 1 WHEN last NOT IN ('.', '!', '?') THEN 2 ELSE 0 END AS fault, initial || lead(initial) OVER (PARTITION BY k ORDER BY i) AS pair FROM f),
r AS (SELECT DISTINCT k, 0::BIGINT AS i, '00000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM t
  UNION ALL SELECT k, i, {_row_step()} FROM (SELECT k, t.i, initial, fault, s0 AS a0, s1 AS a1, a2, least(s3, {_paid('a2', 2, 'Ia')}) AS a3 FROM (SELECT *, {_WITH_USER} AS a2 FROM r) b JOIN t USING (k) WHERE t.i = b.i + 1)),
e AS (SELECT k, least(s0, s3, {_paid('a2', 2, 'Ia')}) AS best FROM (SELECT *, {_WITH_USER} AS a2 FROM r) WHERE (k, i) IN (SELECT k, max(i) FROM t GROUP BY k)),
o AS (SELECT k, generate_subscripts(w, 1) AS no, unnest(w) AS token FROM (SELECT k, regexp_extract_all(substr(best, 9), '..') AS w FROM e)),
p AS (SELECT *, sum((left(token, 1) <> 'I')::INT) OVER (PARTITION BY k ORDER BY no) AS i FROM o),
d AS (SELECT p.k, string_agg({_ROLE} || ':' || CASE left(token, 1) WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY no) AS mended FROM p LEFT JOIN t ON p.k = t.k AND p.i = t.i WHERE token <> 'D.' GROUP BY p.k),
g AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 1) AS duplicate, count(*) FILTER (fault = 2) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY k)
SELECT h.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(best, 8)::BIGINT, 0) AS cost,
  coalesce(regexp_replace(substr(best, 9), '(.).', '\1', 'g'), '') AS audit, sha256(coalesce(mended, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id, k FROM c) h LEFT JOIN g USING (k) LEFT JOIN e USING (k) LEFT JOIN d USING (k)"""

OP13 = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""

ORACLES = {"op2_line_dedup": OP2, "op5_ngram_jaccard": OP5, "op6_token_counts": OP6, "op7_topk": OP7, "op8_warc": OP8, "op9_chat": OP9, "op10_licenses": OP10, "op11_repair": OP11, "op13_exact_dedup": OP13}
