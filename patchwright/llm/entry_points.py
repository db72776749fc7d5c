"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import byte_bpe, conversation_repair, decontaminate, jaccard_join, lm_scoring, packing, pii, quality_rules, secrets, toxicity, url_filter, vector_codes, warc


def queries() -> dict:
    return {"op1_warc": warc.op1, "op2_decontaminate": decontaminate.op2, "op3_url_filter": url_filter.op3, "op4_jaccard_join": jaccard_join.op4, "op5_pii": pii.op5, "op6_quality_rules": quality_rules.op6, "op7_secrets": secrets.op7, "op8_lm_scoring": lm_scoring.op8, "op9_toxicity": toxicity.op9, "op10_packing": packing.op10, "op11_conversation_repair": conversation_repair.op11, "op12_vector_codes": vector_codes.op12, "op13_byte_bpe": byte_bpe.op13}


ORACLE = {}

ORACLE["op6_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT r, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT a.r, a.i, a.w1, b.w1 AS w2, c.w1 AS w3 FROM pos a JOIN pos b ON b.r = a.r AND b.i = a.i + 1 JOIN pos c ON c.r = a.r AND c.i = a.i + 2),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM win) WHERE n >= 2),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + o AS i FROM twice, (VALUES (0), (1), (2)) t(o)) GROUP BY r),
raw_line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT r, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS core FROM raw_line),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n, sum(length(core)) AS chars FROM ln WHERE core <> '' GROUP BY r),
norm AS (SELECT r, regexp_replace(lower(core), '[0-9]', '0', 'g') AS line, length(core) AS chars FROM ln WHERE core <> ''),
freq AS (SELECT d.source, line, count(DISTINCT (d.doc_id, d.text)) AS n FROM norm JOIN d USING (r) GROUP BY 1, 2),
wide AS (SELECT line, sum(n) AS n FROM freq GROUP BY 1),
bad AS (SELECT f.source, f.line FROM freq f JOIN wide w USING (line) WHERE f.n > 5 OR w.n > 20),
gone AS (SELECT norm.r, sum(chars) AS chars FROM norm JOIN d USING (r) JOIN bad ON bad.line = norm.line AND bad.source IS NOT DISTINCT FROM d.source GROUP BY 1),
base AS (SELECT d.doc_id, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(dup.chars, 0)::BIGINT AS line_chars, coalesce(gone.chars, 0)::BIGINT AS removed_chars
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_chars > 0.5 * line_chars AS depleted FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, removed_chars, depleted, NOT base_failed AND NOT depleted AS kept FROM f
"""


ORACLE["op2_decontaminate"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT k, item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT d.r, d.w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.r, dw.p, dw.n, bw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, k, item_id FROM hit) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN its USING (r)
"""


# base32 of SHA-1 by 5-bit steps over the blob's bits
ORACLE["op1_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT hex, string_agg(bin, '' ORDER BY i) AS bits FROM (SELECT hex, i, (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[strpos('0123456789abcdef', substr(hex, i, 1))] AS bin
  FROM (SELECT DISTINCT hex FROM p), range(1, 41) t(i)) GROUP BY hex),
d AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, k, 1)::INT + 8 * substr(bits, k + 1, 1)::INT + 4 * substr(bits, k + 2, 1)::INT + 2 * substr(bits, k + 3, 1)::INT + substr(bits, k + 4, 1)::INT, 1), '' ORDER BY k) AS b32
  FROM b, range(1, 161, 5) t(k) GROUP BY hex),
m AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN d USING (hex) JOIN m USING (hex)
"""


ORACLE["op12_vector_codes"] = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, q[4 * p + 1] AS a, q[4 * p + 2] AS b, q[4 * p + 3] AS c, q[4 * p + 4] AS d FROM v, range(16) t(p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM v QUALIFY e < 64),
book0 AS (SELECT p, e, a, b, c, d FROM parts JOIN first USING (r)),
near0 AS (SELECT x.r, x.p, min({'m': (x.a - k.a) ** 2 + (x.b - k.b) ** 2 + (x.c - k.c) ** 2 + (x.d - k.d) ** 2, 'e': k.e}) AS n FROM parts x JOIN book0 k USING (p) GROUP BY ALL),
mean1 AS (SELECT p, n.e AS e, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM near0 JOIN parts USING (r, p) GROUP BY ALL),
book1 AS (SELECT p, k.e, coalesce((m.a - ((m.a % m.n) + m.n) % m.n) // m.n, k.a) AS a, coalesce((m.b - ((m.b % m.n) + m.n) % m.n) // m.n, k.b) AS b,
  coalesce((m.c - ((m.c % m.n) + m.n) % m.n) // m.n, k.c) AS c, coalesce((m.d - ((m.d % m.n) + m.n) % m.n) // m.n, k.d) AS d FROM book0 k LEFT JOIN mean1 m USING (p, e)),
near1 AS (SELECT x.r, x.p, min({'m': (x.a - k.a) ** 2 + (x.b - k.b) ** 2 + (x.c - k.c) ** 2 + (x.d - k.d) ** 2, 'e': k.e}) AS n FROM parts x JOIN book1 k USING (p) GROUP BY ALL),
mean2 AS (SELECT p, n.e AS e, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM near1 JOIN parts USING (r, p) GROUP BY ALL),
book2 AS (SELECT p, k.e, coalesce((m.a - ((m.a % m.n) + m.n) % m.n) // m.n, k.a) AS a, coalesce((m.b - ((m.b % m.n) + m.n) % m.n) // m.n, k.b) AS b,
  coalesce((m.c - ((m.c % m.n) + m.n) % m.n) // m.n, k.c) AS c, coalesce((m.d - ((m.d % m.n) + m.n) % m.n) // m.n, k.d) AS d FROM book1 k LEFT JOIN mean2 m USING (p, e)),
near2 AS (SELECT x.r, x.p, min({'m': (x.a - k.a) ** 2 + (x.b - k.b) ** 2 + (x.c - k.c) ** 2 + (x.d - k.d) ** 2, 'e': k.e}) AS n FROM parts x JOIN book2 k USING (p) GROUP BY ALL),
coded AS (SELECT r, string_agg(lpad(lower(hex(n.e)), 2, '0'), '' ORDER BY p) AS code, sum(n.m)::BIGINT AS error FROM near2 GROUP BY r),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN v USING (r) GROUP BY label),
books AS (SELECT sha256(string_agg(a::BIGINT || ',' || b::BIGINT || ',' || c::BIGINT || ',' || d::BIGINT, ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM v JOIN coded USING (r) JOIN sums ON v.label IS NOT DISTINCT FROM sums.label, books
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
