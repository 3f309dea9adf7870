"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op3_byte_bpe
from .langid import op5_language_id
from .licenses import op7_license_scan
from .media import op8_media_columns
from .mixing import op1_mixing_to_weights
from .negatives import op12_hard_negatives
from .packing import op13_best_fit_packing
from .simhash import op6_simhash_near_dedup
from .resampling import op11_importance_resampling
from .suffix_dedup import op9_suffix_array_dedup
from .token_counts import op10_token_counts
from .toxicity import op2_toxicity
from .vector_dedup import op4_embedding_near_dedup

QUERIES = {
    "op1_mixing_to_weights": op1_mixing_to_weights,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_media_columns": op8_media_columns,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLE: dict[str, str] = {}

#: Brute force: all pairs of vectors, and every node that the links lead to.
ORACLE["op4_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT r, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) AS x FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""

#: Brute force: every window of every text, as hexadecimal digits.
ORACLE["op9_suffix_array_dedup"] = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS MATERIALIZED (SELECT r, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN i + 400 <= n THEN hash(substr(h, 2 * i + 1, 800)) END AS w4, CASE WHEN i + 200 <= n THEN hash(substr(h, 2 * i + 1, 400)) END AS w2
  FROM (SELECT r, h, n, unnest(range(n)) AS i FROM d)),
f AS MATERIALIZED (SELECT r, i, x, w4 IS NOT NULL AND count(*) OVER (PARTITION BY w4) > 1 AS again4, w2 IS NOT NULL AND count(*) OVER (PARTITION BY w2) > 1 AS again2, x NOT IN ('20', '09', '0A', '0B', '0C', '0D') AS inside FROM p),
g AS (SELECT *, coalesce(max(CASE WHEN again4 THEN i END) OVER o > i - 400, false) AS cut, i - sum(CAST(again2 AS INTEGER)) OVER o AS island,
  sum(CASE WHEN inside AND NOT coalesce(lag_inside, false) THEN 1 ELSE 0 END) OVER o AS words FROM (SELECT *, lag(inside) OVER (PARTITION BY r ORDER BY i) AS lag_inside FROM f) WINDOW o AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g WHERE again2 GROUP BY r, island),
t AS (SELECT s.r, s.a, s.b FROM s JOIN g x ON x.r = s.r AND x.i = s.a JOIN g y ON y.r = s.r AND y.i = s.b - 1 WHERE y.words - x.words + CAST(x.inside AS INTEGER) > 50),
q AS (SELECT g.r, g.i, g.x, g.cut, coalesce(max(t.b) OVER (PARTITION BY g.r ORDER BY g.i ROWS UNBOUNDED PRECEDING) > g.i, false) AS wordy FROM g LEFT JOIN t ON t.r = g.r AND t.a = g.i),
e AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER o, false) AS cut_start, wordy AND NOT coalesce(lag(wordy) OVER o, false) AS wordy_start FROM q WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, count(*) FILTER (cut) AS n_removed, count(*) FILTER (cut_start) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT cut), '') AS kept, count(*) FILTER (wordy_start) AS n_passages, count(*) FILTER (wordy) AS passage_bytes FROM e GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(n_passages, 0) AS n_passages, coalesce(passage_bytes, 0) AS passage_bytes FROM d LEFT JOIN k USING (r)"""

#: crc32 by its definition, byte by byte, of each distinct run of words.
ORACLE["op11_importance_resampling"] = """
WITH e AS (SELECT row_number() OVER () AS r, doc_id, text, true AS source FROM documents UNION ALL SELECT 0, NULL, text, false FROM benchmark),
w AS MATERIALIZED (SELECT source, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM e),
f AS MATERIALIZED (SELECT source, r, doc_id, unnest(flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) AS f FROM w),
t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda v, n: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) x(i))),
h AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))), lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM f), t),
c AS (SELECT b, count(*) FILTER (source)::DOUBLE AS s, count(*) FILTER (NOT source)::DOUBLE AS t FROM f JOIN h USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM c),
d AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM f JOIN h USING (f) JOIN g USING (b) WHERE source GROUP BY r),
o AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d USING (r) WHERE source),
q AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () AS many FROM o)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * many // 100 THEN place END AS rank FROM q"""

#: Brute force: every anchor with every row.
ORACLE["op12_hard_negatives"] = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b) <= 5"""
