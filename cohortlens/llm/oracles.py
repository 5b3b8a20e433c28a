"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .centroids import CENTROIDS, DIMS, ROUNDS, SCALE
from .quality_rules import ENDS, PHRASES, Rules as QualityRules
from .ranked_search import TOP

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{_WORD}')"


OP7 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN octet_length(encode(html)) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS response
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM d
"""

OP9 = f"""
WITH l AS (
  SELECT doc_id, u.pos, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u
), f AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.*, coalesce(l.doc_id < f.keeper, false) AS gone FROM l LEFT JOIN f ON f.k = l.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_r = QualityRules()
_PHRASES = " OR ".join(f"contains(translate(line, '{_UPPER}', '{_LOWER}'), '{p}')" for p in PHRASES)
_ENDS = " OR ".join("ends_with(w[-1], '{}')".format(e.replace("'", "''")) for e in ENDS)
_SYMBOLS = "len(regexp_extract_all({}, '[#*$%&|<>]'))"

OP10 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, u.pos, u.line, {_words('u.line')} AS w
  FROM d, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
), n AS (
  SELECT doc_id, len(w) AS words, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again,
         {_PHRASES}
         OR len(list_filter(w, lambda x: x IN ('|', '>', '»', '*'))) >= {_r.bars}
         OR 100 * {_SYMBOLS.format('line')} > {_r.symbol_percent} * len(w)
         OR 100 * len(list_filter(w, lambda x: ends_with(x, '!!'))) > {_r.shout_percent} * len(w)
         OR (len(w) < {_r.short_words} AND NOT ({_ENDS})) AS fails
  FROM l WHERE len(w) > 0
), s AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_failed,
         coalesce(sum(words) FILTER (fails), 0) AS n_words_lost
  FROM n GROUP BY doc_id
), w AS (
  SELECT doc_id, {_words('text')} AS w FROM d
), t AS (
  SELECT doc_id, i, row(w[i], w[i + 1], w[i + 2]) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM t) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id
), b AS (
  SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST({_SYMBOLS.format('d.text')} AS BIGINT) AS n_symbols, coalesce(s.n_dup_lines, 0) AS n_dup_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(s.n_lines_failed, 0) AS n_lines_failed,
         CAST(coalesce(s.n_words_lost, 0) AS BIGINT) AS n_words_lost
  FROM d JOIN w ON w.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
)
SELECT *, n_words < {_r.least_words} OR 100 * n_repeat_words > {_r.repeat_percent} * n_words AS base_failed,
       NOT (n_words < {_r.least_words} OR 100 * n_repeat_words > {_r.repeat_percent} * n_words)
       AND 100 * n_words_lost <= {_r.lost_percent} * n_words AS kept
FROM b
"""

#: Shingles and links of op1, components by repeated minima. Links are found through shared shingles, so no link is missed.
OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents
), x AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
), k AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, s FROM x
), e AS MATERIALIZED (
  SELECT doc_id, n, hash(unnest(s)) AS g FROM k
), l AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), r(doc_id, c) AS (
  SELECT u, v FROM l
  UNION
  SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.c
)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, least(k.doc_id, coalesce(m.c, k.doc_id)) AS component_id,
       k.doc_id = least(k.doc_id, coalesce(m.c, k.doc_id)) AS kept
FROM k LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = k.doc_id
"""

#: Rounds of op12, one set of relations each; integers only, so that no order of summation matters.
_NEAR = """
{a} AS MATERIALIZED (
  SELECT key, arg_min(cluster, ROW(distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT x.key, c.cluster, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS distance
    FROM x JOIN {c} c ON c.d = x.d GROUP BY x.key, c.cluster
  ) GROUP BY key
)"""
_MOVED = """
{m} AS MATERIALIZED (
  SELECT c.cluster, c.d, CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v
  FROM {c} c LEFT JOIN (
    SELECT a.cluster, x.d, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM x JOIN {a} a ON a.key = x.key GROUP BY a.cluster, x.d
  ) t ON t.cluster = c.cluster AND t.d = c.d
)"""
_ROUNDS = ",".join(_NEAR.format(a=f"a{r}", c=f"c{r}") + "," + _MOVED.format(m=f"c{r + 1}", c=f"c{r}", a=f"a{r}") for r in range(ROUNDS))

OP12 = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS key, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMS}
), x AS MATERIALIZED (
  SELECT key, d, CAST(floor({SCALE} * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS v FROM k, range(1, {DIMS + 1}) r(d)
), f AS (
  SELECT key, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM k ORDER BY cluster LIMIT {CENTROIDS}
), c0 AS MATERIALIZED (
  SELECT f.cluster, x.d, x.v FROM f JOIN x ON x.key = f.key
),{_ROUNDS},{_NEAR.format(a='z', c=f'c{ROUNDS}')}, h AS (
  SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster
)
SELECT k.vec_id, CAST(z.cluster AS INTEGER) AS cluster, z.distance, CAST(sum(z.distance) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(z.distance) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM z JOIN k ON k.key = z.key JOIN h ON h.cluster = z.cluster
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""
WITH t AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents
  ) GROUP BY doc_id, term
), d AS MATERIALIZED (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id
), s AS MATERIALIZED (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark
  ) GROUP BY item_id, term
), w AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY term
), p AS (
  SELECT t.doc_id, t.term, w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + (75 * d.n * s.docs) // s.terms))) AS impact
  FROM t JOIN w ON w.term = t.term JOIN d ON d.doc_id = t.doc_id, s
), r AS (
  SELECT q.item_id, p.doc_id, CAST(sum(q.times * p.impact) AS BIGINT) AS score FROM q JOIN p ON p.term = q.term GROUP BY q.item_id, p.doc_id
), o AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= {TOP}
"""

ORACLES = {
    "op1_minhash_near_dedup": OP1,
    "op7_warc": OP7,
    "op9_line_dedup": OP9,
    "op10_quality_rules": OP10,
    "op11_ranked_search": OP11,
    "op12_centroid_clusters": OP12,
}
