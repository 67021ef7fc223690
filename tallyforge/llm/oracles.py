"""DuckDB SQL of the corpus queries that SQL can express, over whole tables; written from the contracts, not from the operators."""

from __future__ import annotations

#: Words between blanks; words of letters, digits and characters beyond ASCII, A-Z as a-z.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate({{0}}, '{_UPPER}', '{_LOWER}')"
_BLANK_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Links are found by shared shingles; the smallest id reachable by walking along links.
OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_BLANK_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') || ' |' || len(w) ELSE array_to_string(list_slice(w, k, k + 4), ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

OP3 = f"""
WITH w AS (SELECT doc_id, {_BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(list_slice(w, k, k + 19), ' ') ORDER BY doc_id, k) AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM w WHERE len(w) >= 20) x),
gone AS (SELECT DISTINCT doc_id, k + unnest(range(0, 20)) AS k FROM g WHERE r > 1),
each AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w) x),
kept AS (SELECT e.doc_id, count(g.k) AS n_removed, string_agg(e.word, ' ' ORDER BY e.k) FILTER (WHERE g.k IS NULL) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.k = e.k GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 20
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k, k + 9), ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0) x),
dw AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM bw) l ON len(w) >= n) x),
hit AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.t = dw.t),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, k + unnest(range(0, n)) AS k FROM hit) x GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
