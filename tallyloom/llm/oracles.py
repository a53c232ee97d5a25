"""SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item, list_slice(w, k, k + least(len(w), 10) - 1) AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(p) AS n FROM p),
c AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS p FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS k FROM d, n)),
m AS (SELECT doc_id, k, n, item FROM c JOIN p USING (p)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_CLOSED = """reach(a, b) AS (SELECT DISTINCT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS k FROM d) GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN t p ON a = p.doc_id JOIN t q ON b = q.doc_id WHERE c / (p.n + q.n - c) >= 0.8), {_CLOSED}
SELECT doc_id, least(doc_id, coalesce(b, doc_id)) AS class_id, doc_id <= coalesce(b, doc_id) AS kept FROM documents LEFT JOIN least_of ON doc_id = a"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9), {_CLOSED},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN least_of ON vec_id = least_of.a LEFT JOIN n ON vec_id = n.a"""
