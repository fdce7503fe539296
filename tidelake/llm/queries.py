"""The ten operators' queries over the whole documents table, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, media, mixing, neardup, pii, quality, sharding, tokencount, tokenfile, toxicity

QUERIES = {
    "op1_pii": pii.op1,
    "op2_mixing": mixing.op2,
    "op3_media": media.op3,
    "op4_tokenfile": tokenfile.op4,
    "op5_bpe": bpe.op5,
    "op6_tokencount": tokencount.op6,
    "op7_quality": quality.op7,
    "op8_toxicity": toxicity.op8,
    "op9_sharding": sharding.op9,
    "op10_neardup": neardup.op10,
}

#: op10 is sets and reachability, which SQL can say. The others hash, learn, draw or search, and are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_neardup": """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
s AS (SELECT doc_id, unnest(s) AS x FROM g),
n AS (SELECT doc_id, len(s) AS n FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 85 * (x.n + y.n - c.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(m.component_id AS BIGINT) AS component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)""",
}
