"""DuckDB SQL of those queries of this subpackage that SQL can express over whole tables."""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)]) END AS gs FROM w),
n AS (SELECT doc_id, len(gs) AS n FROM g),
x AS (SELECT doc_id, unnest(gs) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS src, doc_id AS dst FROM documents UNION SELECT r.src, u.b FROM r JOIN both_ways u ON u.a = r.dst)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, (SELECT min(dst) FROM r WHERE r.src = n.doc_id) AS component_id FROM n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1}
