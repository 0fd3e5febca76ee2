"""op11: codes of all embeddings."""

from __future__ import annotations

from hushmark.llm import vectorcode as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.encoded(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    nearest = """SELECT vec_id, p, min({{d: d, e: e}}) AS best FROM (
        SELECT a.vec_id, a.p, b.e, sum((a.x - b.x) * (a.x - b.x)) AS d FROM cells a JOIN book{r} b ON a.p = b.p AND a.i = b.i GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    steps = []
    for r in range(op.ROUNDS):
        steps += [
            f"near{r} AS MATERIALIZED ({nearest.format(r=r)})",
            f"""book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
                SELECT c.p, n.best.e AS e, c.i, CAST((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
                FROM cells c JOIN near{r} n ON c.vec_id = n.vec_id AND c.p = n.p GROUP BY 1, 2, 3) m ON b.p = m.p AND b.e = m.e AND b.i = m.i)""",
        ]
    return f"""
    WITH kept AS (SELECT vec_id, label, embedding AS x, len(embedding) // {op.PARTS} AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    cells AS MATERIALIZED (SELECT vec_id, (j // w) AS p, j % w AS i, CAST(floor({op.SCALE} * CAST(x[j + 1] AS DOUBLE)) AS BIGINT) AS x
        FROM (SELECT *, unnest(range(len(x))) AS j FROM kept)),
    starts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {op.ENTRIES}),
    book0 AS MATERIALIZED (SELECT p, e, i, x FROM cells JOIN starts USING (vec_id)),
    {', '.join(steps)},
    near AS MATERIALIZED ({nearest.format(r=op.ROUNDS)}),
    coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near GROUP BY 1)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{op.ROUNDS}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""


NAME, ORACLE = "op11_vector_codes", _oracle()
