"""op13: collocations of all documents, per language."""

from __future__ import annotations

from hushmark.llm import collocations as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {k} AS k, array_to_string(ws[i + 1 : i + {k}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(0, len(ws) - {k} + 1)) AS i FROM pieces WHERE len(ws) >= {k})"
    for k in range(1, op.LONGEST + 1))
_ORACLE = f"""
    WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    pieces AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM texts),
    totals AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY 1),
    phrases AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {op.LEAST}),
    cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 : k], ' ') AS tail
        FROM (SELECT *, unnest(range(1, k)) AS j FROM phrases WHERE k >= 2) c),
    best AS (SELECT lang, phrase, a, n, min({{score: CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT), j: j, l: l.f, r: r.f}}) AS b
        FROM cuts JOIN totals USING (lang) JOIN (SELECT lang, phrase AS head, f FROM phrases) l USING (lang, head) JOIN (SELECT lang, phrase AS tail, f FROM phrases) r USING (lang, tail) GROUP BY ALL),
    inside AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, f FROM (
        SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM phrases WHERE k >= 3))),
    kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, CAST(n AS BIGINT) AS n, b.score AS score
    FROM kept QUALIFY rank <= {op.TOP}"""

NAME, ORACLE = "op13_collocations", _ORACLE
