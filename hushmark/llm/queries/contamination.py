"""op8: benchmark items in all documents."""

from __future__ import annotations

from hushmark.llm import contamination as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NAME = "op8_decontamination"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
  FROM (SELECT item, ws, least({op.WINDOW}, len(ws)) AS n, unnest(range(1, greatest(len(ws) - {op.WINDOW}, 0) + 2)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
places AS (SELECT r, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(ws) >= n)),
hits AS (SELECT r, n, i, item FROM places JOIN item_windows USING (n, w)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""
