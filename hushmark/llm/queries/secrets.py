"""op1: secrets of all documents."""

from __future__ import annotations

from hushmark.llm import secrets as op
from hushmark.llm.common import table


def query(spark, sf_dir):
    return op.digest(op.find_secrets(table(spark, sf_dir, "documents")))


def _located(kind: str, rank: int, pattern: str, kept: str) -> str:
    return f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS rank, pos AS start, pos + length(v) AS "end", v FROM (
      SELECT doc_id, v, i, coalesce(sum(length(g)) OVER w, 0) + coalesce(sum(length(v)) OVER before, 0) AS pos
      FROM (SELECT doc_id, unnest(found) AS v, unnest(gaps) AS g, generate_subscripts(found, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS found,
                         list_slice(string_split_regex(t, {pattern}), 1, len(regexp_extract_all(t, {pattern}))) AS gaps FROM src))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i), before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE {kept}"""


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _entropy(kind: op.EntropyClass, rank: int) -> str:
    terms = "[" + ", ".join(map(str, kind.terms())) + "]"
    return f"""
    SELECT doc_id, '{kind.kind}' AS kind, {rank} AS rank, min(pos) AS start, max(pos) + {kind.window} AS "end" FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY doc_id, run_at ORDER BY pos) AS island FROM (
        SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, run_at ORDER BY pos) <= {kind.window} THEN 0 ELSE 1 END AS fresh FROM (
          SELECT doc_id, run_at, run_at + o AS pos, substr(run, CAST(o AS INT) + 1, {kind.window}) AS w
          FROM (SELECT *, unnest(range(0, length(run) - {kind.window} + 1)) AS o FROM (
            SELECT doc_id, start + coalesce(sum(length(g)) OVER b, 0) + coalesce(sum(length(run)) OVER p, 0) AS run_at, run FROM (
              SELECT doc_id, start, v, unnest(regexp_extract_all(v, {_text(kind.runs())})) AS run,
                     unnest(list_slice(string_split_regex(v, {_text(kind.runs())}), 1, len(regexp_extract_all(v, {_text(kind.runs())})))) AS g,
                     generate_subscripts(regexp_extract_all(v, {_text(kind.runs())}), 1) AS i FROM candidates)
            WINDOW b AS (PARTITION BY doc_id, start ORDER BY i), p AS (PARTITION BY doc_id, start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))
        WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: {terms}[length(w) - length(replace(w, c, '')) + 1])) <= {kind.limit()}))
    GROUP BY doc_id, run_at, island"""


def _oracle() -> str:
    kinds = {k: (p, g, n) for k, p, g, n in op.PATTERNS}
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(kinds.items(), 1):
        value = f"regexp_extract(v, {_text(pattern)}, {group})" if group else "v"
        parts.append(f"SELECT doc_id, kind, rank, start, \"end\" FROM ({_located(kind, rank, _text(pattern), f'length({value}) >= {least}')})")
    parts += [_entropy(e, len(kinds) + n) for n, e in enumerate(op.ENTROPY, 1)]
    allowed = " OR ".join(f"regexp_matches(v, {_text(p)})" for p in op.ALLOWED)
    base = ", ".join(f"'{k}'" for k in kinds)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    listed = "string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(\"end\" AS VARCHAR), ',' ORDER BY start, rank, \"end\")"
    return f"""
    WITH src AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    candidates AS (SELECT doc_id, start, v FROM ({_located('candidate', 0, _text(op.CANDIDATE), f'NOT ({allowed})')})),
    spans AS ({' UNION ALL '.join(parts)}),
    found AS (SELECT doc_id, {counts}, {listed} FILTER (WHERE kind IN ({base})) AS base, {listed} AS spans FROM spans GROUP BY doc_id)
    SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM src LEFT JOIN found USING (doc_id)"""


NAME, ORACLE = "op1_secret_scan", _oracle()
