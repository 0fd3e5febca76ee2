"""All registered queries."""

from __future__ import annotations

from hushmark.operators.pipeline import redact_all
from hushmark.plans import fixtures
from hushmark.plans import a_sources, b_formats, c_labels, d_evidence, e_grounding, f_masking, g_policy, h_audit, i_streaming
from hushmark.session import prepare

_MODULES = [a_sources, b_formats, c_labels, d_evidence, e_grounding, f_masking, g_policy, h_audit, i_streaming]


def _pinned(query):
    def run(spark, sf_dir):
        return query(prepare(spark), sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    return run


QUERIES = {name: _pinned(q) for module in _MODULES for name, q in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}


def flagship(spark, sf_dir):
    """Find personal data of every type in every unit, and return the units with it starred."""
    spark = prepare(spark)
    return redact_all(a_sources.all_units(spark, sf_dir), fixtures.TODAY).select("doc_id", "unit_seq", "unit_id", "redacted")
