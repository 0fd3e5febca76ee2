"""A query finds its candidates once, however many of its steps read them."""

import pytest

from hushmark.plans import d_evidence
from hushmark.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["consensus_decision", "validate_decisions", "apply_plan", "validate_suggestions", "leak_scan", "verify_units"])
def test_candidates_are_found_once(spark, monkeypatch, name):
    calls, whole = [], d_evidence.detect_all
    monkeypatch.setattr(d_evidence, "detect_all", lambda *a, **k: calls.append(a) or whole(*a, **k))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
