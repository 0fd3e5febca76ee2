"""The union of few ranges, which most groups have, sets up no columns and gives what the union by columns gives."""

import random

import pyarrow as pa

from hushmark.functions import aggregates as A


def test_few_ranges_are_joined_one_by_one(monkeypatch):
    draw = random.Random(7)
    place = lambda: draw.choice([None, -1, *range(30)])
    groups = [[(place(), place()) for _ in range(n)] for n in (0, 1, 2, 7, 7, 7, 40, A.FEW)]
    columns = [tuple(pa.array([r[i] for r in rows], pa.int32()) for i in (0, 1)) for rows in groups]
    wanted = [A.united(pa.table([a.cast(pa.int64()), b.cast(pa.int64())], names=["a", "b"]), []).to_pylist() for a, b in columns]
    monkeypatch.setattr(A, "united", None)
    assert [A._union(a, b) for a, b in columns] == wanted
