"""Small exact solvers for groups that Spark has already cut down to what is entangled."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa


def most_pairs(edges: list[tuple[int, int]], have: list[int], room: list[int]) -> int:
    """Most pairs that can be made along ``edges`` (left, right) if left ``l`` occurs ``have[l]`` times and right ``r`` ``room[r]`` times.

    A maximum flow by shortest paths, phase by phase; equal members are one node with a number, so copies cost nothing.
    """
    first, last = len(have) + len(room), len(have) + len(room) + 1
    ways: list[list[int]] = [[] for _ in range(last + 1)]
    to: list[int] = []
    free: list[int] = []

    def way(a: int, b: int, n: int) -> None:
        for start, end, room_left in ((a, b, n), (b, a, 0)):
            ways[start].append(len(to))
            to.append(end)
            free.append(room_left)

    for l, n in enumerate(have):
        way(first, l, n)
    for r, n in enumerate(room):
        way(len(have) + r, last, n)
    for l, r in edges:
        way(l, len(have) + r, min(have[l], room[r]))
    total = 0
    while True:
        level = [-1] * (last + 1)
        level[first] = 0
        queue = deque([first])
        while queue:
            node = queue.popleft()
            for e in ways[node]:
                if free[e] and level[to[e]] < 0:
                    level[to[e]] = level[node] + 1
                    queue.append(to[e])
        if level[last] < 0:
            return total
        at = [0] * (last + 1)  # the first way of each node that is not used up in this phase
        path: list[int] = []
        while True:
            node = to[path[-1]] if path else first
            if node == last:
                n = min(free[e] for e in path)
                for e in path:
                    free[e] -= n
                    free[e ^ 1] += n
                total += n
                path = []
                continue
            while at[node] < len(ways[node]):
                e = ways[node][at[node]]
                if free[e] and level[to[e]] == level[node] + 1:
                    path.append(e)
                    break
                at[node] += 1
            else:
                if not path:
                    break
                at[to[path.pop() ^ 1]] += 1


class Taken:
    """Spans that come one after the other; one that meets none of those taken before is taken itself.

    The taken ones are disjoint and kept in order, so a place is found by binary search, and a span that meets two of them lies in neither.
    """

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> tuple[str, int | None, int | None]:
        """('new' or 'in', the taken span) or ('open', None, None)."""
        at, beyond = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if at >= beyond:
            self.starts.insert(at, start)
            self.ends.insert(at, end)
            return "new", start, end
        if beyond - at == 1 and self.starts[at] <= start and end <= self.ends[at]:
            return "in", self.starts[at], self.ends[at]
        return "open", None, None


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of batches that are sorted by their keys, key by key; nothing but the current batch is held."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, lambda row: tuple(row[k] for k in keys))
