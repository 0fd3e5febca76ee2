"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt by hash to shards of bounded size. In each shard a graph is grown: points are added in
batches, a beam search from the medoid over the graph so far proposes neighbours, and pruning
with relaxed distances keeps an edge only if no kept neighbour is clearly nearer to its end; edges back are pruned likewise. Crowds
of nearly equal points enter the graph by one leader, and a search measures all points of the leaders it finds. A query runs a beam search in every shard, and the shards' bests are merged. Queries come in blocks,
so a task holds one shard and one block.

Exactly equal vectors are one point that carries the k + 1 smallest ids, which is all that a top-k can
show of them, the query's own row left out. Vectors that are null, zero, or hold null or non-finite components, and rows without id,
take no part. Vectors of different length are never compared. A repeated id is a row for each vector it has,
and its results are merged. With fewer candidates than k all come back; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushmark.llm.common import cut

K = 10
SHARD = 4096
QUERIES_A_BLOCK = 2048
DEGREE, BEAM, RELAXED, WIDTH = 24, 64, 1.2, 4
BATCH = 512


def _squares(x: np.ndarray, norms: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its rows ``at`` of x; -1 is nowhere."""
    found = norms[at] + (q * q).sum(1)[:, None] - 2 * np.einsum("qcd,qd->qc", x[at], q)
    return np.where(at < 0, np.inf, np.maximum(found, 0))


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int = BEAM, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of the beam of each query, nearest first; -1 and inf where there are fewer."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int64)
    ids[:, 0] = entry
    far = np.full((n, beam), np.inf)
    far[:, :1] = _squares(x, norms, q, ids[:, :1])
    done = np.zeros((n, beam), bool)
    live = np.arange(n)
    while len(live):
        at, d, seen = ids[live], far[live], done[live]
        waits = ~seen & (at >= 0)
        turn = waits & (np.cumsum(waits, axis=1) <= width)
        rows, places = np.nonzero(turn)
        slot = np.cumsum(turn, axis=1)[rows, places] - 1
        near = np.full((len(live), width, graph.shape[1]), -1, np.int64)
        near[rows, slot] = graph[at[rows, places]]
        near = near.reshape(len(live), -1)
        every = np.concatenate([at, near], axis=1)
        reach = np.concatenate([d, _squares(x, norms, q[live], near)], axis=1)
        flags = np.concatenate([seen | turn, np.zeros_like(near, bool)], axis=1)
        # The same node twice: keep the place that comes first, which is the beam's own.
        order = np.argsort(every, axis=1, kind="stable")
        same = np.take_along_axis(every, order, 1)
        twice = np.zeros_like(flags)
        np.put_along_axis(twice, order[:, 1:], same[:, 1:] == same[:, :-1], 1)
        reach[twice] = np.inf
        every[twice] = -1
        best = np.argsort(reach, axis=1, kind="stable")[:, :beam]
        ids[live], far[live], done[live] = (np.take_along_axis(v, best, 1) for v in (every, reach, flags))
        ids[live] = np.where(np.isinf(far[live]), -1, ids[live])
        live = live[(~done[live] & (ids[live] >= 0)).any(1)]
    return ids, far


def prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, relaxed: float = RELAXED) -> np.ndarray:
    """For each point, at most ``degree`` diverse ones of its candidates (-1 is none)."""
    out = np.full((len(own), degree), -1, np.int64)
    ordered = np.sort(candidates, axis=1)
    candidates = np.where(np.concatenate([np.zeros((len(own), 1), bool), ordered[:, 1:] == ordered[:, :-1]], axis=1) | (ordered == own[:, None]), -1, ordered)
    points = x[candidates]
    norms = (points * points).sum(2)
    to_own = np.where(candidates < 0, np.inf, ((points - x[own][:, None]) ** 2).sum(2))
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    row = np.arange(len(own))
    left = to_own.copy()
    for k in range(degree):
        best = left.argmin(1)
        some = np.isfinite(left[row, best])
        if not some.any():
            break
        out[some, k] = candidates[row, best][some]
        covered = relaxed * relaxed * between[row, best] <= to_own
        left[some[:, None] & covered] = np.inf
        left[row, best] = np.inf
    return out


def grow(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """The graph (a row of neighbours for each point) and where searches start."""
    n = len(x)
    norms = (x * x).sum(1)
    graph = np.full((n, degree), -1, np.int64)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = order[order != entry]
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        at, size = at + len(new), min(2 * size, BATCH)
        proposed, _ = beam_search(x, norms, graph, entry, x[new], beam)
        graph[new] = prune(x, new, proposed, degree)
        # Edges back, grouped by where they start.
        source, target = np.repeat(new, degree), graph[new].ravel()
        kept = target >= 0
        source, target = source[kept], target[kept]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, many)
        for lo in range(0, len(nodes), BATCH):
            hi = min(lo + BATCH, len(nodes))
            part = slice(first[lo], first[hi - 1] + many[hi - 1])
            back = np.full((hi - lo, int(many[lo:hi].max())), -1, np.int64)
            back[np.searchsorted(nodes[lo:hi], target[part]), place[part]] = source[part]
            whole = np.concatenate([graph[nodes[lo:hi]], back], axis=1)
            if whole.shape[1] > 4 * degree:  # pruning goes from near to far: the nearest decide
                reach = _squares(x, norms, x[nodes[lo:hi]], whole)
                whole = np.take_along_axis(whole, np.argsort(reach, axis=1, kind="stable")[:, : 4 * degree], 1)
            graph[nodes[lo:hi]] = prune(x, nodes[lo:hi], whole, degree)
    return graph, entry


def lead(x: np.ndarray, samples: int = 256, share: float = 0.9, part: float = 0.5) -> np.ndarray:
    """The leader (a point's number) of each point, itself or one within a radius of it.

    Dense crowds of nearly equal points would fill every beam; their leader stands for them in the graph, and
    a search measures all points of the leaders it finds. The radius is half of the distance to the nearest
    other point that nine of ten points (of a fixed draw) stay within.
    """
    n = len(x)
    norms = (x * x).sum(1)
    drawn = np.random.default_rng(n).permutation(n)
    some = drawn[:samples]
    away = norms[some, None] + norms - 2 * x[some] @ x.T
    away[np.arange(len(some)), some] = np.inf
    near = np.sqrt(np.maximum(away.min(1), 0)) if n > 1 else np.zeros(1)
    radius = (part * float(np.quantile(near[np.isfinite(near)], share))) ** 2 if n > 1 else 0.0
    leader = np.full(n, -1, np.int64)
    for k in drawn:
        if leader[k] < 0:
            free = np.flatnonzero(leader < 0)
            leader[free[((x[free] - x[k]) ** 2).sum(1) <= radius]] = k
            leader[k] = k
    return leader


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & whole & F.exists(vector, lambda v: v != 0)


def _take(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def index(points: DataFrame, k: int, shard: int) -> DataFrame:
    """A row a shard: dim, shard, vectors, graph and entry of its points, and the points' ids."""
    by_vector = Window.partitionBy("vector").orderBy("id")
    few = points.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)  # limited before the shuffle, too
    distinct = cut(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("vector")))
    sizes = distinct.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    dealt = distinct.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")))

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = _take(group.column("vector").combine_chunks())
        leader = lead(x)
        leaders = np.unique(leader)
        graph, entry = grow(x[leaders])
        of = np.searchsorted(leaders, leader)
        return pa.table({
            "dim": group.column("dim")[:1], "shard": group.column("shard")[:1], "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()), "graph": pa.array([graph.astype("<i4").tobytes()], pa.binary()),
            "entry": pa.array([entry], pa.int32()), "leaders": pa.array([leaders.astype("<i4").tobytes()], pa.binary()), "leader_of": pa.array([of.astype("<i4").tobytes()], pa.binary()),
            "ids": pa.array([group.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
        })

    # A number of partitions that is given stays: small shards are not put into one task by their bytes.
    many = 2 * (sizes.agg(F.sum("shards")).first()[0] or 1)
    return dealt.select("dim", "shard", "vector", "ids").repartition(many, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard long, vectors binary, graph binary, entry int, leaders binary, leader_of binary, ids array<array<bigint>>")


def search(indexed: DataFrame, queries: DataFrame, k: int, a_block: int) -> DataFrame:
    """query_id, vec_id, score: the k best of every shard for every query."""
    blocks = queries.groupBy(F.size("vector").alias("dim")).agg(F.ceil(F.count("*") / a_block).cast("long").alias("blocks"))
    keyed = queries.withColumn("dim", F.size("vector")).join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")))
    packed = keyed.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    shards = indexed.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    spread = packed.join(shards, "dim").withColumn("shard", F.explode("shards")).drop("shards")
    pairs = spread.join(indexed, ["dim", "shard"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                x = np.frombuffer(batch.column("vectors")[r].as_py(), "<f8").reshape(-1, dim)
                graph = np.frombuffer(batch.column("graph")[r].as_py(), "<i4").reshape(-1, DEGREE).astype(np.int64)
                asked = batch.column("queries")[r].values
                q, own = _take(asked.field("vector")), asked.field("id").to_numpy()
                ids = batch.column("ids")[r].as_py()
                leaders, of = (np.frombuffer(batch.column(c)[r].as_py(), "<i4").astype(np.int64) for c in ("leaders", "leader_of"))
                order = np.argsort(of, kind="stable")
                first = np.searchsorted(of[order], np.arange(len(leaders) + 1))
                top = x[leaders]
                nodes, _ = beam_search(top, (top * top).sum(1), graph, batch.column("entry")[r].as_py(), q)
                out = []
                for a in range(len(q)):
                    points = np.concatenate([order[first[node] : first[node + 1]] for node in nodes[a] if node >= 0])
                    exact = np.sqrt(((x[points] - q[a]) ** 2).sum(1))
                    # Each point has an id, so k + 1 points and those as near as the last hold the k best besides the query.
                    limit = np.partition(exact, k)[k] if len(exact) > k else np.inf
                    best = np.flatnonzero(exact <= limit)
                    found = sorted((float(exact[p]), i) for p in best for i in ids[points[p]] if i != own[a])
                    out += [(int(own[a]), i, s) for s, i in found[:k]]
                columns = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(ask, "query_id long, vec_id long, score double")


def neighbours(vectors: DataFrame, queries: Column, id_: str = "vec_id", vector: str = "embedding", k: int = K, shard: int = SHARD, a_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``queries`` holds for, against all rows."""
    rows = vectors.where(F.col(id_).isNotNull() & usable(F.col(vector)))
    points = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector")).distinct()
    asked = rows.where(queries).select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector")).distinct()
    found = search(cut(index(points, k, shard)), asked, k, a_block).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
