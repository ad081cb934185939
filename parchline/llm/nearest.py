"""Nearest features by their vectors of values: a small-world graph per shard, merged over shards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
LINKS = 16
CANDIDATES = 64
BEAM = 128
STEP = 6
BLOCK = 256


class Graph:
    """Hierarchical navigable small world over distinct vectors, as flat neighbour arrays.

    ``layers[l]`` is ``(nodes, neighbours)``: the nodes of the layer and, for each, a row of node numbers padded with -1. A
    node is in layer ``l`` with chance ``links ** -l``. In each layer the nearest ``CANDIDATES`` nodes are found
    block by block; of these a node keeps those that are nearer to it than to a neighbour already
    kept, which leaves links in all directions, and links back where there is room.
    """

    def __init__(self, vectors: np.ndarray, links: int = LINKS, seed: int = 11) -> None:
        self.vectors = vectors
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(links)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for l in range(int(level.max()) + 1):
            nodes = np.flatnonzero(level >= l)
            if l and len(nodes) <= 1:
                break
            self.layers.append((nodes, self.linked(nodes, links * (2 if l == 0 else 1))))
            if len(nodes) <= 4 * links:
                break

    def linked(self, nodes: np.ndarray, most: int) -> np.ndarray:
        n = len(nodes)
        own, squares = self.vectors[nodes], self.squares[nodes]
        wide = min(CANDIDATES, n - 1)
        out = np.full((n, most), -1, np.int32)
        if wide <= 0:
            return out
        for at in range(0, n, 512):
            part = slice(at, min(at + 512, n))
            d = squares[part, None] + squares[None, :] - 2 * own[part] @ own.T
            rows = np.arange(d.shape[0])
            d[rows, rows + at] = np.inf
            near = np.argpartition(d, wide - 1, axis=1)[:, :wide]
            order = np.take_along_axis(d, near, 1).argsort(axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            out[part] = spread(own, near, np.take_along_axis(d, near, 1), most)
        linked_back(out, most)
        return np.where(out >= 0, nodes[out], -1).astype(np.int32)

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """For each query the ``beam`` best nodes found, nearest first, padded with -1; all queries walk in step."""
        nodes = self.layers[-1][0]
        start = self.distances(queries, np.broadcast_to(nodes, (len(queries), len(nodes))))
        found = nodes[start.argsort(axis=1, kind="stable")[:, :8]]
        for nodes, neighbours in reversed(self.layers[:-1]):
            where = np.full(len(self.vectors), -1, np.int64)
            where[nodes] = np.arange(len(nodes))
            found = self.walk(queries, found, where, neighbours, 16 if neighbours is not self.layers[0][1] else beam)
        if len(self.layers) == 1:
            nodes, neighbours = self.layers[0]
            found = self.walk(queries, found, np.arange(len(self.vectors)), neighbours, beam)
        return found

    def distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own square; infinite for -1."""
        d = self.squares[nodes] - 2 * np.einsum("qd,qnd->qn", queries, self.vectors[nodes])
        return np.where(nodes >= 0, d, np.inf)

    def walk(self, queries: np.ndarray, start: np.ndarray, where: np.ndarray, neighbours: np.ndarray, beam: int) -> np.ndarray:
        q = len(queries)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, len(self.vectors) + 1), bool)
        best = np.full((q, beam), -1, np.int64)
        far = np.full((q, beam), np.inf, np.float32)
        done = np.ones((q, beam), bool)
        n = min(beam, start.shape[1])
        best[:, :n], far[:, :n], done[:, :n] = start[:, :n], self.distances(queries, start[:, :n]), start[:, :n] < 0
        seen[rows, start] = True
        active = np.arange(q)
        while len(active):
            open_ = np.where(done[active], np.inf, far[active])
            pick = np.argpartition(open_, min(STEP, beam) - 1, axis=1)[:, :STEP]
            good = np.isfinite(np.take_along_axis(open_, pick, 1))
            some = good.any(axis=1)
            active, pick, good = active[some], pick[some], good[some]
            if not len(active):
                break
            at = np.arange(len(active))[:, None]
            chosen = np.where(good, best[active[:, None], pick], -1)
            done[active[:, None], pick] = True
            fresh = neighbours[where[chosen]]
            fresh = np.where((chosen >= 0)[:, :, None], fresh, -1).reshape(len(active), -1).astype(np.int64)
            fresh[seen[active[:, None], fresh]] = -1
            # One of several equal new nodes is enough.
            fresh.sort(axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            seen[active[:, None], fresh] = True
            d = self.distances(queries[active], fresh)
            every = np.concatenate([far[active], d], axis=1)
            order = every.argsort(axis=1, kind="stable")[:, :beam]
            best[active] = np.concatenate([best[active], fresh], axis=1)[at, order]
            far[active] = every[at, order]
            done[active] = np.concatenate([done[active], fresh < 0], axis=1)[at, order]
        return np.where(np.isfinite(far), best, -1)


def spread(vectors: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, nearest first, those nearer to the node than to any kept one; the nearest others fill up half the places."""
    rows, wide = near.shape
    kept = np.full((rows, most), -1, np.int32)
    count = np.zeros(rows, int)
    taken = np.zeros((rows, wide), bool)
    for c in range(wide):
        candidate = vectors[near[:, c]]
        held = vectors[np.where(kept >= 0, kept, 0)]
        gap = ((held - candidate[:, None, :]) ** 2).sum(axis=2)
        gap[kept < 0] = np.inf
        ok = (gap.min(axis=1) > far[:, c]) & (count < most)
        kept[ok, count[ok]] = near[ok, c]
        count[ok] += 1
        taken[ok, c] = True
    for c in range(wide):
        ok = ~taken[:, c] & (count < most // 2)
        kept[ok, count[ok]] = near[ok, c]
        count[ok] += 1
    return kept


def linked_back(out: np.ndarray, most: int) -> None:
    """Adds the reverse of every link where its row has room."""
    free = (out >= 0).sum(axis=1)
    for a in range(out.shape[0]):
        for b in out[a, : free[a]].tolist():
            if b >= 0 and free[b] < most and a not in out[b, : free[b]]:
                out[b, free[b]] = a
                free[b] += 1


class Shard:
    """The vectors of a shard, one per distinct value with the smallest ids that have it, and their graph."""

    def __init__(self, ids: list, values: list[np.ndarray], keep: int) -> None:
        matrix = np.stack(values)
        distinct, of = np.unique(matrix, axis=0, return_inverse=True)
        self.vectors = distinct
        self.ids: list[list] = [[] for _ in distinct]
        for row in sorted(range(len(ids)), key=lambda r: ids[r]):
            own = self.ids[of.ravel()[row]]
            if len(own) <= keep:
                own.append(ids[row])
        # The graph walks in single precision, around the mean, so large offsets do no harm.
        self.mean = distinct.mean(axis=0)
        self.graph = Graph((distinct - self.mean).astype(np.float32))

    def nearest(self, ids: list, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple]:
        """(query, feature, distance) of the ``k`` nearest of each query, its own id left out."""
        found = self.graph.search((queries - self.mean).astype(np.float32), min(beam, len(self.vectors)))
        for row, query in enumerate(ids):
            nodes = found[row][found[row] >= 0]
            far = np.sqrt(((self.vectors[nodes] - queries[row]) ** 2).sum(axis=1))
            pairs = sorted((d, i) for node, d in zip(nodes.tolist(), far.tolist(), strict=True) for i in self.ids[node] if i != query)
            yield from ((query, i, d) for d, i in pairs[:k])


def usable(values: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return values.isNotNull() & (F.size(values) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(values, lambda v: v != 0)


def nearest_features(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest features of each query feature by Euclidean distance.

    ``vectors`` and ``queries`` hold ``feature_id`` and ``values``, a feature's vector of values, such as the months of its series
    or their embedding; other columns are ignored. Vectors go to shards of about ``shard_rows`` by a hash of their id, so equal vectors
    spread; a task builds the graph of a shard and streams all queries through it, ``BLOCK`` at a time. Each shard returns
    the ``k`` nearest it found, scored in double precision on the original vectors, and the best ``k`` of all shards are kept.

    Returns ``query_id, rank, feature_id, score``, nearest first, ties to the smaller id; a query with fewer candidates
    has fewer rows. A query's own id is never its neighbour. Vectors that are null, zero or empty, or hold a
    null or non-finite component, take no part, nor do rows without id; vectors of different
    lengths are never compared; an empty table gives no rows. ``beam`` trades time for recall.
    """
    def ready(df: DataFrame) -> DataFrame:
        values = F.col("values").cast("array<double>")
        return df.select("feature_id", values.alias("values")).where(F.col("feature_id").isNotNull() & usable(F.col("values")))

    own = ready(vectors)
    shards = max(1, -(-own.count() // shard_rows))
    data = own.select(F.size("values").alias("width"), F.pmod(F.xxhash64("feature_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "feature_id", "values")
    asked = ready(queries).select(
        F.size("values").alias("width"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "feature_id", "values"
    )
    id_type = own.schema["feature_id"].dataType.simpleString()

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, None
        ids: list = []
        values: list[np.ndarray] = []
        waiting: tuple[list, list] = ([], [])
        kind_of_id = None

        def answer() -> Iterator[pa.RecordBatch]:
            if waiting[0] and shard is not None:
                rows = list(shard.nearest(waiting[0], np.stack(waiting[1]), k, beam))
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind_of_id), pa.array(columns[1], kind_of_id), pa.array(columns[2], pa.float64())], ["query_id", "feature_id", "score"])
            waiting[0].clear()
            waiting[1].clear()

        for batch in batches:
            kind_of_id = batch.schema.field("feature_id").type
            flat, ends = batch.column("values").values.to_numpy(zero_copy_only=False), batch.column("values").offsets.to_numpy()
            for row, (width, part, kind, fid) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("width", "shard", "kind", "feature_id")], strict=True)):
                if (width, part) != key:
                    yield from answer()
                    key, shard, ids, values = (width, part), None, [], []
                vector = np.array(flat[ends[row] : ends[row + 1]])
                if kind == 0:
                    ids.append(fid)
                    values.append(vector)
                    continue
                if shard is None and ids:
                    shard = Shard(ids, values, k)
                    ids, values = [], []
                waiting[0].append(fid)
                waiting[1].append(vector)
                if len(waiting[0]) >= BLOCK:
                    yield from answer()
        yield from answer()

    dealt = data.unionByName(asked).repartition("width", "shard").sortWithinPartitions("width", "shard", "kind")
    found = dealt.mapInArrow(searched, f"query_id {id_type}, feature_id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "feature_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "feature_id", "score")
