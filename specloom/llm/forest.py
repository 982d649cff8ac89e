"""Nearest neighbours by inner product through a forest of random-projection trees.

Each node of a tree splits its part of a bounded sample at the median along the line between two
of its points. All vectors are dealt to one leaf a tree. A query walks all trees through one
priority queue, nearest boundary first, and visits a share of all leaves; candidates are scored
exactly, leaf by leaf, where leaf and queries meet, and nothing else enters the result. The best of
the sample's rows in a query's own leaves give it a floor, so a leaf hands on only what can still
count.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows


@dataclass
class Forest:
    """Complete trees of one depth: hyperplanes (trees, nodes, dims), thresholds, and the sample."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int
    sample_ids: np.ndarray
    sample: np.ndarray

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree, numbered through the forest."""
        out = np.empty((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.planes[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = t * self.leaves + node - (self.leaves - 1)
        return out

    def visit(self, q: np.ndarray, share: float, sizes: np.ndarray, enough: int) -> list[int]:
        """Leaves for a query, nearest first: all trees share one queue of turned-down branches.

        A share of all leaves, and on until one tree alone has shown ``enough`` rows (``sizes`` by leaf).
        """
        trees, inner = len(self.planes), self.leaves - 1
        want = max(trees, int(np.ceil(share * trees * self.leaves)))
        gaps = (self.planes @ q - self.cuts).tolist() if inner else []
        queue, found, seen = [(0.0, t, 0) for t in range(trees)], [], [0] * trees
        while queue and (len(found) < want or max(seen) < enough):
            far, t, node = heapq.heappop(queue)
            while node < inner:
                gap = gaps[t][node]
                near = 2 * node + 1 + (gap > 0)
                heapq.heappush(queue, (max(far, abs(gap)), t, 4 * node + 3 - near))
                node = near
            found.append(t * self.leaves + node - inner)
            seen[t] += int(sizes[found[-1]])
        return found


def grow(ids: np.ndarray, sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
    rng, nodes, dims = np.random.default_rng(seed), (1 << depth) - 1, sample.shape[1]
    planes, cuts = np.zeros((trees, nodes, dims)), np.zeros((trees, nodes))
    for t in range(trees):
        parts = [np.arange(len(sample))]
        for node in range(nodes):
            mine = parts[node]
            line = np.zeros(dims)
            if len(mine) > 1:
                a, b = rng.choice(mine, 2, replace=False)
                line = sample[a] - sample[b]
            if not line.any():
                line = rng.standard_normal(dims)
            planes[t, node] = line / np.linalg.norm(line)
            side = sample[mine] @ planes[t, node]
            cuts[t, node] = np.median(side) if len(mine) else 0.0
            parts += [mine[side <= cuts[t, node]], mine[side > cuts[t, node]]]
    return Forest(planes, cuts, depth, ids, sample)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles) of rows that take part: id and all entries there and finite, not all
    zero, and of the commonest length (the longest of equally common ones)."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    )
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return rows.where(F.size("v") == (sizes["dims"] if sizes else 0))


def fit(rows: DataFrame, trees: int, leaf_rows: int, sample_rows: int) -> Forest | None:
    """A forest over at most ``sample_rows`` vectors, taken by hash of the id. Leaves hold about
    ``leaf_rows`` vectors while eight of the sample fall on each."""
    n = rows.count()
    if not n:
        return None
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
    depth = min(depth, int(np.log2(max(1, len(some) / 8))))
    return grow(np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some], float), trees, depth)


def batch_vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 1)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed the same way for the same entries, wherever a vector stands."""
    return (np.ascontiguousarray(x) * q).sum(1)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, trees: int = 8, leaf_rows: int = 512, sample_rows: int = 20_000, share: float = 0.14, chunk_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each query, best first, ties to smaller ids.

    A row never finds itself (its id); repeated vectors are all there, but of rows with the very
    same vector only the ``k + 1`` smallest ids are indexed, as no further one can be among ``k``.
    Rows that don't take part (see ``usable``) give and get nothing; fewer candidates than ``k``
    give fewer rows; otherwise a query goes on to further leaves until it must have met ``k`` others.
    Leaves beyond ``chunk_rows`` are searched in chunks.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    result = "query_id long, rank int, vec_id long, score double"
    copies = Window.partitionBy("v").orderBy("vec_id")
    indexed = rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n")
    model = fit(indexed, trees, leaf_rows, sample_rows)
    if model is None:
        return spark.createDataFrame([], result)
    dims = model.sample.shape[1]

    def leaves_only(batches):
        for batch in batches:
            ids, x = batch_vectors(batch)
            if len(ids):
                leaf, n = np.unique(model.route(x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], names=["leaf", "n"])

    sizes = indexed.mapInArrow(leaves_only, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    held = np.zeros(trees * model.leaves, np.int64)
    for r in sizes.collect():  # trees x leaves rows at most
        held[r["leaf"]] = r["n"]
    chunks = (-(-held // chunk_rows)).tolist()
    in_leaf = [[] for _ in held]  # places of the sample
    for place, found_in in enumerate(model.route(model.sample).tolist()):
        for leaf in found_in:
            in_leaf[leaf].append(place)
    cell_rows = pa.schema([("leaf", pa.int64()), ("chunk", pa.int32()), ("asks", pa.bool_()), ("vec_id", pa.int64()), ("floor", pa.float64()), ("v", pa.list_(pa.float64()))])
    cell = "leaf long, chunk int, asks boolean, vec_id long, floor double, v array<double>"

    def deal(batches):
        out = Rows(cell_rows)
        for batch in batches:
            ids, x = batch_vectors(batch)
            for i, v, found in zip(ids.tolist(), x, model.route(x).tolist() if len(ids) else (), strict=True):
                for leaf in found:
                    yield from out.add(leaf, i * 2654435761 % (1 << 32) % chunks[leaf], False, i, 0.0, v, weight=8 * dims)
        yield from out.flush()

    def best(scores: np.ndarray, n: int) -> np.ndarray:
        """Places of the n largest and of all that rounding might put among them."""
        if len(scores) <= n:
            return np.arange(len(scores))
        return np.flatnonzero(scores >= np.partition(scores, -n)[-n] - 1e-9 * (1 + np.abs(scores).max()))

    def ask(batches):
        out = Rows(cell_rows)
        for batch in batches:
            ids, x = batch_vectors(batch)
            for i, q in zip(ids.tolist(), x, strict=True):
                leaves = model.visit(q, share, held, k + 1)
                near = np.unique(np.concatenate([np.array(in_leaf[leaf], np.int64) for leaf in leaves]))
                near = near[model.sample_ids[near] != i]
                scores = model.sample[near] @ q
                floor = np.partition(scores, -k)[-k] - 1e-9 * (1 + np.abs(scores).max()) if len(scores) >= k else -np.inf
                for leaf in leaves:
                    for chunk in range(chunks[leaf]):
                        yield from out.add(leaf, chunk, True, i, float(floor), q, weight=8 * dims)
        yield from out.flush()

    found_rows = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    found = "query_id long, vec_id long, score double"

    def meet(batches):
        out, now, ids, rows_here, x = Rows(found_rows), None, [], [], None
        for batch in batches:
            leaf, chunk, asks, floors = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leaf", "chunk", "asks", "floor"))
            vec_ids, v = batch_vectors(batch)
            for j in range(batch.num_rows):
                if (leaf[j], chunk[j]) != now:
                    now, ids, rows_here, x = (leaf[j], chunk[j]), [], [], None
                if not asks[j]:
                    ids.append(vec_ids[j])
                    rows_here.append(v[j])
                    continue
                if not rows_here:
                    continue
                if x is None:
                    x, of = np.array(rows_here), np.array(ids)
                scores = x @ v[j]
                scores[(of == vec_ids[j]) | (scores < floors[j])] = -np.inf
                some = best(scores, k)
                some = some[np.isfinite(scores[some])]
                for i, s in zip(of[some].tolist(), exact(x[some], v[j]).tolist(), strict=True):
                    yield from out.add(int(vec_ids[j]), i, s)
        yield from out.flush()

    queries = rows.where(is_query)
    cells = indexed.mapInArrow(deal, cell).unionByName(queries.mapInArrow(ask, cell))
    met = cells.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "asks").mapInArrow(meet, found)
    every = met.dropDuplicates(["query_id", "vec_id"])
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
