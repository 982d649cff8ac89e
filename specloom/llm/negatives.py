"""Hard negatives: rows of another label that score close under a positive of the same label.

Anchors of one block are joined by a spanning tree of shortest edges. A candidate's score at an
anchor lies within its score at the parent anchor, plus or minus the edge's length times the
candidate's norm, so bounds run down the tree from the root, where every candidate is scored. Only
candidates whose bounds reach into the window asked for are scored again, exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, staged

#: Products and sums of whole numbers below this are exact in double precision.
EXACT = float(1 << 52)


@dataclass
class Tree:
    """Anchors from the root on, each after its parent, with the length of the edge between them."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    #: by anchor: (positive id, positive score) in rank order
    positives: list[list[tuple[int, int]]] = field(default_factory=list)


def spanning_tree(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    """The shortest tree over the anchors, grown from the one next to their mean, point by point."""
    n, norms = len(ids), (vectors**2).sum(1)
    start = int(np.argmin(((vectors - vectors.mean(0)) ** 2).sum(1)))
    near, via, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    order, parent, edge = [], [], []
    now, place = start, np.empty(n, np.int64)
    while True:
        place[now] = len(order)
        order.append(now)
        parent.append(place[via[now]] if via[now] >= 0 else -1)
        edge.append(np.sqrt(((vectors[now] - vectors[via[now]]) ** 2).sum()) if via[now] >= 0 else 0.0)
        left[now] = False
        if not left.any():
            break
        away = norms + norms[now] - 2 * (vectors @ vectors[now])
        closer = left & (away < near)
        near[closer], via[closer] = away[closer], now
        now = int(np.argmin(np.where(left, near, np.inf)))
    at = np.array(order)
    return Tree(ids[at], labels[at], vectors[at], np.array(parent), np.array(edge))


class Best:
    """The k best (score, id) of what was offered, an id once with its best score."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0), np.empty(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k and len(np.unique(ids)) == len(ids):
            some = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[some], ids[some]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)][: self.k]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def floor(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf


def candidates(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids, labels = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            flat = part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
            yield ids, labels, flat.reshape(len(ids), -1).astype(float)


def descend(tree: Tree, x: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor from the root on: its place, the candidates scored there and their exact scores.

    ``wanted(i, low, high)`` says which candidates' bounds reach a window of anchor i. At the root all
    are scored. A step of slack covers what rounding does to edges and norms; scores are whole numbers.
    """
    norms = np.sqrt((x**2).sum(1))
    low, high = np.empty((len(tree.ids), len(x))), np.empty((len(tree.ids), len(x)))
    for i, p in enumerate(tree.parent.tolist()):
        if p < 0:
            at = np.arange(len(x))
        else:
            reach = tree.edge[i] * norms * (1 + 1e-9) + 1
            np.subtract(low[p], reach, out=low[i])
            np.add(high[p], reach, out=high[i])
            at = np.flatnonzero(wanted(i, low[i], high[i]))
        scores = x @ tree.vectors[i] if len(at) == len(x) else x[at] @ tree.vectors[i]
        low[i, at] = high[i, at] = scores
        yield i, at, scores


POSITIVE = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def same_label(tree: Tree, k: int, rows: int, scored=None):
    """A task's k best rows of each anchor's label; the window is all above the k-th best so far."""

    def run(batches):
        best = [Best(k) for _ in tree.ids]
        for ids, labels, x in candidates(batches, rows):
            fits = lambda i: (labels == tree.labels[i]) & (ids != tree.ids[i])  # noqa: B023, E731
            for i, at, scores in descend(tree, x, lambda i, low, high: fits(i) & (high >= best[i].floor)):
                if scored is not None:
                    scored.append(len(at))
                if tree.parent[i] < 0:
                    some = fits(i)
                    at, scores = at[some], scores[some]
                some = scores >= best[i].floor
                if some.any():
                    best[i].offer(scores[some], ids[at[some]])
        out = Rows(POSITIVE)
        for i, b in enumerate(best):
            for s, j in zip(b.scores.tolist(), b.ids.tolist(), strict=True):
                yield from out.add(int(tree.ids[i]), j, int(s))
        yield from out.flush()

    return run


def in_windows(tree: Tree, k: int, rows: int, percent: tuple[int, int], scored=None):
    """A task's k best rows of other labels in each positive's window.

    A window runs from ``percent[0]`` to ``percent[1]`` hundredths of the positive's score; what is
    worse than the k-th best found in it falls out of it.
    """
    least, most = percent

    def run(batches):
        best = [[Best(k) for _ in found] for found in tree.positives]
        windows = [[(-(-least * s // 100), most * s // 100) for _, s in found] for found in tree.positives]

        def reached(i, low, high):
            hit, at = np.zeros(len(low), bool), None
            spans = sorted((max(a, best[i][j].floor), b) for j, (a, b) in enumerate(windows[i]))
            for a, b in spans:  # windows that overlap are tried as one
                if a > b:
                    continue
                if at is not None and a <= at[1]:
                    at[1] = max(at[1], b)
                    continue
                if at is not None:
                    hit |= (high >= at[0]) & (low <= at[1])
                at = [a, b]
            return hit if at is None else hit | (high >= at[0]) & (low <= at[1])

        for ids, labels, x in candidates(batches, rows):
            other = lambda i: (labels != tree.labels[i]) & (ids != tree.ids[i])  # noqa: B023, E731
            for i, at, scores in descend(tree, x, lambda i, low, high: other(i) & reached(i, low, high)):
                if scored is not None:
                    scored.append(len(at))
                if tree.parent[i] < 0:
                    some = other(i)
                    at, scores = at[some], scores[some]
                for held, (a, b) in zip(best[i], windows[i], strict=True):
                    some = (scores >= max(a, held.floor)) & (scores <= b)
                    if some.any():
                        held.offer(scores[some], ids[at[some]])
        out = Rows(NEGATIVE)
        for i, found in enumerate(best):
            for (p, s), held in zip(tree.positives[i], found, strict=True):
                for score, j in zip(held.scores.tolist(), held.ids.tolist(), strict=True):
                    yield from out.add(int(tree.ids[i]), p, s, j, int(score))
        yield from out.flush()

    return run


def usable(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, label, v (whole numbers) of rows whose id and label are there and all components finite."""
    v = F.col(vector_col).cast("array<double>")
    there = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & there)
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def blocks(anchors: DataFrame, most: int) -> Iterator[tuple[int, list]]:
    """Anchors of one length, at most so many at a time, those on the same side of many lines together.

    They stream through the driver partition by partition; no more than a block is ever held.
    """
    bits = 16

    def coded(batches):
        for batch in batches:
            codes = []
            for v in batch.column(batch.schema.get_field_index("v")).to_pylist():
                lines = np.random.default_rng(len(v)).standard_normal((bits, len(v)))
                codes.append(int(((lines @ np.array(v, float)) > 0) @ (1 << np.arange(bits))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], names=[*batch.schema.names, "code"])

    held: list = []
    for r in anchors.mapInArrow(coded, "vec_id long, label long, v array<double>, code long").orderBy(F.size("v"), "code", "vec_id").toLocalIterator():
        if held and (len(held) == most or len(held[0]["v"]) != len(r["v"])):
            yield len(held[0]["v"]), held
            held = []
        held.append(r)
    if held:
        yield len(held[0]["v"]), held


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100), scale: int = 256, block: int = 1024, batch_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``. Scores are inner products of components times
    ``scale``, rounded down. An anchor's positives are its best ``positives`` rows of its label; for
    each, its best ``negatives`` rows of other labels within ``percent`` of the positive's score are
    ranked, ties to smaller ids. Without any in the window a positive has no row.

    Rows with a null id, label or vector or a null or non-finite component take no part, zero vectors
    do; only vectors of one length meet. A row never meets its own id. Rows that share an id are met
    as the best-scored of them, and are one anchor, that of the least label and vector. An empty table
    gives no row; other columns are not read. All scores are exact: vectors so long that they would
    not be in double precision are refused.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors, F.col("label") if label is None else label, scale, id_col, vector_col), "whole-vectors")
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if longest is not None and not longest < EXACT:
        raise ValueError(f"squared norms up to {longest} at scale {scale}: scores would not be exact")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    parts = []
    for dims, held in blocks(anchors, block):
        tree = spanning_tree(np.array([r["vec_id"] for r in held]), np.array([r["label"] for r in held]), np.array([r["v"] for r in held], float).reshape(len(held), dims))
        met = rows.where(F.size("v") == dims)
        first = met.mapInArrow(same_label(tree, positives, batch_rows), "anchor_id long, vec_id long, score long").groupBy("anchor_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
        found: dict[int, list[tuple[int, int]]] = {}
        for r in first.withColumn("rank", rank).where(F.col("rank") <= positives).orderBy("anchor_id", "rank").collect():  # a block's positives at most
            found.setdefault(r["anchor_id"], []).append((r["vec_id"], r["score"]))
        tree.positives = [found.get(i, []) for i in tree.ids.tolist()]
        second = met.mapInArrow(in_windows(tree, negatives, batch_rows, percent), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        parts.append(staged(second, "negatives"))
    if not parts:
        return spark.createDataFrame([], RESULT)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    once = every.groupBy("anchor_id", "positive_id", "positive_score", "negative_id").agg(F.max("negative_score").alias("negative_score"))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
met AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM met WHERE same),
found AS (SELECT p.anchor_id, p.positive_id, m.vec_id AS negative_id, p.positive_score, m.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY m.score DESC, m.vec_id)::INTEGER AS rank
    FROM near p JOIN met m ON m.anchor_id = p.anchor_id AND NOT m.same AND p.n <= 5
    AND 80 * p.positive_score <= 100 * m.score AND 100 * m.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""
