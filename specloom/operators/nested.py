"""Nested grouped cross-validation of binary discriminants, for many runs in one plan.

A run is one label set under one deal of the groups to folds.  All runs share one
cross-product matrix per group over all features and all label sets.  A representation is
a choice of feature ranges, so its matrix is part of the shared one, and a training set is
a sum over its groups; the rows are read once to fit and twice to score.  Models number
runs x outer folds x (inner folds + 1) x representations x component counts whatever the
number of rows, and ride along with the scoring tasks.

Inner scores, of which a row has one for every model that did not see its group, never become rows:
tasks write them as packed runs by problem and range, and each range is ranked by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pls import pls_path
from ..session import settle, written
from . import metrics as M
from .folds import seeded_key
from .ordered import position

#: Coefficients that may ride along with the scoring tasks.
MOST_NUMBERS = 64_000_000
#: Scores a range of one problem should hold; a range with over four times as many is ranked row by row.
RANGE_ROWS = 65_536
#: Bytes of scores a task holds before it hands them on.
HELD_BYTES = 16 << 20


def latin_deals(groups: DataFrame, keys: Sequence[str], stratum: str, group: str, n: int, seed: Column, name: str) -> DataFrame:
    """Latin-square folds of a group table (keys, group, stratum, rate), separately per ``keys``.

    ``seed`` is an expression of the keys; with one key value the deal is that of
    ``latin_square_folds`` under the same seed.
    """
    ranked = position(groups.withColumn("__key", seeded_key(group, seed)), [*keys, stratum], "rate", "__key", "__pos")
    strata = groups.select(*keys, stratum).distinct().withColumn("__skey", seeded_key(stratum, seed))
    offsets = position(strata, list(keys), "__skey", "__skey", "__off").select(*keys, stratum, "__off")
    dealt = ((F.col("__pos") + F.col("__off")) % n).cast("int").alias(name)
    return ranked.join(offsets, [*keys, stratum]).select(*keys, group, dealt)


def repeated_folds(rows: DataFrame, group: str, stratum: str, label: str, n: int, repeats: int, seed: int) -> DataFrame:
    """(repeat, group, fold): repeat r deals the groups as ``latin_square_folds`` does under ``seed + r``."""
    groups = rows.groupBy(group).agg(F.min(stratum).alias(stratum), F.avg(F.col(label).cast("double")).alias("rate"))
    every = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    return latin_deals(every, ["repeat"], stratum, group, n, F.col("repeat") + F.lit(seed), "fold")


def shared_grams(rows: DataFrame, group: str, x: str, y: str, p: int, k: int) -> DataFrame:
    """Z'Z per group for Z = [x, y, 1], one row per matrix row: (group, i, v).

    Tasks sum their own rows; the partial rows of one (group, i) are added up as they
    stream by.  ``group`` must be a bounded set such as dishes.
    """
    size, kind = p + k + 1, rows.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            field = batch.schema.field(0)
            z = np.column_stack([_matrix(batch.column(1), n), _matrix(batch.column(2), n), np.ones(n)])
            keys = np.array(batch.column(0).to_pylist())
            for g in set(keys.tolist()):
                part = z[keys == g]
                sums[g] = sums.get(g, 0.0) + part.T @ part
        for g, m in sums.items():
            yield _batch(field, [g] * size, range(size), list(m))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            field, v = batch.schema.field(0), _matrix(batch.column(2), batch.num_rows)
            for place, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != now:
                    if now is not None:
                        yield _batch(field, [now[0]], [now[1]], [held])
                    now, held = key, np.zeros(size)
                held += v[place]
        if now is not None:
            yield _batch(field, [now[0]], [now[1]], [held])

    numbers = lambda c: F.col(c).cast("array<double>")
    schema = f"`{group}` {kind}, i int, v array<double>"
    parts = rows.select(group, numbers(x).alias("x"), numbers(y).alias("y")).where(F.col(group).isNotNull()).mapInArrow(partial, schema)
    return parts.repartition(group, "i").sortWithinPartitions(group, "i").mapInArrow(total, schema)


def _batch(field: pa.Field, keys, places, vectors) -> pa.RecordBatch:
    columns = [pa.array(keys, field.type), pa.array(places, pa.int32()), pa.array(vectors, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=[field.name, "i", "v"])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


@dataclass
class Fits:
    """Models by (run, outer, inner, representation): component counts, weights (p x counts), intercepts.

    ``about`` has, by (run, outer, representation) and count, the mean and the deviation of the refit's scores
    on its training rows, and their number.
    """

    slices: list[np.ndarray]
    found: dict[tuple[int, int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    about: dict[tuple[int, int, int], dict[int, tuple[float, float, float]]] = field(default_factory=dict)

    def only(self, wanted: dict[tuple[int, int], tuple[int, int]]) -> Fits:
        """The chosen model of every (run, outer): the count asked for, or the longest path below it."""
        out = {}
        for (run, outer, inner, rep), (counts, w, b) in self.found.items():
            if wanted.get((run, outer), (None,))[0] == rep:
                k = np.flatnonzero(counts <= wanted[run, outer][1])[-1:]
                out[run, outer, inner, rep] = counts[k], w[:, k], b[k]
        return Fits(self.slices, out)


def fit_all(
    grams: DataFrame, members: DataFrame, group: str, p: int, k: int, runs: Sequence[tuple[int, int]], slices: list[np.ndarray],
    n_outer: int, n_inner: int, grid: Sequence[int],
) -> Fits:
    """PLS paths of all training sets of all runs; ``members`` is (run, group, cells), the group's
    (outer, held) pairs.

    A task holds one run's sums by (outer, held), whatever the number of groups; inner fold i
    trains on all but held = i, the refit (inner -1) on all.  Count 0 is the label's mean alone.
    """
    size, parts = p + 2, [int(s) for _, s in runs]
    i, at, v = F.col("i"), F.get(F.array(*[F.lit(s) for s in parts]), F.col("run")) + p, F.col("v")
    pair = F.array(F.get(v, at), F.get(v, F.lit(p + k)))
    half = (
        F.when(i < p, F.concat(F.slice(v, i + 1, F.lit(p) - i), pair))
        .when(i == at, pair)
        .when(i == p + k, F.array(F.get(v, F.lit(p + k))))
    )
    row = F.when(i < p, i).when(i == at, p).otherwise(p + 1)
    sent = grams.join(members, group).select("run", row.alias("k"), half.alias("half"), "cells").where("half IS NOT NULL")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells = None, {}
        for batch in batches:
            rows, half = batch.column(1).to_pylist(), batch.column(2)
            numbers, ends = half.values.to_numpy(zero_copy_only=False), half.offsets.to_numpy()
            for b, run in enumerate(batch.column(0).to_pylist()):
                if run != now:
                    yield from solve(now, cells)
                    now, cells = run, {}
                for cell in batch.column(3)[b].as_py():
                    key = cell["outer"], cell["held"]
                    if key not in cells:
                        cells[key] = np.zeros((size, size))
                    cells[key][rows[b], rows[b] :] += numbers[ends[b] : ends[b + 1]]
        yield from solve(now, cells)

    def solve(run, cells: dict) -> Iterator[pa.RecordBatch]:
        for outer in range(n_outer):
            mine = {held: m for (o, held), m in cells.items() if o == outer}
            for inner in range(-1, n_inner) if mine else ():
                g = sum((m for held, m in mine.items() if held != inner), np.zeros((size, size)))
                g = g + np.triu(g, 1).T
                rate = g[p, -1] / g[-1, -1] if g[-1, -1] else 0.0
                for rep, use in enumerate(slices):
                    path = pls_path(g[np.ix_([*use, p, p + 1], [*use, p, p + 1])], len(use), list(grid))
                    # the discriminant of two one-hot columns is twice the label's score, less one
                    w = np.column_stack([np.zeros(len(use)), *[2 * b[:, 0] for b, _ in path.values()]])
                    b = np.array([2 * rate - 1, *[2 * b0[0] - 1 for _, b0 in path.values()]])
                    mean = g[use, -1] / max(g[-1, -1], 1.0)
                    spread = np.einsum("ij,ij->j", w, (g[np.ix_(use, use)] / max(g[-1, -1], 1.0) - np.outer(mean, mean)) @ w)
                    about = np.array([mean @ w + b, np.sqrt(np.maximum(spread, 0.0)), np.full(len(b), g[-1, -1])])
                    yield pa.RecordBatch.from_pylist([{
                        "run": run, "outer": outer, "inner": inner, "rep": rep, "counts": [0, *path], "w": w.tobytes(), "b": b.tobytes(), "about": about.tobytes(),
                    }], schema=fitted)

    fitted = pa.schema([(c, pa.int32()) for c in ("run", "outer", "inner", "rep")] + [("counts", pa.list_(pa.int32()))] + [(c, pa.binary()) for c in ("w", "b", "about")])
    spread = sent.repartition(len(runs), "run").sortWithinPartitions("run")
    got = spread.mapInArrow(fit, "run int, outer int, inner int, rep int, counts array<int>, w binary, b binary, about binary")
    found, about = {}, {}
    for r in got.collect():  # bounded by MOST_NUMBERS; an iterator would run one partition at a time
        counts = np.array(r["counts"])
        w = np.frombuffer(bytes(r["w"])).reshape(-1, len(counts))
        found[r["run"], r["outer"], r["inner"], r["rep"]] = counts, w, np.frombuffer(bytes(r["b"]))
        if r["inner"] == -1:
            about[r["run"], r["outer"], r["rep"]] = dict(zip(r["counts"], np.frombuffer(bytes(r["about"])).reshape(3, -1).T.tolist(), strict=True))
    return Fits(slices, found, about)


def scored(rows: DataFrame, ident: str, group: str, places: DataFrame, fits: Fits, runs: Sequence[tuple[int, int]]) -> DataFrame:
    """(ident, group, run, outer, inner, rep, n, y, score) of every row under every model that did not see its group.

    ``places`` is (group, places), the group's (run, outer, inner) in which it is held out.
    """
    kinds = f"`{ident}` {rows.schema[ident].dataType.simpleString()}, `{group}` {rows.schema[group].dataType.simpleString()}"
    names = [ident, group, "run", "outer", "inner", "rep", "n", "y", "score"]

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ys = _matrix(batch.column(2), batch.num_rows), _matrix(batch.column(3), batch.num_rows)
            of: dict = {}
            for place, g in enumerate(batch.column(1).to_pylist()):
                of.setdefault(g, []).append(place)
            for mine in of.values():
                some = x[mine]
                for at in batch.column(4)[mine[0]].as_py():
                    key = at["run"], at["outer"], at["inner"]
                    heads, cols = [], []
                    for rep, use in enumerate(fits.slices):
                        if (*key, rep) in fits.found:
                            counts, w, b = fits.found[*key, rep]
                            cols.append(some[:, use] @ w + b)
                            heads += [(rep, n) for n in counts.tolist()]
                    if not heads:
                        continue
                    scores, wide = np.concatenate(cols, axis=1), len(heads)
                    take = pa.array(np.repeat(mine, wide))
                    line = lambda v: pa.array(np.full(len(take), v, np.int32))
                    head = np.tile(np.array(heads, np.int32), (len(mine), 1))
                    y = np.repeat(ys[mine, runs[at["run"]][1]], wide).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(take), batch.column(1).take(take), line(key[0]), line(key[1]), line(key[2]),
                        pa.array(head[:, 0]), pa.array(head[:, 1]), pa.array(y), pa.array(scores.ravel()),
                    ], names=names)

    asked = rows.join(places, group).select(ident, group, F.col("x").cast("array<double>"), F.col("ys").cast("array<double>"), "places")
    return asked.mapInArrow(run_over, f"{kinds}, run int, outer int, inner int, rep int, n int, y int, score double")


PROBLEM = ["run", "outer", "rep", "comps"]
PACKED = "run int, outer int, rep int, comps int, range int, n int, pos binary, neg binary"
PACKED_ROWS = pa.schema([(c, pa.int32()) for c in (*PROBLEM, "range", "n")] + [("pos", pa.binary()), ("neg", pa.binary())])


def range_cuts(about: tuple[float, float, float], most: int) -> np.ndarray:
    """Scores that cut a problem into ranges of about ``most`` rows, were they normal; without cuts, all is one range."""
    mean, deviation, n = about
    parts = int(-(-n // most))
    if parts < 2 or not (np.isfinite(mean) and np.isfinite(deviation) and deviation > 0):
        return np.empty(0)
    return np.array([mean + deviation * NormalDist().inv_cdf(k / parts) for k in range(1, parts)])


def packed_scores(rows: DataFrame, group: str, places: DataFrame, fits: Fits, runs: Sequence[tuple[int, int]], most: int = RANGE_ROWS) -> DataFrame:
    """Scores as ``scored`` has them for counts over 0, packed by problem (run, outer, rep, comps), range and label."""

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, cuts = {}, 0, {}

        def told() -> Iterator[pa.RecordBatch]:
            out = []
            for (run, outer, rep, counts), parts in held.items():
                scores, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                pos, neg = scores[y == 1].T.copy(), scores[y == 0].T.copy()
                for c, n in enumerate(counts):
                    at = run, outer, rep, n
                    if at not in cuts:
                        cuts[at] = range_cuts(fits.about[run, outer, rep].get(n, (0.0, 0.0, 0.0)), most)
                    if not len(cuts[at]):
                        out.append((*at, 0, len(pos[c]) + len(neg[c]), pos[c].tobytes(), neg[c].tobytes()))
                        continue
                    of = [np.searchsorted(cuts[at], v[c], "right") for v in (pos, neg)]
                    for k in np.unique(np.concatenate(of)).tolist():
                        p, q = pos[c][of[0] == k], neg[c][of[1] == k]
                        out.append((*at, k, len(p) + len(q), p.tobytes(), q.tobytes()))
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), PACKED_ROWS, strict=True)], schema=PACKED_ROWS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), PACKED_ROWS, strict=True)], schema=PACKED_ROWS)

        for batch in batches:
            if not batch.num_rows:
                continue
            x, ys = _matrix(batch.column(1), batch.num_rows), _matrix(batch.column(2), batch.num_rows)
            of: dict = {}
            for place, g in enumerate(batch.column(0).to_pylist()):
                of.setdefault(g, []).append(place)
            for mine in of.values():
                some = x[mine]
                for at in batch.column(3)[mine[0]].as_py():
                    y = ys[mine, runs[at["run"]][1]]
                    for rep, use in enumerate(fits.slices):
                        if (at["run"], at["outer"], at["inner"], rep) in fits.found:
                            counts, w, b = fits.found[at["run"], at["outer"], at["inner"], rep]
                            scores = some[:, use] @ w[:, counts > 0] + b[counts > 0] + 0.0  # no negative zero
                            held.setdefault((at["run"], at["outer"], rep, tuple(counts[counts > 0].tolist())), []).append((scores, y))
                            size += scores.nbytes
                    if size >= HELD_BYTES:
                        yield from told()
                        held, size = {}, 0
        yield from told()

    asked = rows.join(places, group).select(group, F.col("x").cast("array<double>"), F.col("ys").cast("array<double>"), "places")
    return asked.mapInArrow(run_over, PACKED)


RANGE = ["run", "outer", "rep", "comps", "range"]
RANKED_ROWS = pa.schema([(c, pa.int32()) for c in RANGE] + [("pos", pa.int64()), ("neg", pa.int64()), ("wins", pa.float64())])


def range_wins(packed: DataFrame, most: int) -> DataFrame:
    """(problem, range, pos, neg, wins) of every range; ``most`` bounds the scores one task holds for one range."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pos, neg, out = None, [], [], []

        def solved() -> tuple:
            p, q = np.frombuffer(b"".join(pos)), np.sort(np.frombuffer(b"".join(neg)))
            wins = (np.searchsorted(q, p, "left").sum() + np.searchsorted(q, p, "right").sum()) / 2.0
            return (*now, len(p), len(q), float(wins))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), RANKED_ROWS, strict=True)], schema=RANKED_ROWS)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)
            for k, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        out.append(solved())
                    now, pos, neg = key, [], []
                    if len(out) >= 4096:
                        yield batch_of(out)
                        out = []
                pos.append(batch.column(5)[k].as_py())
                neg.append(batch.column(6)[k].as_py())
        if now is not None:
            out.append(solved())
            yield batch_of(out)

    large = packed.groupBy(*RANGE).agg(F.sum(F.col("n").cast("bigint")).alias("n")).where(F.col("n") > most).select(*RANGE)
    small = packed.drop("n").join(large, RANGE, "left_anti").select(*RANGE, "pos", "neg")
    kinds = "run int, outer int, rep int, comps int, range int, "
    ranked = small.repartition(*RANGE).sortWithinPartitions(*RANGE).mapInArrow(rank, kinds + "pos long, neg long, wins double")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for label, c in ((1, 5), (0, 6)):
                    scores = np.frombuffer(batch.column(c)[k].as_py())
                    line = [pa.array(np.full(len(scores), batch.column(i)[k].as_py(), np.int32)) for i in range(5)]
                    yield pa.RecordBatch.from_arrays([*line, pa.array(np.full(len(scores), label, np.int32)), pa.array(scores)], names=[*RANGE, "y", "score"])

    listed = packed.join(large, RANGE, "left_semi").select(*RANGE, "pos", "neg").mapInArrow(unpacked, kinds + "y int, score double")
    return ranked.unionByName(M.counted_wins(M.score_counts(listed, RANGE, "y", "score"), RANGE))


def inner_aucs(rows: DataFrame, group: str, places: DataFrame, fits: Fits, runs: Sequence[tuple[int, int]], most: int = RANGE_ROWS) -> DataFrame:
    """(run, outer, rep, comps, n_pos, n_neg, auc): Mann-Whitney AUC of every problem, as ``metrics.auc`` has it."""
    packed = written(packed_scores(rows, group, places, fits, runs, most), "scores")
    across = Window.partitionBy(*PROBLEM).orderBy("range")
    below = range_wins(packed, 4 * most).withColumn("below", F.sum("neg").over(across) - F.col("neg"))
    out = below.groupBy(*PROBLEM).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("wins") + F.col("pos").cast("double") * F.col("below").cast("double")).alias("wins")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return out.select(*PROBLEM, "n_pos", "n_neg", F.try_divide("wins", pairs).alias("auc"))


def nested_runs(
    rows: DataFrame, ident: str, group: str, stratum: str, parts: dict[str, list[tuple[int, int]]], folds: DataFrame,
    runs: Sequence[tuple[int, int]], n_folds: int, n_inner: int, grid: Sequence[int], seed: int,
) -> tuple[DataFrame, DataFrame]:
    """Nested grouped CV of every run; returns (out-of-fold rows, choices).

    ``rows`` carries ``x``, all features, and ``ys``, one 0/1 label per label set, neither with
    nulls inside; ``parts`` names the ranges of x that make up each representation.  ``folds`` is
    (repeat, group, fold) and a run a pair (repeat, label set).  Inside every outer training set
    the representation and the component count are chosen by inner AUC (ties: fewer components,
    then the representation named first) and the cut by balanced accuracy on the winner's inner
    scores, all on held-out inner groups.  Without ten inner scores of both classes the first
    representation, the smallest count and a cut of 0.5 hold.  Rows whose group has no fold take
    no part; rows with one id are scored each.
    """
    head = rows.select(F.size("x").alias("p"), F.size("ys").alias("k")).first()
    if head is None:
        return _empty(rows, ident, group)
    p, k = head["p"], head["k"]
    slices = [np.concatenate([np.arange(a, b) for a, b in ranges]) for ranges in parts.values()]
    models = len(runs) * n_folds * (n_inner + 1) * (len(grid) + 1)
    if models * sum(map(len, slices)) > MOST_NUMBERS:
        raise ValueError("too many models for one plan: fewer runs or representations a call")
    listed = F.inline(F.array(*[F.struct(F.lit(n).alias("run"), F.lit(r).alias("repeat"), F.lit(s).alias("set")) for n, (r, s) in enumerate(runs)]))
    rates = rows.groupBy(group, stratum).agg(F.array(*[F.avg(F.get("ys", F.lit(s)).cast("double")) for s in range(k)]).alias("rates"))
    dealt = folds.join(rates, group).select(group, stratum, "fold", "rates", F.col("repeat").alias("of"), listed).where("of = repeat")
    outer = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda o: o != F.col("fold"))).alias("outer")
    every = settle(dealt.select("run", "repeat", "set", group, stratum, "fold", F.get("rates", F.col("set")).alias("rate")))
    used = every.select("run", F.col("fold").alias("outer")).distinct()  # no fold without rows
    train = every.select("run", "repeat", group, stratum, "rate", outer).join(used, ["run", "outer"])
    held = settle(latin_deals(train, ["run", "repeat", "outer"], stratum, group, n_inner, F.col("repeat") + F.lit(seed), "held"))
    members = held.groupBy("run", group).agg(F.collect_list(F.struct("outer", "held")).alias("cells"))
    spots = held.select(group, "run", "outer", F.col("held").alias("inner")).unionByName(
        every.select(group, "run", F.col("fold").alias("outer"), F.lit(-1).alias("inner"))
    )
    placed = settle(spots.groupBy(group).agg(F.collect_list(F.struct("run", "outer", "inner")).alias("places")))
    grams = settle(shared_grams(rows, group, "x", "ys", p, k))
    fits = fit_all(grams, members, group, p, k, runs, slices, n_folds, n_inner, grid)

    inside = placed.select(group, F.filter("places", lambda a: a["inner"] >= 0).alias("places"))
    table = inner_aucs(rows, group, inside, fits, runs).where("auc IS NOT NULL AND n_pos + n_neg >= 10")
    pick = F.min(F.struct((-F.col("auc")).alias("loss"), F.col("comps").alias("n"), "rep")).alias("b")
    # one row a run and outer fold
    best = {(r["run"], r["outer"]): (r["b"]["rep"], r["b"]["n"], -r["b"]["loss"]) for r in table.groupBy("run", "outer").agg(pick).collect()}
    chosen = {(r["run"], r["outer"]): best.get((r["run"], r["outer"]), (0, min(grid), None)) for r in used.collect()}
    won = fits.only({at: (rep, n) for at, (rep, n, _) in chosen.items()})
    oof = settle(scored(rows, ident, group, placed, won, runs))

    cuts = M.best_threshold(oof.where("inner >= 0"), "y", "score", ["run", "outer"]).select("run", "outer", "threshold")
    names = list(parts)
    said = rows.sparkSession.createDataFrame(
        [(run, *runs[run], outer, names[rep], n, auc) for (run, outer), (rep, n, auc) in sorted(chosen.items())],
        "run int, repeat int, set int, outer int, rep string, n int, inner_auc double",
    )
    choices = settle(said.join(cuts, ["run", "outer"], "left").withColumn(
        "threshold", F.when(F.col("inner_auc").isNull(), 0.5).otherwise(F.col("threshold"))
    ))
    # the choices are one row a run and outer fold
    final = oof.where("inner = -1").drop("rep", "n").join(F.broadcast(choices), ["run", "outer"])
    return final.select(
        ident, group, "repeat", "set", F.col("outer").alias("fold"), "rep", "n", "y", "score",
        (F.col("score") >= F.col("threshold")).cast("int").alias("pred"), "threshold",
    ), choices.drop("run")


def _empty(rows: DataFrame, ident: str, group: str) -> tuple[DataFrame, DataFrame]:
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (ident, group))
    make = rows.sparkSession.createDataFrame
    return (
        make([], f"{kinds}, repeat int, set int, fold int, rep string, n int, y int, score double, pred int, threshold double"),
        make([], "repeat int, set int, outer int, rep string, n int, inner_auc double, threshold double"),
    )
