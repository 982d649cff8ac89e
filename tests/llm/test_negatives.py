"""Hard negatives against brute force, and what the tree's bounds leave to be scored."""

import math

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from specloom.llm import catalog, negatives


def brute(rows, is_anchor, positives=5, negatives=5, percent=(80, 100), scale=256):
    """rows: (id, label, vector); ids meet as their best-scored row."""
    usable = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in usable:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = set()

    def best(found, k):
        top = {}
        for s, i in found:
            top[i] = max(s, top.get(i, s))
        return sorted((-s, i) for i, s in top.items())[:k]

    for a, (label, v) in anchors.items():
        met = [(sum(p * q for p, q in zip(v, w, strict=True)), i, y) for i, y, w in usable if i != a and len(w) == len(v)]
        for s, p in best([(s, i) for s, i, y in met if y == label], positives):
            window = [(n, i) for n, i, y in met if y != label and percent[0] * -s <= 100 * n <= percent[1] * -s]
            out |= {(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(best(window, negatives), 1)}
    return out


def told(df):
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(spark, folder):
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, v, y in duckdb.sql(f"select vec_id, embedding, label from '{folder}/embeddings.parquet'").fetchall()]
    got = told(catalog.QUERIES["op11_negatives"](spark, folder))
    assert got and got == brute(rows, lambda i: i % 100 == 0)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert got == {tuple(r) for r in con.execute(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({catalog.SQL['op11_negatives']})").fetchall()}


def made(n, seed, hot=0.3):
    """Clusters, ties, one label with a third of the rows, repeated ids, odd rows and other lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = [(i, 1 if rng.random() < hot else int(rng.integers(0, 4)), (centres[i % 6] + 0.05 * rng.standard_normal(8)).round(1).tolist()) for i in range(n)]
    rows += [(5, 1, rows[5][2]), (5, 2, rows[6][2]), (10, 3, rows[4][2]), (10, 1, rows[4][2]), *[rows[7]] * 3]
    rows += [(900, None, [1.0] * 8), (901, 1, None), (902, 1, [None] + [1.0] * 7), (903, 1, [math.nan] * 8), (904, 1, [math.inf] + [0.0] * 7), (None, 1, [1.0] * 8)]
    rows += [(910, 1, [0.0] * 8), (920, 1, [1.0, 2.0]), (921, 1, [1.0, 1.9]), (922, 2, [0.9, 2.0]), (930, 2, []), (931, 1, [-1.0] * 8)]
    return rows


def test_odd_rows_blocks_and_parts(spark):
    rows = made(240, 3)
    want = brute(rows, lambda i: i % 10 == 0)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"v": F.lit("x"), "score": F.lit(1), "rank": F.lit(2), "anchor_id": F.lit(3)})
    assert len(want) > 100
    assert told(negatives.mine(df, F.col("vec_id") % 10 == 0)) == want
    assert told(negatives.mine(df.repartition(9), F.col("vec_id") % 10 == 0, block=7, batch_rows=16)) == want
    wide = dict(positives=2, negatives=3, percent=(50, 120))
    assert told(negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0, block=40, batch_rows=50, **wide)) == brute(rows, lambda i: i % 10 == 0, **wide)
    assert negatives.mine(df.where("false"), F.lit(True)).count() == 0
    assert negatives.mine(df, F.col("vec_id") < 0).count() == 0
    big = spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>")
    try:
        negatives.mine(big, F.lit(True))
        raise AssertionError("scores beyond doubles were taken")
    except ValueError:
        pass


def test_bounds_leave_few_candidates_where_anchors_are_close():
    """On clusters the tree spares most scores, and the kept ones are those brute force keeps."""
    rng = np.random.default_rng(1)
    centres = 4 * rng.standard_normal((40, 16))
    x = np.floor(256 * (centres[np.arange(4000) % 40] + 0.02 * rng.standard_normal((4000, 16))))
    ids, labels = np.arange(4000), rng.integers(0, 3, 4000)
    at = np.flatnonzero(ids % 20 == 0)
    tree = negatives.spanning_tree(ids[at], labels[at], x[at])
    assert (tree.parent[1:] < np.arange(1, len(at))).all() and tree.parent[0] == -1
    edges = sorted(tree.edge[1:])
    assert len(edges) == len(at) - 1 and edges[len(edges) // 2] < 256 * 0.3  # most edges stay within a cluster
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(list(x))], names=["vec_id", "label", "v"])
    scored = []
    first = [r for b in negatives.same_label(tree, 5, 500, scored)([batch]) for r in b.to_pylist()]
    assert sum(scored) < 0.25 * len(at) * len(ids)
    scores = x @ x[at].T
    for k, a in enumerate(at.tolist()):
        order = [j for j in np.lexsort((ids, -scores[:, k])) if labels[j] == labels[a] and j != a][:5]
        assert [r["vec_id"] for r in first if r["anchor_id"] == a] == order
