"""Divergence of sources against fractions, with few terms and with many shards and blocks."""

import re
from collections import Counter
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
from pyspark.sql import functions as F

from specloom.llm import catalog, divergence

from llm_cases import CLASHES, ODD

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def slow_audit(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, terms in mine:
            counts[s].update(t for t in terms if seen[t] >= least)
        whole = sum(counts.values(), Counter())

        def p(c, v=len(kept), kept=kept):
            total = sum(c[t] for t in kept) + 2 * v
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 2), total)) for t in kept}

        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: floor(Fraction((a - b) ** 2, a + b))
        for s in counts:
            pair = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            term = sorted((-f(ps[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and ps[s][t] > q[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)}
    return out


def told(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(spark, folder):
    rows = duckdb.sql(f"select lang, source, text from '{folder}/documents.parquet'").fetchall()
    got = told(catalog.QUERIES["op13_divergence"](spark, folder))
    assert got == slow_audit(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert got == {tuple(r) for r in con.execute(f"select {', '.join(COLUMNS)} from ({catalog.SQL['op13_divergence']})").fetchall()}


def made(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "é", "漢字", "İ", " x", "naïve", "KK"]
    rows = []
    for i in range(n):
        lang = ("a", "b", None, "")[int(rng.integers(0, 4))]
        source = f"s{rng.integers(0, 9)}" if rng.random() < 0.6 else ("s0" if rng.random() < 0.9 else None)
        some = rng.choice(len(words), int(rng.integers(0, 25)), p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1)))
        rows.append((lang, source, " ".join(words[j].upper() if rng.random() < 0.3 else words[j] for j in some) or (None, "", "1 2 _ {}")[i % 3]))
    return rows + rows[:20] + [("z", "only", None), ("y", "one", "x y"), ("y", "two", "x z")]


def test_odd_rows_shards_and_blocks(spark):
    rows = made(500, 2)
    df = spark.createDataFrame([(i // 3, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    df = df.select("*", *[F.lit(c).alias(c) for c in CLASHES if c not in df.columns], F.lit(1).alias("term"), F.lit(2).alias("m"))
    want = slow_audit(rows)
    assert len(want) > 100
    assert told(divergence.audit(df)) == want
    assert told(divergence.audit(df.repartition(11), block=3, shard_rows=40)) == want
    assert told(divergence.audit(df, least_docs=1, top=3)) == slow_audit(rows, 1, 3)
    assert divergence.audit(df.where("false")).count() == 0


def test_odd_texts(spark, odd):
    got = told(divergence.audit(odd.withColumn("source", F.concat(F.lit("s"), F.coalesce("doc_id", F.lit(0)) % 3)), least_docs=1))
    assert got == slow_audit([(None, f"s{(i or 0) % 3}", t) for i, t in ODD], 1)


def test_counts_merge_across_slices_and_batches():
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["lang", "source", "text"])
    rows = [(f"l{i % 2}", f"s{i % 3}", "A a b " * (i % 5)) for i in range(100)]
    for size, most in ((10, 10**6), (1 << 20, 5), (1 << 20, 10**6)):
        total = Counter()
        for b in divergence.partial_counts(size, most)([batch(rows[:30]), batch(rows[30:])]):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"], "n"] += r["n"]
                total[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        want = Counter()
        for lang, source, text in rows:
            want[lang, source, None, "n"] += 0
            for t in text.lower().split():
                want[lang, source, t, "n"] += 1
            for t in set(text.lower().split()):
                want[lang, source, t, "docs"] += 1
        assert {k: v for k, v in total.items() if v} == {k: v for k, v in want.items() if v}
        assert {k[:2] for k in total} == {k[:2] for k in want}


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(4)
    total = rng.integers(1, 1 << 52, 500)
    count = (total * rng.random(500)).astype(np.int64)
    assert divergence.share(count, total).tolist() == [10**9 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]
