"""How far the sources of a language differ in their words, in exact integers.

Tasks lower, split, encode and count whole batches with Arrow's own kernels and hand out partial
counts. Merged counts are dealt to shards of one language and a share of its terms; a shard holds
the counts of two blocks of sources in columns and adds up the divergence of every two of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, staged

#: What stands between terms, in RE2; terms are runs of ASCII letters and of all beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
KEYS = ["lang", "source", "term"]
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or of a single row."""
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    at = size = 0
    for j, n in enumerate(lengths.tolist()):
        if j > at and size + n > most_bytes:
            yield batch.slice(at, j - at)
            at, size = j, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def counted(part: pa.RecordBatch) -> pa.Table:
    """Occurrences and rows by language, source and term, and a row without a term for each group."""
    lang, source = (pc.dictionary_encode(part.column(c)) for c in ("lang", "source"))
    wide = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
    split = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), pattern=BETWEEN)
    held, row = pc.list_flatten(split), pc.list_parent_indices(split)
    there = pc.greater(pc.binary_length(held), 0)
    term = pc.dictionary_encode(held.filter(there))
    terms = max(1, len(term.dictionary))
    key = row.filter(there).to_numpy().astype(np.int64) * terms + term.indices.to_numpy()
    by_row = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    key = by_row["key"].to_numpy()
    pairs = pa.table({"key": group[key // terms] * terms + key % terms, "n": by_row["count_all"]})
    found = pairs.group_by("key", use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    key = found["key"].to_numpy()
    marks = np.unique(group)
    groups = np.concatenate([key // terms, marks])
    names = term.dictionary.take(pa.array(key % terms)) if len(key) else pa.array([], pa.string())
    none = pa.array(np.zeros(len(marks), np.int64))
    column = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.Table.from_arrays(
        [
            lang.dictionary.take(pa.array(groups // wide)), source.dictionary.take(pa.array(groups % wide)),
            pa.concat_arrays([names, pa.nulls(len(marks), pa.string())]),
            pa.concat_arrays([column(found["n_sum"]), none]), pa.concat_arrays([column(found["count_all"]), none]),
        ],
        schema=PARTIAL,
    )


def merged(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return both.select([*KEYS, "n_sum", "docs_sum"]).rename_columns(PARTIAL.names).combine_chunks()


def partial_counts(most_bytes: int = 4 << 20, most_rows: int = 400_000):
    """Counts of a task's rows, merged as they come and handed out whenever many are held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, "text", most_bytes):
                held.append(counted(part))
                if sum(t.num_rows for t in held) < most_rows:
                    continue
                held = [merged(held)]
                if held[0].num_rows > most_rows // 2:
                    yield from held.pop().to_batches(max_chunksize=1 << 15)
        if held:
            yield from merged(held).to_batches(max_chunksize=1 << 15)

    return run


def share(count: np.ndarray, total: np.ndarray | int, of: int = 10**9) -> np.ndarray:
    """floor(of * count / total) for count <= total < 2**53, without a product beyond 64 bits."""
    out, rest = np.divmod(count, total)
    while of > 1:
        more, rest = np.divmod(rest * 1000, total)
        out, of = out * 1000 + more, of // 1000
    return out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
FOUND_SQL = "lang string, source string, part string, item string, value long"


def compare(top: int, chunk: int = 512):
    """Divergences within shards whose rows come sorted: the groups of a shard first, then its terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(FOUND)

        def entries():
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("lang", "shard", "a", "b", "term", "source", "block", "n", "m", "total", "v", "lang_total")]
                yield from zip(*columns, strict=True)

        for (lang, _, a, b), shard in groupby(entries(), key=lambda r: r[:4]):
            names, block, totals, sums, best, v, whole, absent = [], [], [], None, {}, 0, 0, 0
            place: dict[str, int] = {}
            terms: list[tuple[str, int]] = []
            cells: list[tuple[int, int, int]] = []

            def add(p: np.ndarray, times: int = 1):
                for i in range(len(names) - 1):
                    others = range(i + 1, len(names)) if a == b else [j for j in range(i + 1, len(names)) if block[i] != block[j]]
                    if len(others):
                        sums[i, others] += times * apart(p[others], p[i]).sum(1)

            def settle():
                """Adds the terms held to the sums and to the best terms of each source."""
                n = np.zeros((len(names), len(terms)), np.int64)
                if cells:
                    s, t, c = np.array(cells).T
                    n[s, t] = c
                total = np.array(totals)[:, None] + 2 * v
                p = 1 + share(n + 2, total)
                add(p)
                if a == b:
                    q = 1 + share(np.array([m for _, m in terms]) + 2, whole + 2 * v)
                    for i in range(len(names)):
                        hit = np.flatnonzero((n[i] > 0) & (p[i] > q))
                        if len(hit):
                            some = zip((-apart(p[i, hit], q[hit])).tolist(), (terms[t][0].encode() for t in hit), strict=True)
                            best[i] = sorted([*best.get(i, ()), *some])[:top]
                terms.clear()
                cells.clear()

            for _, _, _, _, term, source, of, n, m, total, v_, whole_ in shard:
                if term is None:
                    place[source] = len(names)
                    names.append(source)
                    block.append(of)
                    totals.append(total)
                    v, whole, absent = v_, whole_, n
                    continue
                if sums is None:
                    sums = np.zeros((len(names), len(names)), np.int64)
                if not terms or terms[-1][0] != term:
                    if len(terms) == chunk:
                        settle()
                    terms.append((term, m))
                    absent -= 1
                cells.append((place[source], len(terms) - 1, n))
            if sums is None:
                sums = np.zeros((len(names), len(names)), np.int64)
            if terms:
                settle()
            if absent:  # terms that only sources of other blocks use
                add(1 + share(np.full((len(names), 1), 2), np.array(totals)[:, None] + 2 * v), absent)
            for i in range(len(names)):
                for j in range(i + 1, len(names)):
                    if a == b or block[i] != block[j]:
                        yield from out.add(lang, names[i], "pair", names[j], int(sums[i, j]))
                for value, term in best.get(i, ()):
                    yield from out.add(lang, names[i], "term", term.decode(), -value)
        yield from out.flush()

    return run


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = 256, shard_rows: int = 1 << 16, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other one of its
    language (part ``pair``), and the ``top`` terms it uses more than its language does (``term``).

    A term counts for a language if at least ``least_docs`` of its rows hold it; every row is a
    document, repeated rows and equal ids too. Null text, language or source is empty, an empty one
    a group like any other; a text without terms, or of any length, is fine. Groups whose language
    keeps no term are 0 apart. Ties go to the item first in UTF-8. An empty table gives no row; other
    columns are not read. Exact while a language has fewer than 2**53 / 1000 terms in all.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    parts = plain.mapInArrow(partial_counts(), "lang string, source string, term string, n long, docs long")
    counts = staged(parts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    used = counts.where(F.col("term").isNotNull())
    kept = used.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    rows = staged(used.drop("docs").join(kept, ["lang", "term"]), "term-shards")

    # one row a group, with its place among the sources of its language and all totals
    per_lang = rows.groupBy("lang", "term").agg(F.max("m").alias("m")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("m").alias("lang_total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").withColumn("block", F.floor(place / block).cast("int"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(per_lang, "lang", "left")
    v, sources = F.coalesce("v", F.lit(0)), F.col("sources")
    groups = staged(
        numbered.join(sizes, "lang").select(
            "lang", "source", "block", F.coalesce("total", F.lit(0)).alias("total"), v.alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
            F.greatest(F.ceil(v * F.least(sources, F.lit(2 * block)) / shard_rows), F.lit(1)).cast("int").alias("shards"),
            F.ceil(sources / block).cast("int").alias("blocks"),
        ),
        "source-groups",
    )

    def dealt(df: DataFrame) -> DataFrame:
        """Each row once for every block that its source's block is compared with."""
        met = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return met.select(
            "lang", "shard", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
            "term", "source", "block", "n", "m", "total", "v", "lang_total",
        )

    none = F.lit(None)
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    # a group's row in each shard says how many terms the shard has
    widths = rows.select("lang", "term").distinct().join(groups.groupBy("lang").agg(F.max("shards").alias("shards")), "lang").groupBy("lang", shard.alias("shard")).agg(F.count("*").alias("n"))
    heads = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(widths, ["lang", "shard"], "left")
    heads = heads.withColumns({"n": F.coalesce("n", F.lit(0)), "term": none.cast("string"), "m": none.cast("long")})
    body = rows.join(groups, ["lang", "source"]).withColumn("shard", shard).withColumns({c: none.cast("long") for c in ("total", "v", "lang_total")})
    cells = dealt(heads).unionByName(dealt(body)).repartition("lang", "shard", "a", "b").sortWithinPartitions("lang", "shard", "a", "b", F.asc_nulls_first("term"), "source")
    found = staged(cells.mapInArrow(compare(top), FOUND_SQL), "divergence-parts")

    sums = found.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s")
    both = sums.select("lang", "part", "value", turned).select("lang", "s.source", "part", "s.item", "value")
    every = both.unionByName(found.where(F.col("part") == "term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return every.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS held FROM documents),
w AS (SELECT r, lang, source, unnest(held) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS m FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT d.lang, coalesce(max(k.v), 0) AS v, coalesce(max(k.total), 0) AS total
    FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN (SELECT lang, count(*) AS v, sum(m) AS total FROM kept GROUP BY lang) k USING (lang) GROUP BY d.lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (SELECT g.lang, g.source, coalesce(t.total, 0) AS total, l.v FROM (SELECT DISTINCT lang, source FROM d) g
    JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p,
    1 + (1000000000::HUGEINT * (k.m + 2)) // (l.total + 2 * l.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
