"""Removal of byte strings that occur twice, by merging Burrows-Wheeler transforms of shards.

A string of ``length`` bytes that starts at two places holds, at both, the same least k-gram
(the lowest hash, rightmost on ties), so only starts under a k-gram that occurs twice can repeat.
Each run of starts with one least k-gram has a context: all bytes its strings cover.

1. k-grams are counted; runs under a single one are done. Nothing is lost by this.
2. A context that occurs twice repeats whole. Only one copy of it goes on, with the other contexts
   of its k-gram.
3. These contexts meet by k-gram. A task reads them as shards, sorts each shard's suffixes into its
   transform over symbols of ``symbol`` bytes, and merges the transforms by interleave refinement:
   starting from one shard after the other, each round deals the merged order out by the symbol
   before each suffix, until the order stands. The round in which two neighbours part is their
   common prefix; neighbours that share ``length`` bytes are a repeated interval. No suffix of a
   shard is sorted again.
4. Under a k-gram with over ``hot`` different contexts, strings are counted by hash instead, so no
   group is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, Rows, keyed, staged, texts

GRAM = 32
TIE_BITS = 21
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each place on; zero-padded to the length of the data."""
    h = (data.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
    width, doubled = 1, []
    while width <= n:
        doubled.append((width, h))
        if width * 2 > n:
            break
        h = h[:-width] * U(0x9E3779B97F4A7C15) + (h[width:] ^ (h[width:] >> U(32)))
        h ^= h >> U(29)
        width *= 2
    width, h = doubled[-1]
    if width < n and len(h) > n - width:
        h = h[: -(n - width)] * U(0xC2B2AE3D27D4EB4F) + (h[n - width :] ^ (h[n - width :] >> U(31)))
    return mixed(h[: max(0, len(data) - n + 1)])


def least_grams(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, the key of the least of ``width`` hashes from it on; the key's low bits tell where."""
    low = U((1 << TIE_BITS) - 1)
    m, n = (h & ~low) | (low - np.arange(len(h), dtype=U)), 1
    while n * 2 <= width:
        m, n = np.minimum(m[:-n], m[n:]), n * 2
    return m if n == width else np.minimum(m[: len(m) - (width - n)], m[width - n :])


def runs(data: bytes, bounds: list[tuple[int, int]], length: int):
    """k-gram hash, first and last start, and the k-gram's place, of every run of starts.

    ``bounds``: begin and end of each text in the data.
    """
    grams = gram_hashes(np.frombuffer(data, np.uint8), GRAM)
    least = least_grams(grams, length - GRAM + 1)
    starts = np.concatenate([np.arange(b, e - length + 1) for b, e in bounds])
    keys = least[starts]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    first, last = starts[new], starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))]
    place = ((1 << TIE_BITS) - 1) - (keys[new] & U((1 << TIE_BITS) - 1)).astype(np.int64)
    return grams[place], first, last, place


RUNS = "id long, th long, gram long, context long, first long, last long"
RUN_ROWS = pa.schema([(c, pa.int64()) for c in ("id", "th", "gram", "context", "first", "last")])


def run_table(docs: DataFrame, length: int, segment: int = 1 << 18) -> DataFrame:
    """All runs of all texts; long texts in segments that overlap by a string less a byte."""

    def find(batches):
        held: list[tuple[int, int, int, bytes]] = []  # id, text hash, place in the text, bytes

        def solve():
            data, bounds, at = b"".join(h[3] for h in held), [], 0
            for h in held:
                bounds.append((at, at + len(h[3])))
                at += len(h[3])
            gram, first, last, place = runs(data, bounds, length)
            begins = np.array([b for b, _ in bounds])
            text = np.searchsorted(begins, first, "right") - 1
            context = np.array([xxhash.xxh3_64_intdigest(data[a : b + length], a + 4096 - p) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)], U)
            shift = np.array([h[2] for h in held]) - begins
            columns = (np.array([h[0] for h in held])[text], np.array([h[1] for h in held])[text], gram.view(np.int64), context.view(np.int64), first + shift[text], last + shift[text])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=RUN_ROWS)

        size = 0
        for batch in batches:
            hashes = batch.column(batch.schema.get_field_index("th")).to_pylist()
            for (i, text), th in zip(texts([batch], key="id"), hashes, strict=True):
                for at in range(0, len(text) - length + 1, segment):
                    part = text[at : at + segment + length - 1]
                    held.append((i, th, at, part))
                    size += len(part)
                    if size >= segment:
                        yield solve()
                        held, size = [], 0
        if held:
            yield solve()

    return docs.select("id", "th", "text").mapInArrow(find, RUNS)


class Shards:
    """Suffixes of contexts over symbols of q bytes; a context ends in a place of its own."""

    def __init__(self, contexts: list[bytes], q: int):
        self.q, sizes = q, np.array([len(c) + 1 for c in contexts])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
        n = len(data)
        left = np.repeat(self.ends, sizes) - 1 - np.arange(n)  # bytes from here to the context's end
        self.whole = left >= q  # a symbol starts here
        grams = np.zeros(n, U)
        got = gram_hashes(data, q)
        grams[: len(got)] = got
        self.symbol = np.zeros(n, np.int64)
        self.symbol[self.whole] = np.unique(grams[self.whole], return_inverse=True)[1] + 1

    def transform(self, a: int, b: int) -> np.ndarray:
        """Places of one shard's suffixes in order, by doubling; every context's end is its own symbol."""
        s, whole, n, step = self.symbol[a:b], self.whole[a:b], b - a, self.q
        rank = np.where(whole, s + n, 0)
        rank[~whole] = np.arange(n - whole.sum())
        while True:
            following = np.zeros(n, np.int64)
            following[: n - step] = rank[step:]
            left = np.repeat(self.ends, np.diff(np.concatenate((self.begins, self.ends[-1:]))))[a:b] - 1 - np.arange(a, b)
            key = rank * (2 * n + self.symbol.max() + 2) + np.where(left >= step, following, 0)
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            if rank.max() == n - 1 or step > n:
                return order + a
            step *= 2

    def merge(self, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged order, and the common prefix (in symbols) of each suffix with the one before it."""
        n, q, size = len(one) + len(other), self.q, len(self.symbol)
        at = np.empty(size, np.int64)
        at[one], at[other] = np.arange(len(one)), len(one) + np.arange(len(other))
        common, apart, interval = np.full(n, -1, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        common[0] = 0
        ends_one = int((~self.whole[one]).sum())
        for depth in range(size):
            keys = []
            for order, ends in ((one, 0), (other, ends_one)):
                whole = self.whole[order]
                key = np.empty(len(order), np.int64)
                key[~whole] = ends + np.arange(len(order) - whole.sum())
                key[whole] = self.symbol[order[whole]] * n + at[order[whole] + q]
                keys.append(key)
            place = np.arange(len(other)) + np.searchsorted(keys[0], keys[1], "right")
            free = np.ones(n, bool)
            free[place] = False
            merged = np.empty(n, np.int64)
            merged[place], merged[free] = other, one
            whole = self.whole[merged]
            behind = np.full(n, -1, np.int64)
            behind[whole] = interval[at[merged[whole] + q]]
            symbols = self.symbol[merged]
            now = np.concatenate(([True], (symbols[1:] != symbols[:-1]) | (behind[1:] != behind[:-1]) | ~whole[1:]))
            common[now & ~apart] = depth
            then = np.empty(size, np.int64)
            then[merged] = np.arange(n)
            still = np.array_equal(now, apart) and np.array_equal(then[one], at[one]) and np.array_equal(then[other], at[other])
            at, apart, interval = then, now, np.cumsum(now)
            if still:
                break
        common[common < 0] = size
        return merged, common


def repeated(contexts: list[bytes], length: int, q: int, shards: int = 2) -> np.ndarray:
    """Places (in the joined contexts, one apart) of strings of ``length`` bytes that occur twice."""
    s = Shards(contexts, q)
    cuts = [0, *(int(s.ends[len(contexts) * k // shards - 1]) for k in range(1, shards) if len(contexts) * k // shards), int(s.ends[-1])]
    orders = [s.transform(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    order, common = orders[0], None
    for other in orders[1:]:
        order, common = s.merge(order, other)
    if common is None:
        order, common = s.merge(order, order[:0])
    deep = common >= length // q
    return np.sort(order[deep | np.concatenate((deep[1:], [False]))]), s


def removed_spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by intervals."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return list(zip(starts[new].tolist(), reach[np.concatenate((new[1:] - 1, [len(starts) - 1]))].tolist(), strict=True))


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled; the columns of the row they carry stay as they are."""
    carried = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", packed binary"

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                data = pa.array([press.compress(text) for _, text in texts([part], key="id")], pa.binary())
                columns = [part.column(part.schema.get_field_index(f.name)) for f in carried]
                yield pa.RecordBatch.from_arrays([*columns, data], names=[*(f.name for f in carried), "packed"])

    return docs.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, length: int, symbol: int, hot: int, chunk_bytes: int) -> DataFrame:
    """id, th, first, last: runs of starts whose strings occur elsewhere too."""
    found = staged(run_table(docs, length), "runs")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1")
    grams = staged(grams.select("gram", (F.col("a") != F.col("b")).alias("mixed")), "grams")  # a table, so that the join can split a hot k-gram
    shared = staged(found.join(grams, "gram"), "shared-runs")
    alike = shared.where("not mixed")
    mixed_runs = shared.where("mixed")
    kinds = mixed_runs.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "first", "last")).alias("r"))
    kinds = staged(kinds.select("gram", "context", "copies", "r.*"), "contexts")
    copied = mixed_runs.join(kinds.where("copies > 1").select("gram", "context"), ["gram", "context"])
    hot_grams = kinds.groupBy("gram").count().where(F.col("count") > hot).select("gram")
    wanted = kinds.join(hot_grams.withColumn("hot", F.lit(True)), "gram", "left")
    wanted = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("gram", "first", "last", "copies", "hot")).alias("wanted"))  # as many as the text has runs
    with_text = wanted.join(packed(docs.select("id", "th", "text")), ["id", "th"])
    context_rows = pa.schema([("gram", pa.int64()), ("hot", pa.bool_()), ("alone", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])

    def cut(batches):
        out, unpress = Rows(context_rows), zstandard.ZstdDecompressor()
        for batch in batches:
            ids, hashes, lists, data = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "th", "wanted", "packed"))
            for k in range(batch.num_rows):
                text = unpress.decompress(data[k].as_py())
                for w in lists[k].as_py():
                    part = text[w["first"] : w["last"] + length]
                    yield from out.add(w["gram"], bool(w["hot"]), w["copies"] == 1, ids[k].as_py(), hashes[k].as_py(), w["first"], part, weight=len(part))
        yield from out.flush()

    contexts = staged(with_text.select("id", "th", "wanted", "packed").mapInArrow(cut, "gram long, hot boolean, alone boolean, id long, th long, first long, bytes binary"), "context-bytes")
    span_rows = pa.schema([(c, pa.int64()) for c in ("id", "th", "first", "last")])

    def solve(batches):
        out, held, size = Rows(span_rows), [], 0

        def told():
            places, s = repeated([h[-1] for h in held], length, symbol)
            which = np.searchsorted(s.begins, places, "right") - 1
            new = np.flatnonzero(np.concatenate(([True], np.diff(places) != 1))) if len(places) else places
            ends = np.concatenate((new[1:] - 1, [len(places) - 1])) if len(places) else places
            for a, b in zip(new.tolist(), ends.tolist(), strict=True):
                gram, alone, i, th, first, _ = held[which[a]]
                if alone:
                    begin = int(s.begins[which[a]])
                    yield from out.add(i, th, first + int(places[a]) - begin, first + int(places[b]) - begin)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("gram", "alone", "id", "th", "first", "bytes")]
            for row in zip(*columns, strict=True):
                if size >= chunk_bytes and held[-1][0] != row[0]:
                    yield from told()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield from told()
        yield from out.flush()

    by_gram = contexts.where("not hot").drop("hot").repartition("gram").sortWithinPartitions("gram", "id", "first")
    resolved = by_gram.mapInArrow(solve, "id long, th long, first long, last long")
    string_rows = pa.schema([("string", pa.int64()), ("alone", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("first", pa.int64())])

    def strings(batches):
        out = Rows(string_rows)
        for batch in batches:
            alone, ids, hashes, firsts, data = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("alone", "id", "th", "first", "bytes"))
            for a, i, th, first, part in zip(alone, ids, hashes, firsts, data, strict=True):
                for k, h in enumerate(gram_hashes(np.frombuffer(part, np.uint8), length).view(np.int64).tolist()):
                    yield from out.add(h, a, i, th, first + k)
        yield from out.flush()

    listed = contexts.where("hot").drop("hot").mapInArrow(strings, "string long, alone boolean, id long, th long, first long")
    twice = listed.groupBy("string").count().where(F.col("count") > 1).select("string")
    counted = listed.where("alone").join(twice, "string").select("id", "th", "first", F.col("first").alias("last"))
    same = ("id", "th", "first", "last")
    return alike.select(*same).unionByName(copied.select(*same)).unionByName(resolved).unionByName(counted)


def remove_repeats(docs: DataFrame, length: int = 200, symbol: int = 100, hot: int = 2048, chunk_bytes: int = 768 << 10, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, kept (bytes left; with ``as_text`` a string, less what is left of characters that were cut), removed (array of begin and end in bytes of the text), and carried columns.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in the input,
    the same text included. ``length`` is a multiple of ``symbol`` and over 64. Null texts are
    empty; repeated rows repeat each other; short texts stay whole; an empty table gives no row.
    """
    kept = keyed(docs, id_col, text_col)
    spans = repeated_runs(kept, length, symbol, hot, chunk_bytes)
    spans = spans.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # as many as the text has runs
    if carry:
        text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
        rest = F.struct(*(F.col(c) for c in carry)).alias("rest")
        kept = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LOWEST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), rest)
    joined = packed(kept).join(spans, ["id", "th"], "left").drop("id", "th")
    carried = [f for f in joined.schema if f.name in ("doc_id", "rest")]
    told = pa.schema([("n_bytes", pa.int64()), ("kept", pa.string() if as_text else pa.binary()), ("removed", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                data, lists = (part.column(part.schema.get_field_index(c)) for c in ("packed", "spans"))
                for k in range(part.num_rows):
                    text, found, gone = unpress.decompress(data[k].as_py()), lists[k].as_py(), []
                    if found:
                        gone = removed_spans(np.array([f["first"] for f in found]), np.array([f["last"] + length for f in found]))
                    edges = [0, *(e for span in gone for e in span), len(text)]
                    left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(text), left.decode(errors="ignore") if as_text else left, [list(g) for g in gone]))
                columns = [pa.array([o[k] for o in out], f.type) for k, f in enumerate(told)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in carried), *columns], names=[*(f.name for f in carried), *told.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    return joined.mapInArrow(run, schema + ", n_bytes long, kept " + ("string" if as_text else "binary") + ", removed array<array<bigint>>")


def digest(result: DataFrame) -> DataFrame:
    """Counts and the hash of what is left."""
    return result.select(
        "doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (a, s) -> a + s[1] - s[0])").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
