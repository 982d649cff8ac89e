"""SimHash near-duplicates: one 64-bit fingerprint a text, pigeonhole blocks, Hamming check.

Fingerprints within ``k`` bits of each other agree in at least ``blocks - k`` of ``blocks`` blocks,
so they meet under the key of one choice of that many blocks. Only distinct fingerprints are
joined, so exact copies of a text are one row; within a bucket only a spanning forest of the
verified links leaves the task. Buckets beyond ``slice_rows`` are met in pairs of slices.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, Rows, keyed, staged, texts
from .components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42


def shingle_hashes(text: bytes, words: int):
    """XXH64 of each run of ``words`` words, in arrays of bounded length."""
    parts = text.translate(LOWER).split()
    if not parts:
        return
    joined, n = b" ".join(parts), len(parts)
    if n <= words:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - words + 1].tolist()
    stops, digest = ends[words - 1 :].tolist(), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65_536):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=True)], np.uint64)


def fingerprint(text: bytes, words: int) -> int:
    """Signed 64-bit fingerprint; a bit is set if it is in over half of the shingle hashes."""
    n, sums = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, words):
        n += len(h)
        sums += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, id, th, fp: the row's key and its fingerprint. A text without words has fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            found = pa.array([fingerprint(text, words) for _, text in texts([batch])], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "id", "th")), found], schema=schema)

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, id long, th long, fp long")


def block_keys(fp: Column, k: int, blocks: int) -> Column:
    """The masked fingerprint of every choice of ``blocks - k`` blocks; key and choice in a struct."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for choice, kept in enumerate(combinations(masks, blocks - k)):
        mask = sum(kept)
        keys.append(F.struct(F.lit(choice).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*keys)


def forest(left: np.ndarray, right: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs (left, right), or of left with itself, within ``k`` bits."""
    same = right is left
    size, links = len(left), []
    if same:
        unseen = np.ones(size, bool)
        for root in range(size):
            if not unseen[root]:
                continue
            unseen[root], front = False, [root]
            while front:
                at = front.pop()
                near = np.flatnonzero(unseen & (np.bitwise_count(left ^ left[at]) <= k))
                unseen[near] = False
                front += near.tolist()
                links += [(int(left[at]), int(left[j])) for j in near]
        return links
    free_left, free_right = np.ones(size, bool), np.ones(len(right), bool)
    for root in range(size):
        if not free_left[root]:
            continue
        free_left[root], front = False, [(True, root)]
        while front:
            is_left, at = front.pop()
            value = left[at] if is_left else right[at]
            other, free = (right, free_right) if is_left else (left, free_left)
            near = np.flatnonzero(free & (np.bitwise_count(other ^ value) <= k))
            free[near] = False
            front += [(not is_left, j) for j in near.tolist()]
            links += [(int(value), int(other[j])) for j in near]
    return links


def links(distinct: DataFrame, k: int = 3, blocks: int = 6, slice_rows: int = 2048) -> DataFrame:
    """a, b: links of distinct fingerprints (column fp) at most ``k`` bits apart, enough to connect
    every two that any chain of such links connects."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), k, blocks)).alias("b")).select("fp", "b.*")
    bucket = Window.partitionBy("choice", "key")
    sized = keyed.withColumn("n", F.count("*").over(bucket)).where("n > 1")
    sized = sized.withColumn("slices", F.ceil(F.col("n") / slice_rows).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    mates = sized.withColumn("own", own).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = mates.select("choice", "key", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"), "own", "fp")
    cells = cells.repartition("choice", "key", "lo", "hi").sortWithinPartitions("choice", "key", "lo", "hi", "own")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        out, held, cell = Rows(schema), [], None

        def solve():
            fp, own = np.concatenate([h[0] for h in held]).view(np.uint64), np.concatenate([h[1] for h in held])
            if cell[2] == cell[3]:
                found = forest(fp, fp, k) if len(fp) > 2 else [(int(fp[0]), int(fp[1]))] if len(fp) == 2 and (fp[0] ^ fp[1]).item().bit_count() <= k else []
            else:
                found = forest(fp[own == cell[2]], fp[own == cell[3]], k)
            for a, b in found:
                yield from out.add(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("choice", "key", "lo", "hi")]
            fp, own = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("fp", "own"))
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                then = tuple(int(c[s]) for c in cols)
                if then != cell:
                    if held:
                        yield from solve()
                    held, cell = [], then
                held.append((fp[s:e], own[s:e]))
        if held:
            yield from solve()
        yield from out.flush()

    return cells.mapInArrow(run, "a long, b long").distinct()


def rooted(docs: DataFrame, words: int, k: int, blocks: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with their fingerprints, and each distinct fingerprint's root and least id."""
    held = staged(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = held.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, k, blocks), "a", "b").select(F.col("node").alias("fp"), "root")
    return held, staged(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")


def near_duplicates(docs: DataFrame, words: int = 3, k: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable).

    Texts are lower-cased in A-Z; null and empty texts and those without words share fingerprint
    0; repeated rows stay; null ids join a component and do not name it unless all are null; an
    empty table gives no row.
    """
    held, roots = rooted(docs, words, k, blocks, id_col, text_col)
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.join(named, "root").select("fp", "component_id")
    return held.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, k: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay: of each component the one with the smallest id.

    A null id is smaller than any other; of rows that repeat id and text one stays.
    """
    held, roots = rooted(docs, words, k, blocks, id_col, text_col)
    chosen = held.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("r")).join(roots, "fp").groupBy("root").agg(F.min("r").alias("r")).select("r.id", "r.th")
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    whole = docs.select(F.struct("*").alias("row"), doc_id.alias("id"), F.xxhash64(text).alias("th"))
    first = Window.partitionBy("id", "th").orderBy("id")
    return whole.join(chosen, ["id", "th"], "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")
