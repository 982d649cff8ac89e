"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraphs.

Each paragraph's 64-bit digest goes into three cells of a small table (a count and the XOR of its
digests). Two versions' tables subtract cell by cell; what both hold cancels, and peeling single
digests from the rest gives back exactly the paragraphs that differ. If a table is too small for
the difference, peeling stalls and both are built anew at twice the size.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, Rows, id_and_text, shuffle_partitions, texts

BASE_CELLS = 24  # three parts of eight
PARAGRAPH = re.compile(r"\n+|(?<=[.!?])\s+")
RUN = re.compile(r"\S+(?:\s+\S+){0,11}")


def paragraphs(text: str) -> list[str]:
    """Lines, cut after sentences and into runs of at most twelve words; blank ones are left out."""
    return [r for p in PARAGRAPH.split(text) for r in (RUN.findall(p) if len(p) > 60 else (p.strip(),)) if r]


def digests(text: str) -> list[int]:
    """One digest a paragraph; the n-th copy of a paragraph has its own. The low 16 bits check the rest."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        n = seen[p] = seen.get(p, -1) + 1
        high = xxhash.xxh64_intdigest(p, n) >> 16
        out.append(high << 16 | check(high))
    return out


def check(high: int) -> int:
    """Two products with a shift between, so that the XOR of some digests hardly ever checks as one."""
    mixed = high * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return ((mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 >> 40) & 0xFFFF


def sketch(keys: list[int], cells: int) -> tuple[list[int], list[int]]:
    """Counts and XORed digests; each digest sits in one cell of each third."""
    part = cells // 3
    counts, sums = [0] * cells, [0] * cells
    for key in keys:
        for i in ((key >> 16) % part, (key >> 29) % part + part, (key >> 43) % part + 2 * part):
            counts[i] += 1
            sums[i] ^= key
    return counts, sums


def peel(one: tuple[list[int], list[int]], other: tuple[list[int], list[int]]) -> tuple[set[int], set[int]] | None:
    """Digests only in one and only in the other; None if the tables are too small to tell."""
    counts = [a - b for a, b in zip(one[0], other[0], strict=True)]
    sums = [a ^ b for a, b in zip(one[1], other[1], strict=True)]
    part, left, right = len(counts) // 3, set(), set()
    ready = [i for i, c in enumerate(counts) if c in (1, -1)]
    while ready:
        i = ready.pop()
        sign, key = counts[i], sums[i]
        if sign not in (1, -1) or check(key >> 16) != key & 0xFFFF:
            continue
        side = left if sign == 1 else right
        if key in side:
            return None
        side.add(key)
        for j in ((key >> 16) % part, (key >> 29) % part + part, (key >> 43) % part + 2 * part):
            counts[j] -= sign
            sums[j] ^= key
            if counts[j] in (1, -1):
                ready.append(j)
    return None if any(counts) or any(sums) else (left, right)


def sizes(n: int) -> list[int]:
    """Table sizes to try for two texts of n paragraphs in all: small, larger, one that takes even
    texts without a common paragraph, then that doubled again and again."""
    full = 8 * BASE_CELLS
    while full < 1.5 * n:
        full *= 2
    return [BASE_CELLS, 4 * BASE_CELLS, *(full << k for k in range(6))]


def difference(one: list[int], other: list[int], base: tuple | None = None) -> tuple[set[int], set[int]]:
    """Peel at growing sizes; digests that collide for good fall back to the sets themselves.

    ``base``: both tables of the first size, if they are at hand.
    """
    for cells in sizes(len(one) + len(other)):
        tables = base if base and cells == BASE_CELLS else (sketch(one, cells), sketch(other, cells))
        if (found := peel(*tables)) is not None:
            return found
    return set(one) - set(other), set(other) - set(one)


def likeness(one: list[int], other: list[int], base: tuple | None = None) -> float:
    """Shared paragraphs over all paragraphs of both; 1 if neither has any."""
    only_one, only_other = difference(one, other, base)
    shared = len(one) - len(only_one)
    total = shared + len(only_one) + len(only_other)
    return shared / total if total else 1.0


def shown(n: int, table: tuple[list[int], list[int]]) -> str:
    """The base table as text: the number of paragraphs, then each cell's count (mod 256) and digest sum."""
    return f"{n:x}-" + struct.pack(f"<{BASE_CELLS}B{BASE_CELLS}Q", *(c & 255 for c in table[0]), *table[1]).hex()


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RESULT_ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

def ordered_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Compressed texts in runs of ascending ids; each run ends with the next run's first document.

    Runs start at ids that are quantiles of all ids, so the row that two runs share is known
    before any is sorted. Nulls come first; rows with the same id are in order of their
    compressed bytes, which holds within a run but may differ between versions of zstandard.
    """
    spark, kept = docs.sparkSession, id_and_text(docs, id_col, text_col)
    key = F.coalesce("doc_id", F.lit(LOWEST))
    n = shuffle_partitions(spark)
    cuts = kept.select(key.alias("k")).agg(F.min("k").alias("least"), F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n).alias("cuts") if n > 1 else F.array().cast("array<long>").alias("cuts")).first()
    starts = sorted({cuts["least"], *(cuts["cuts"] or ())} - {None})
    rows_of = pa.schema([("run", pa.int32()), ("after", pa.int8()), ("key", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def deal(batches):
        out, press = Rows(rows_of), zstandard.ZstdCompressor(level=1)
        for doc_id, text in texts(batches):
            k, packed = LOWEST if doc_id is None else doc_id, press.compress(text)
            at = bisect_left(starts, k)
            first = at < len(starts) and starts[at] == k
            yield from out.add(at if first else at - 1, 0, k, doc_id, packed, weight=len(packed))
            if first:  # also the row after the run before; the first of all comes after the last
                yield from out.add(at - 1 if at else len(starts) - 1, 1, k, doc_id, packed, weight=len(packed))
        yield from out.flush()

    dealt = kept.mapInArrow(deal, "run int, after byte, key long, doc_id long, packed binary")
    return dealt.repartition(n, "run").sortWithinPartitions("run", "after", "key", "packed")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like its neighbours it is.

    The edited text has the last quarter of its code points replaced by the first as many (or all)
    of the next document's. A null text is empty; the last document's next is the first; a single
    document's is itself; repeated rows each count, one after the other; an empty table gives no row.
    """

    def run(batches):
        out, unpress = Rows(RESULT_ROWS), zstandard.ZstdDecompressor()
        held = None  # run, id, text, digests and base table of the row whose next is still to come

        def told(own, following):
            _, doc_id, text, keys, table = own
            replaced = len(text) // 4
            edited = text[: len(text) - replaced] + following[2][:replaced]
            edited_keys = digests(edited)
            edited_table = sketch(edited_keys, BASE_CELLS)
            return (
                doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(len(keys), table), shown(len(edited_keys), edited_table),
                likeness(keys, edited_keys, (table, edited_table)), likeness(keys, following[3], (table, following[4])),
            )

        for batch in batches:
            names = [batch.column(batch.schema.get_field_index(c)) for c in ("run", "after", "doc_id", "packed")]
            for k in range(batch.num_rows):
                at, after, doc_id = (c[k].as_py() for c in names[:3])
                if after and (held is None or held[0] != at):
                    continue  # a further copy of the row after the run
                text = unpress.decompress(names[3][k].as_py()).decode()
                keys = digests(text)
                row = (at, doc_id, text, keys, sketch(keys, BASE_CELLS))
                if held is not None:
                    yield from out.add(*told(held, row), weight=600)
                held = None if after else row
        yield from out.flush()

    return ordered_runs(docs, id_col, text_col).mapInArrow(run, RESULT)

