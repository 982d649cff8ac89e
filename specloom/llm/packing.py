"""Best-fit packing planned on the histogram of lengths.

Documents are encoded and cut into pieces; only the number of pieces of each length (as many rows
as a sequence has tokens) reaches the driver, where best-fit decreasing runs on counts: a batch of
equal pieces goes into a run of equally filled sequences at once. Pieces take their planned places
by their rank among the pieces of their length. Ranks are counted inside each encoding task and
shifted by the counts of the tasks before, so a length that most pieces share meets nowhere.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, id_and_text, staged, texts
from .wordwise import tokenizer

PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long"
PIECE_ROWS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("rank", pa.int64())])
BATCH = "array<struct<first: long, n: long, each: long, sequence: long, at: long>>"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of each piece; what doesn't fill a sequence comes first."""
    first = n % most or min(n, most)
    return [(0, first), *((s, most) for s in range(first, n, most))] if n else []


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Batches (length, first rank, pieces, pieces a sequence, first sequence, offset in it).

    Lengths go from long to short; each piece goes to the fullest sequence that still takes it.
    Sequences with equal room are held as runs, so the work depends on lengths, not on pieces.
    """
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, how many)
    batches, made = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity + 1) if open_runs[r]), None)
            if room is None:
                room, run = capacity, (made, -(-left // (capacity // length)))
                made += run[1]
            else:
                run = open_runs[room].pop()
            each = min(room // length, left)
            filled = min(run[1], left // each)
            batches.append((length, rank, filled * each, each, run[0], capacity - room))
            if filled < run[1]:
                open_runs[room].append((run[0] + filled, run[1] - filled))
            if room > each * length:
                open_runs[room - each * length].append((run[0], filled))
            rank, left = rank + filled * each, left - filled * each
    return batches


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded pieces with their rank within length and task. A null or empty text is the end id alone."""
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        part, t, out, seen = TaskContext.get().partitionId(), tokenizer(vocabulary), Rows(PIECE_ROWS), [0] * (capacity + 1)
        for doc_id, text in texts(batches):
            ids = memoryview(t.encode(text.decode()) + end)
            for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                yield from out.add(part, doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), seen[n])
                seen[n] += 1
        yield from out.flush()

    return id_and_text(docs, id_col, text_col).mapInArrow(encode, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece in its place.

    Repeated rows are packed each; null ids pass through; an empty table gives no row.
    """
    spark = docs.sparkSession
    held = staged(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    counts = held.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # a row a length
    by_length: dict[int, list] = {}
    for length, *batch in plan(histogram, capacity):
        by_length.setdefault(length, []).append(tuple(batch))
    planned = spark.createDataFrame(list(by_length.items()), f"length int, batches {BATCH}")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    ranked = held.join(shifts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    placed = ranked.join(F.broadcast(planned), "length").withColumn(
        "b", F.filter("batches", lambda b: (b["first"] <= F.col("rank")) & (F.col("rank") < b["first"] + b["n"]))[0]
    )
    nth = F.col("rank") - F.col("b.first")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("b.sequence") + F.expr("(rank - b.first) div b.each")).alias("sequence_id"),
        (F.col("b.at") + nth % F.col("b.each") * F.col("length")).alias("offset"),
    )
