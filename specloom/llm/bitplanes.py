"""Token ids in a binary format of byte or bit planes.

A part holds the documents of one range of ids, in ascending order. It is a row of chunks; a chunk
holds whole documents, cut into blocks of a fixed number of ids. Each block is transposed into
planes (all first bytes, all second bytes, ... or all lowest bits, ...), each plane is a zstandard
frame, and the chunk's index keeps the frame sizes, the documents' ids and their lengths.
Chunks are rows of a Parquet table, so Spark commits them and a lost task writes them anew.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rows, id_and_text, shuffle_partitions, staged, texts
from .wordwise import tokenizer

CHUNKS = "part int, chunk int, first long, n_ids long, sizes array<int>, payload binary, doc_ids array<long>, doc_lengths array<long>"
CHUNK_ROWS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("sizes", pa.list_(pa.int32())), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])


def shuffle_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of a block of unsigned 32-bit ids."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in cells.T]
    return [np.packbits(p).tobytes() for p in np.unpackbits(cells, axis=1, bitorder="little").T]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The block back from its planes."""
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], 1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def pack(ids: np.ndarray, block_ids: int, bits: bool, level: int = 3) -> tuple[list[int], bytes]:
    """Frame sizes and frames of a run of ids."""
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(p) for at in range(0, len(ids), block_ids) for p in shuffle_planes(ids[at : at + block_ids], bits)]
    return [len(f) for f in frames], b"".join(frames)


def unpack(sizes: list[int], payload: bytes, n_ids: int, block_ids: int, bits: bool) -> np.ndarray:
    unpress, at, planes = zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        planes.append(unpress.decompress(payload[at : at + size]))
        at += size
    each = 32 if bits else 4
    blocks = [join_planes(planes[k : k + each], min(block_ids, n_ids - k // each * block_ids)) for k in range(0, len(planes), each)]
    return np.concatenate(blocks) if blocks else np.empty(0, "<u4")


def encode_chunks(docs: DataFrame, vocabulary: str, end_id: int = 2, block_ids: int = 65_536, chunk_ids: int = 262_144, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of all documents in ascending id order (nulls first, ties by text).

    A null or empty text is the end id alone; repeated rows count each; an empty table has no
    chunk. A chunk closes at the first document end at or after ``chunk_ids`` ids.
    """
    kept = id_and_text(docs, id_col, text_col)
    ordered = kept.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        part, t, out = TaskContext.get().partitionId(), tokenizer(vocabulary), Rows(CHUNK_ROWS, 1)
        chunk = first = size = 0
        pieces, doc_ids, lengths = [], [], []

        def close():
            sizes, payload = pack(np.frombuffer(b"".join(pieces), "<u4"), block_ids, bits)
            return out.add(part, chunk, first, size, sizes, payload, doc_ids, lengths)

        for doc_id, text in texts(batches):
            ids = t.encode(text.decode()) + end
            pieces.append(ids)
            doc_ids.append(doc_id)
            lengths.append(len(ids) // 4)
            size += len(ids) // 4
            if size >= chunk_ids:
                yield from close()
                chunk, first, size, pieces, doc_ids, lengths = chunk + 1, first + size, 0, [], [], []
        if doc_ids:
            yield from close()

    return ordered.mapInArrow(encode, CHUNKS)


def read_chunks(chunks: DataFrame, block_ids: int = 65_536, bits: bool = False) -> DataFrame:
    """Documents back from their chunks: doc_id, start, n_tokens, ids_crc32, and the ids as bytes' checksum only.

    ``start`` is the number of ids in all documents before. Only one total a part is gathered.
    """

    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        out = Rows(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ids, at = memoryview(unpack(r["sizes"], r["payload"], r["n_ids"], block_ids, bits).tobytes()), 0
                for doc_id, n in zip(r["doc_ids"], r["doc_lengths"], strict=True):
                    yield from out.add(r["part"], doc_id, r["first"] + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    at += n
        yield from out.flush()

    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = chunks.mapInArrow(decode, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # one row a part, at most as many as shuffle partitions
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """Write the chunks to the shared folder and return them as read from there."""
    return staged(encode_chunks(docs, vocabulary, **how), "token-planes")
