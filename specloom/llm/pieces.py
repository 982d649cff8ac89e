"""SentencePiece encoding that keeps, for every piece, its byte span in the original text.

The model's compiled character map (a double-array trie with replacement strings) is walked by
longest prefix; every normalised byte remembers which original byte it came from. The library
encodes; its pieces' lengths in normalised bytes are then projected through that alignment.
Texts are cut at single spaces, where no piece of the vocabulary joins two sides (checked when the
model is loaded), and each distinct stretch is encoded once a worker.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import id_and_text, texts
from .wordwise import Known

SPACE = "▁".encode()


class CharacterMap:
    """Longest-prefix replacement by a compiled map; with an empty map, characters stay as they are."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest mapped prefix at a place."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._children(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            unit = units[node]
            node ^= self._children(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]

    @staticmethod
    def _children(unit: int) -> int:
        return unit >> 10 << (unit >> 6 & 8)


class OffsetEncoder:
    """Ids, spans and decoded text of one SentencePiece model, without begin and end ids."""

    def __init__(self, source: str | bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=source) if isinstance(source, bytes) else sentencepiece.SentencePieceProcessor(model_file=source)
        model = proto.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        how = model.normalizer_spec
        self.map, self.prefix, self.squeeze, self.escape = CharacterMap(how.precompiled_charsmap), how.add_dummy_prefix, how.remove_extra_whitespaces, how.escape_whitespaces
        kinds = proto.ModelProto.SentencePiece
        bytewise = [p.type == kinds.BYTE for p in model.pieces]
        own = [b"" if p.type == kinds.CONTROL else p.piece.encode() for p in model.pieces]
        self.unknown = model.trainer_spec.unk_id
        #: Normalised and original bytes of each piece.
        self.norm_bytes = np.array([1 if b else len(p) for b, p in zip(bytewise, own, strict=True)], np.int32)
        self.orig_bytes = np.array([1 if b else len(p.replace(SPACE, b" ")) for b, p in zip(bytewise, own, strict=True)], np.int32)
        inner = any(p.replace(SPACE, b"") and SPACE in p[len(SPACE) :] and not set(p[: p.rindex(SPACE)].split(SPACE)) <= {b""} for p in own)
        typed = any(p.type == kinds.USER_DEFINED for p in model.pieces)
        self.wordwise = not (how.precompiled_charsmap or self.squeeze or inner or typed) and self.prefix and self.escape and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
        self.known = Known(self._stretch)

    def normalise(self, text: bytes) -> tuple[bytes, list[int]]:
        """Normalised bytes and, for each and the end, the original place it came from."""
        out, origin, at, n = bytearray(), [], 0, len(text)
        space = SPACE if self.escape else b" "

        def piece(at: int) -> tuple[bytes, int]:
            if (found := self.map.longest(text, at)) is not None:
                return found
            width = 1 if text[at] < 0xC0 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            return text[at : at + width], width

        if self.squeeze:
            while at < n and (p := piece(at))[0].strip(b" ") == b"":
                at += p[1]
        if at == n:
            return b"", [0]
        if self.prefix:
            out += space
            origin += [at] * len(space)
        after_space = self.squeeze
        while at < n:
            shown, width = piece(at)
            if after_space:
                shown = shown.lstrip(b" ")
            for k in range(len(shown)):
                byte = space if shown[k : k + 1] == b" " else shown[k : k + 1]
                out += byte
                origin += [at] * len(byte)
            if shown:
                after_space = self.squeeze and shown.endswith(b" ")
            at += width
        end = n
        if self.squeeze:
            while out.endswith(space):
                end = origin[len(out) - len(space)]
                del out[-len(space) :], origin[-len(space) :]
        return bytes(out), [*origin, end]

    def _stretch(self, text: str) -> bytes:
        return np.array(self.sp.encode(text), "<i4").tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the original byte span of each: begins and ends."""
        if self.wordwise and "  " not in text and "▁" not in text and text[:1] != " " and text[-1:] != " ":
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, text.split(" "))) if text else b"", "<i4")
            if not (ids == self.unknown).any():
                ends = np.cumsum(self.orig_bytes[ids]) - 1  # the first piece's space is the model's own
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                return ids, begins, np.maximum(ends, 0)
        ids = np.array(self.sp.encode(text), "<i4")
        normal, origin = self.normalise(text.encode())
        widths = self.norm_bytes[ids].astype(np.int64)
        if (ids == self.unknown).any():
            widths = np.array([len(p.surface.encode()) if i == self.unknown else w for p, i, w in zip(self.sp.encode(text, return_type="proto").pieces, ids, widths, strict=True)], np.int64)
        stops = np.cumsum(widths)
        if len(ids) and stops[-1] != len(normal):
            raise ValueError("the library normalises this text otherwise")
        places = np.array(origin, np.int64)
        return ids, places[np.concatenate(([0], stops[:-1]))] if len(ids) else places[:0], places[stops] if len(ids) else places[:0]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


@lru_cache(2)
def encoder(name: str) -> OffsetEncoder:
    """One per worker process and model."""
    return OffsetEncoder(public_tokenizers.path(name))


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow list array of integer arrays, without Python integers between."""
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, ids, begins, ends: ids and each one's span in the text's UTF-8 bytes.

    A null or empty text has no ids; repeated rows are encoded each; an empty table gives no row.
    A byte piece spans its byte, a piece of replaced characters spans all it came from.
    """

    def run(batches):
        e, held, size = encoder(model), [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), *(lists([h[k] for h in held]) for k in (1, 2, 3))], schema=ENCODED)

        for doc_id, text in texts(batches):
            held.append((doc_id, *e.encode(text.decode())))
            size += len(text) + 64
            if size >= most_bytes:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded: the library's text of each row's ids."""

    def run(batches):
        e = encoder(model)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            for at in range(0, b.num_rows, 256):
                part = ids.slice(at, 256)
                shown = [e.decode(x) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")).slice(at, 256), part, pa.array(shown, pa.string())], schema=DECODED)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
