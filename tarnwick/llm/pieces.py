"""Offset-preserving SentencePiece encoding and decoding.

Normalisation applies the model's compiled character map by longest prefix and records, for every
byte that it makes, the source byte it came from; each piece is projected over that alignment to a
span of the original bytes. The map's trie is walked from all places of a text at once, a byte deeper
each step, by those places only that still have a prefix in it.

Segmentation itself, and decoding, are the library's, over whole texts.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded alike; a very long
text is encoded whole; an empty table gives an empty result; other columns are ignored, however they are
named; of a character that becomes several byte pieces, the last one has its span and the others are
empty. A model whose map is empty only has its blanks normalised.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import as_batch

SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised protocol buffer."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: a double-array trie, then the zero-ended replacements."""

    def __init__(self, compiled: bytes) -> None:
        self.units, self.strings = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, "<u4", size // 4, 4)
            self.strings = np.frombuffer(compiled, np.uint8, offset=4 + size)
        self.ends = np.flatnonzero(self.strings == 0)

    @staticmethod
    def _children(unit: np.ndarray) -> np.ndarray:
        return (unit >> np.uint32(10)) << ((unit & np.uint32(512)) >> np.uint32(6))

    def longest(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place: the length of the longest key that ``data`` has there (0: none) and where
        in ``strings`` its replacement begins."""
        size, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive = np.arange(len(at) if len(self.units) else 0)
        node = np.repeat(self._children(self.units[:1]), len(alive))
        depth = 0
        while len(alive):
            inside = at[alive] + depth < len(data)
            alive, node = alive[inside], node[inside]
            byte = data[at[alive] + depth].astype(np.uint32)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            on = (node < len(self.units)) & ((unit & np.uint32(0x800000FF)) == byte)
            alive, unit = alive[on], unit[on]
            node = node[on] ^ self._children(unit)
            depth += 1
            leaf = (unit & np.uint32(256)) > 0
            size[alive[leaf]] = depth
            value[alive[leaf]] = self.units[node[leaf]] & np.uint32(0x7FFFFFFF)
        return size, value

    def lengths(self, value: np.ndarray) -> np.ndarray:
        """Bytes of the replacements that begin at ``value``."""
        return self.ends[np.searchsorted(self.ends, value)] - value


class Normaliser:
    """What a model's normaliser does to a text, with the source of every byte it makes."""

    def __init__(self, model: bytes) -> None:
        spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))

    def _entries(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Characters and keys of the map from left to right: where each begins and ends in the text,
        and where and how long what it becomes is, in the text with the map's strings behind."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        size, value = self.map.longest(data, at)
        hit = np.flatnonzero(size)
        ends = np.append(at[1:], len(data))
        if not len(hit):
            return at, ends, at, ends - at
        begin, reach = at[hit], at[hit] + size[hit]
        if (begin[1:] < reach[:-1]).any():  # a key that an earlier one covers doesn't count
            taken, over = [], 0
            for k, (b, e) in enumerate(zip(begin.tolist(), reach.tolist(), strict=True)):
                if b >= over:
                    taken.append(k)
                    over = e
            hit, begin, reach = hit[taken], begin[taken], reach[taken]
        last = np.searchsorted(begin, at, "right") - 1
        covered = (last >= 0) & (at < reach[np.maximum(last, 0)])
        covered[hit] = False
        ends[hit] = reach
        source, length = at.copy(), ends - at
        source[hit] = len(data) + value[hit]
        length[hit] = self.map.lengths(value[hit])
        return at[~covered], ends[~covered], source[~covered], length[~covered]

    def align(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each the original offset it stems from; one entry more
        marks the end."""
        data = np.frombuffer(text.encode(), np.uint8)
        begin, end, source, length = self._entries(data)
        before = np.cumsum(length) - length
        entry = np.repeat(np.arange(len(length)), length)
        made = np.concatenate([data, self.map.strings])[source[entry] + np.arange(len(entry)) - before[entry]]
        stem = begin[entry]
        finish = int(end[-1]) if len(end) else 0
        blank = made == 32
        if self.squeeze and len(made):
            inked = np.cumsum(~blank)
            first = before[entry]
            behind = np.concatenate([[True], blank[:-1]])
            # the leading blanks of an entry go where a blank, or nothing, is before
            keep = ~(blank & (inked == np.where(first > 0, inked[first - 1], 0)) & behind[first])
            last = int(inked[-1]) and int(np.flatnonzero(~blank)[-1]) + 1
            tail = np.flatnonzero(keep[last:])
            if len(tail):
                finish = int(stem[last + tail[0]])
            keep[last:] = False
            made, stem, blank = made[keep], stem[keep], blank[keep]
        # a text of which nothing is left still has the blank that goes before it, unless blanks are squeezed
        if self.prefix and (len(made) or (len(data) and not self.squeeze)):
            made, stem, blank = np.append(np.uint8(32), made), np.append(stem[:1] if len(stem) else 0, stem), np.append(True, blank)
        if self.escape:
            times = np.where(blank, len(SPACE.encode()), 1)
            made, stem = np.repeat(made, times), np.repeat(stem, times)
            places = (np.cumsum(times) - times)[blank]
            for k, byte in enumerate(SPACE.encode()):
                made[places + k] = byte
        return made.tobytes(), np.append(stem, finish)


class Encoder:
    """Ids, their original byte spans and the decoded text of whole texts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normaliser = Normaliser(model)
        names = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.bytes_of = np.array([1 if self.lib.is_byte(i) else len(s.encode()) for i, s in enumerate(names)], np.int64)
        self.unknown = self.lib.unk_id()

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Where each piece ends in the original bytes."""
        normal, source = self.normaliser.align(text)
        length = self.bytes_of[ids]
        if self.unknown in ids:
            # what an unknown piece covers isn't its name
            length = np.array([1 if self.lib.is_byte(p.id) else len(p.piece.encode()) for p in self.lib.encode(text, return_type="proto").pieces], np.int64)
        ends = np.cumsum(length)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("this model's normaliser does more than its character map says")
        return source[ends]

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """Number of ids, SHA-256 of the ids in decimal and of the decoded text, and the CRC of
        all pieces' ends in the original bytes (64-bit little-endian)."""
        ids = self.lib.encode(text)
        ends = self.spans(text, np.array(ids, np.int64))
        decimal, decoded = str(ids)[1:-1].replace(" ", ""), self.lib.decode(ids) if ids else ""
        return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), zlib.crc32(ends.astype("<i8").tobytes())

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """Each piece's id and its span of original bytes."""
        ids = self.lib.encode(text)
        ends = self.spans(text, np.array(ids, np.int64)).tolist()
        return list(zip(ids, [0, *ends[:-1]], ends, strict=False))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_spans(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and pieces (array of id, start, end in original bytes) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"id": i, "start": a, "end": b} for i, a, b in own.encode(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "pieces"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pieces array<struct<id:int,start:bigint,end:bigint>>")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 for each row of ``docs``."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            n, ids, decoded, crc = [], [], [], []
            for text in batch.column(1):
                for column, value in zip((n, ids, decoded, crc), own.digest(text.as_py() or ""), strict=True):
                    column.append(value)
            yield as_batch(out, [batch.column(0), n, ids, decoded, crc])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
