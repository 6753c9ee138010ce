"""Packing of token pieces into sequences by dominance reduction and best fit.

A document is its tokens and an end id; longer ones are cut into full pieces behind a first one that
may be shorter. Only lengths matter for packing, so the driver plans on the histogram of lengths
(as many numbers as a sequence has tokens, whatever the input's size): the Martello-Toth reduction
fixes, from the longest down and again until nothing changes, sets of at most three pieces that
dominate every other feasible set with the same piece; what is left is packed best-fit decreasing,
whole runs of equal pieces at a time. The plan lists patterns and how often each occurs. Pieces of a
length are numbered without bringing them together: a row number within (length, salt), where a length
has as many salts as its number of pieces asks for, and an offset for each. Number and length give a
piece's sequence and place.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows are packed
each for itself; a very long text is tokenised whole and cut into as many pieces as it needs; an empty
table gives an empty result. Columns other than doc_id and text are ignored, however they are named.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .exchange import as_batch

CAPACITY = 2048
#: Pieces that are numbered in one group.
GROUP = 1 << 18


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file with ``vocabulary``
    (``.json``), computed from the same vocabulary as ranks (``.tiktoken``), which is faster.

    Texts with a special token's string go to the library itself.
    """

    SPECIAL = "<|endoftext|>"
    #: Fixed value: the pre-tokenisation pattern of this vocabulary.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        self.vocabulary = vocabulary
        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.SPECIAL not in text:
            return array("I", self.ranks.encode_ordinary(text)).tobytes()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


_tokenizers: dict[str, ByteBpe] = {}


def tokenizer(vocabulary: str) -> ByteBpe:
    """One for each Python worker."""
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = ByteBpe(vocabulary)
    return _tokenizers[vocabulary]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; all but the first are full."""
    head = n % capacity or capacity
    return [(0, head)] + [(start, capacity) for start in range(head, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every text."""
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.encode(text.as_py()) + end if text.is_valid else end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(rows, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            yield as_batch(out, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[int, tuple[int, ...]]


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sets of one to three pieces that dominate all other feasible sets with one of them; takes
    them out of ``counts`` (pieces by length) and returns how often which set is fixed. Some optimal
    packing has all of them.

    Let ``mate`` be the largest other piece that still fits beside a piece. The pair dominates every
    other set with that piece if it is full, if no two others fit, or if no two others that fit add up
    to more than the mate while no three fit. If no three fit, the piece, its mate and the largest
    that fits with both dominate where no two pieces longer than that last one fit instead.
    """
    fixed: list[Pattern] = []

    def present() -> np.ndarray:
        return np.flatnonzero(counts)

    def largest(limit: int) -> int:
        known = present()
        at = int(np.searchsorted(known, limit, "right"))
        return int(known[at - 1]) if at else 0

    def smallest(n: int, above: int = 0) -> list[int]:
        """The n smallest lengths above a limit, with repetition."""
        out: list[int] = []
        for length in present():
            if length > above:
                out += [int(length)] * min(int(counts[length]), n - len(out))
                if len(out) == n:
                    break
        return out

    def dominating(length: int) -> tuple[int, ...] | None:
        """With one piece of ``length`` taken out of counts."""
        room = capacity - length
        mate = largest(room)
        fits = int(np.searchsorted(np.cumsum(smallest(3)), room, "right"))
        if not mate:
            return (length,)
        if mate == room or fits == 1:
            return (length, mate)
        if fits > 2:
            return None
        counts[mate] -= 1
        third = largest(room - mate)
        counts[mate] += 1
        known, n = present(), counts
        firsts = known[known <= room]
        partner = np.searchsorted(known, room - firsts, "right") - 1
        seconds = np.where(partner >= 0, known[np.maximum(partner, 0)], 0)
        lone = (seconds == firsts) & (n[firsts] < 2)
        lower = np.maximum(partner - 1, 0)
        seconds = np.where(lone, np.where(partner > 0, known[lower], 0), seconds)
        if mate >= int(np.where(seconds > 0, firsts + seconds, 0).max(initial=0)):
            return (length, mate)
        if third:
            counts[mate] -= 1
            counts[third] -= 1
            longer = smallest(2, third)
            counts[mate] += 1
            counts[third] += 1
            if len(longer) < 2 or sum(longer) > room:
                return (length, mate, third)
        return None

    changed = True
    while changed:
        changed = False
        for length in range(capacity, 0, -1):
            while counts[length] > 0:
                counts[length] -= 1
                lengths = dominating(length)
                counts[length] += 1
                if lengths is None:
                    break
                # the set dominates as long as there are pieces for it
                need = {x: lengths.count(x) for x in lengths}
                times = min(int(counts[x]) // k for x, k in need.items())
                fixed.append((times, lengths))
                for x, k in need.items():
                    counts[x] -= times * k
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over runs of equal pieces."""
    bins: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        room = length
        while left:
            while room <= capacity and not bins[room]:
                room += 1
            if room <= capacity:
                times, inside = bins[room].pop()
                used = min(left, times)
                if times > used:
                    bins[room].append((times - used, inside))
                bins[room - length].append((used, (*inside, length)))
                left -= used
                room = min(room, max(length, room - length)) if room - length >= length else room
                continue
            each = capacity // length
            if left >= each:
                bins[capacity - each * length].append((left // each, (length,) * each))
            if left % each:
                bins[capacity - left % each * length].append((1, (length,) * (left % each)))
            left = 0
    return [p for group in bins for p in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Slots in the order of their key (length, first piece number): sequence of the first and
    place in it."""
    counts = counts.copy()
    patterns = reduce_by_dominance(counts, capacity)
    patterns += best_fit(counts, capacity)
    taken = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int]] = []
    sequence = 0
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append(((length << 44) + int(taken[length]), sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows.sort()
    key, first, offset = np.array(rows, np.int64).reshape(-1, 3).T.copy()
    return {"key": key, "sequence": first, "offset": offset}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its sequence and its place there."""
    cut_up = scratch.save(pieces(docs, vocabulary, capacity))
    # capacity rows at most
    total = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    salts = np.array([-(-total.get(k, 0) // GROUP) or 1 for k in range(capacity + 1)], np.int64)
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(F.from_json(F.lit(str(salts.tolist())), "array<bigint>"), F.col("length").cast("int"))).cast("int"))
    # a row for each GROUP pieces, and capacity more
    first = np.cumsum(salts) - salts
    by = np.zeros(int(salts.sum()), np.int64)
    for row in salted.groupBy("length", "salt").count().collect():
        by[first[row["length"]] + row["salt"]] = row["count"]
    counts = np.add.reduceat(by, first)
    slots = plan(counts, capacity)
    before = np.cumsum(by) - by
    before -= np.repeat(before[first], salts)
    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, number = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5, 6))
            key = (length << 44) + number - 1 + before[first[length] + salt]
            at = np.searchsorted(slots["key"], key, "right") - 1
            yield as_batch(out, [*b.columns[:5], slots["sequence"][at] + key - slots["key"][at], slots["offset"][at]])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
