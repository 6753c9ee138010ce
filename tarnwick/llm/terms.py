"""Terms of whole texts: maximal runs of some bytes, folded, as an Arrow dictionary (exact, not hashed)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textkit as tk


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which of the 256 bytes belong to a term."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Letters, and letters with digits; every byte of a character beyond ASCII counts.
LETTERS = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
LETTERS_AND_DIGITS = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 0x20


def _edges(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are in terms, where terms begin and where they end; none goes on into the next text."""
    inside = member[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return inside, np.flatnonzero(first), np.flatnonzero(last) + 1


def count_terms(column: pa.Array, member: np.ndarray) -> np.ndarray:
    """How many terms each text has; null has none."""
    raw, offsets = tk.text_bytes(column)
    _, start, _ = _edges(raw, offsets, member)
    return np.diff(np.searchsorted(start, offsets))


class Terms(NamedTuple):
    """The distinct terms in the order of their bytes, and one entry for each text and term of it:
    the text's number, the term's number, its occurrences; sorted by text, then term."""

    names: pa.Array
    text: np.ndarray
    term: np.ndarray
    count: np.ndarray


def terms_of(column: pa.Array, member: np.ndarray) -> Terms:
    raw, offsets = tk.text_bytes(column)
    inside, start, end = _edges(raw, offsets, member)
    places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    data = _FOLDED[raw[inside]]
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data)])
    coded = each.dictionary_encode()
    known = coded.dictionary
    order = pc.array_sort_indices(known).to_numpy()
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    number = place[coded.indices.to_numpy().astype(np.int64)] if len(known) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, start, "right") - 1
    pairs, count = np.unique(text * max(len(known), 1) + number, return_counts=True)
    return Terms(known.take(pa.array(order)), pairs // max(len(known), 1), pairs % max(len(known), 1), count.astype(np.int64))


def strings(names: pa.Array) -> pa.Array:
    """Terms as strings. They are cut between characters, as no byte beyond ASCII separates."""
    return names.cast(pa.binary()).cast(pa.string())


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts have ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.fill_null(pc.binary_length(batch.column(column)), 0)).as_py()
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
