"""Rows of fixed-width numbers exchanged as compressed column blocks.

A mapper packs what it has for one route into a block (a byte string), so a shuffle moves a few
rows for each mapper and route rather than millions of small ones. The number of routes follows
the input's size, hence so does the number of groups; a group holds a bounded share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

_MAGIC = 4


def pack(columns: list[np.ndarray]) -> bytes:
    """Equally long arrays as one compressed byte string, byte planes one after another. Signed
    integers are stored as differences; those that are mostly near their neighbours cost a byte or
    two each. Unsigned ones are stored as they are."""
    n = len(columns[0])
    parts = []
    for c in columns:
        if c.dtype in (np.int64, np.int32):
            c = np.diff(c, prepend=c.dtype.type(0))
            parts.append(c.view(np.uint8).reshape(n, c.itemsize).T.tobytes())
        elif c.dtype in (np.uint64, np.uint32):
            parts.append(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.itemsize).T.tobytes())
        else:
            parts.append(c.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes, dtypes: list[type]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    width = sum(np.dtype(t).itemsize for t in dtypes)
    n = len(data) // width
    out, at = [], 0
    for t in dtypes:
        size = np.dtype(t).itemsize
        part = np.frombuffer(data, np.uint8, n * size, at)
        at += n * size
        if np.dtype(t) in (np.int64, np.int32):
            out.append(np.cumsum(part.reshape(size, n).T.copy().view(t).reshape(n), dtype=t))
        elif np.dtype(t) in (np.uint64, np.uint32):
            out.append(part.reshape(size, n).T.copy().view(t).reshape(n))
        else:
            out.append(part.view(t))
    return out


def unpack_all(blocks: Iterator[bytes], dtypes: list[type]) -> list[np.ndarray]:
    each = [unpack(b, dtypes) for b in blocks]
    return [np.concatenate(c) for c in zip(*each, strict=True)] if each else [np.zeros(0, t) for t in dtypes]


def deal(route: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' rows by route, in their old order within a route."""
    order = np.argsort(route, kind="stable")
    route = route[order]
    cuts = np.flatnonzero(np.diff(route)) + 1
    columns = [c[order] for c in columns]
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(route)]]), strict=True):
        if b > a:
            yield int(route[a]), [c[a:b] for c in columns]


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def routes_for(size: int, each: int) -> int:
    """Routes such that about ``each`` input bytes fall to one."""
    return int(min(max(1, -(-size // each)), (1 << 31) - 1))


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
