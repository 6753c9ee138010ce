"""Removal of passages that occur earlier in the corpus, by suffix arrays.

Every byte that a ``LENGTH``-byte string covers which also starts earlier (in a document with a
smaller doc_id, or earlier in the same one) goes; strings are judged on the input.

A suffix array of the whole corpus would shuffle every position several times, some twenty times the
input. So the corpus is first reduced, without loss, to the places where sorting suffixes decides:

1. The least hash among the ``GRAM``-byte strings of a window is the window's anchor; equal windows
   have equal anchors. Neighbouring windows with one anchor form a segment, about four in a hundred
   bytes. Segments are dealt by anchor. One that equals an earlier segment is removed as a whole;
   one whose anchor no other segment has holds no repeated window. What remains are the first of
   several different segments with one anchor: the surroundings of every difference.
2. The bytes of those are dealt by anchor again and each bucket's suffix array is built by a
   difference cover: sampled triples are sorted and named, names are ranked recursively until they
   reach ``LENGTH`` bytes, the remaining suffixes are merged, and neighbours in the order are
   compared over ``LENGTH`` bytes. In each run of equal prefixes all but the earliest are removed.
3. The removed runs meet their texts, dealt by doc_id.

Anchors with many different segments would make one bucket large. A mapper that sees more than
``HOT`` of them marks the anchor; its segments are then not sorted in one place, but each window is
dealt by its own hash (two polynomials of 61 bits with independent bases), after equal ones were
combined, which decides the same.

Texts travel compressed and other rows as column blocks, so that all shuffles together stay below
three times the input. Blocks are groups of bounded size: the number of routes follows the input.

Defined cases: a null text is empty; a text below ``LENGTH`` bytes keeps all; a repeated row is the
same document read twice, so it isn't earlier than itself and gets the same result; a row without
doc_id neither marks nor loses anything; a very long text goes through in pieces that overlap; an empty
table gives an empty result. :func:`dedup` ignores columns other than doc_id and text, however they are
named; :func:`remove_repeats` carries them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from . import textkit as tk
from .exchange import as_batch, deal, pack, routes_for, unpack_all
from .suffix_array import repeated_prefixes

LENGTH = 100
GRAM = 32
HOT = 64
FLUSH = 1 << 18
#: Bytes of segments whose suffixes are sorted at once.
SORTED = 1 << 19

#: What a block holds.
SEGMENTS, SPANS, UNDECIDED, MARKED, TEXT, BYTES, WINDOWS = range(7)

BLOCK = "route int, kind int, doc_id long, head binary, body binary"
_SCHEMA = pa.schema([("route", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("head", pa.binary()), ("body", pa.binary())])
_SEGMENT = [np.int64, np.int32, np.int32, np.uint64, np.uint64]
_SPAN = [np.int64, np.int32, np.int32]
_OPEN = [np.int64, np.int32, np.int32, np.uint64, np.uint8]
_BYTES = [np.int64, np.int32, np.int32, np.uint8]
_WINDOW = [np.int64, np.int32, np.uint64, np.uint64]


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    return as_batch(_SCHEMA, [[r[0] for r in rows], [r[1] for r in rows], [None] * len(rows), [r[2] for r in rows], [r[3] if len(r) > 3 else None for r in rows]])


def route_of(doc: np.ndarray, routes: int) -> np.ndarray:
    return (tk.mix(doc.view(np.uint64) + tk.U64(11)) % tk.U64(routes)).astype(np.int64)


def _deal_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, routes: int) -> Iterator[tuple]:
    """Blocks of removed runs by their documents' routes; touching runs become one."""
    if not len(doc):
        return
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by].astype(np.int64), end[by].astype(np.int64)
    shift = (np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))) << 33
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(doc) - 1]])
    doc, start, end = doc[at], start[at], (reach - shift)[last]
    for route, (d, s, e) in deal(route_of(doc, routes), [doc, start.astype(np.int32), end.astype(np.int32)]):
        yield route, SPANS, pack([d, s, e])


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, start and length of each segment, and hashes of its anchor and of its bytes."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = tk.RangeHash(raw)
    grams = tk.gram_hashes(raw, GRAM.bit_length() - 1)
    least = (grams & tk.U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & tk.U64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[: n - LENGTH + 1] == text[LENGTH - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    owner, a = text[at], anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    start, end = at[first], at[last] + LENGTH
    return owner[first], start - offsets[owner[first]], end - start, grams[a[first]], hashes.of(start, end)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins, of keys already sorted."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _settle(doc: np.ndarray, start: np.ndarray, length: np.ndarray, *keys: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """Rows with equal ``keys``: the earliest of each (sorted by keys, with them), and the others'
    document, start and end. A row with the place of the earliest is the same row read again."""
    by = np.lexsort((start, doc, *keys[::-1]))
    rows = [c[by] for c in (doc, start, length, *keys)]
    new = _runs(*rows[3:])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, int)
    later = (rows[0] != rows[0][lead]) | (rows[1] != rows[1][lead])
    gone = tuple(c[later] for c in (rows[0], rows[1], rows[1] + rows[2]))
    return [c[new] for c in rows], gone


def _find_segments(routes: int):
    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, start, length, anchor, bytes_ = (np.concatenate(c) for c in zip(*parts, strict=True))
        kept, gone = _settle(doc, start.astype(np.int32), length.astype(np.int32), anchor, bytes_)
        out = list(_deal_spans(*gone, routes))
        doc, start, length, anchor, bytes_ = kept
        number = np.cumsum(_runs(anchor)) - 1 if len(anchor) else np.zeros(0, int)
        hot = (np.bincount(number) > HOT)[number] if len(number) else np.zeros(0, bool)
        if hot.any():
            marked = np.unique(anchor[hot])
            out += [(r, MARKED, pack(c)) for r, c in deal((marked % tk.U64(routes)).astype(np.int64), [marked])]
            out += [(r, UNDECIDED, pack(c)) for r, c in deal(route_of(doc[hot], routes), [doc[hot], start[hot], length[hot], anchor[hot], np.ones(hot.sum(), np.uint8)])]
        by = np.lexsort((start[~hot], doc[~hot]))
        cold = [c[~hot][by] for c in (doc, start, length, anchor, bytes_)]
        out += [(r, SEGMENTS, pack(c)) for r, c in deal((cold[3] % tk.U64(routes)).astype(np.int64), cold)]
        return _blocks(out)

    @tk.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for whole in batches:
            for part in tk.split_by_bytes(whole, 1):
                text, start, length, anchor, bytes_ = segments(*tk.text_bytes(part.column(1)))
                parts.append((part.column(0).to_numpy(zero_copy_only=False)[text], start, length, anchor, bytes_))
                held += len(text)
                if held >= FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_blocks(rows)], _SCHEMA)


def _by_kind(group: pa.Table, kind: int) -> list[tuple[bytes, bytes]]:
    kinds = group.column("kind").to_numpy()
    heads, bodies = group.column("head"), group.column("body")
    return [(heads[int(i)].as_py(), bodies[int(i)].as_py()) for i in np.flatnonzero(kinds == kind)]


def _decide_segments(routes: int):
    """Per anchor: which segments are removed, and which only their suffixes can decide."""

    @tk.trimmed
    def run(group: pa.Table) -> pa.Table:
        out = [(group.column("route")[0].as_py(), kind, head) for kind in (SPANS, UNDECIDED) for head, _ in _by_kind(group, kind)]
        columns = unpack_all((h for h, _ in _by_kind(group, SEGMENTS)), _SEGMENT)
        kept, gone = _settle(*columns)
        out += _deal_spans(*gone, routes)
        doc, start, length, anchor, _ = kept
        if len(doc):
            (marked,) = unpack_all((h for h, _ in _by_kind(group, MARKED)), [np.uint64])
            number = np.cumsum(_runs(anchor)) - 1
            several = np.bincount(number)
            hot = np.isin(anchor, marked) | (several > 16 * HOT)[number]
            open_ = (several > 1)[number] | hot
            rows = [c[open_] for c in (doc, start, length, anchor, hot.astype(np.uint8))]
            by = np.lexsort((rows[1], rows[0]))
            rows = [c[by] for c in rows]
            out += [(r, UNDECIDED, pack(c)) for r, c in deal(route_of(rows[0], routes), rows)]
        return _table(out)

    return run


def _part(anchor: np.ndarray) -> np.ndarray:
    """One of 256 parts of a bucket, which all segments of an anchor are in."""
    return (tk.mix(anchor) >> tk.U64(56)).astype(np.uint8)


def _fetch_bytes(routes: int):
    """Per document: the bytes of undecided segments by anchor, or their windows' hashes."""

    @tk.trimmed
    def run(group: pa.Table) -> pa.Table:
        doc, start, length, anchor, hot = unpack_all((h for h, _ in _by_kind(group, UNDECIDED)), _OPEN)
        out: list[tuple] = []
        if not len(doc):
            return _table(out)
        wanted = np.unique(doc)
        kinds, ids, bodies = group.column("kind").to_numpy(), group.column("doc_id"), group.column("body")
        unpacker = zstandard.ZstdDecompressor()
        texts: dict[int, bytes] = {}
        asked = set(wanted.tolist())
        for i in np.flatnonzero(kinds == TEXT):
            if (d := ids[int(i)].as_py()) in asked:
                texts.setdefault(d, unpacker.decompress(bodies[int(i)].as_py()))
        size = np.array([len(texts.get(int(d), b"")) for d in wanted], np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(b"".join(texts.get(int(d), b"") for d in wanted), np.uint8)
        place = np.searchsorted(wanted, doc)
        fits = start.astype(np.int64) + length <= size[place]
        doc, start, length, anchor, hot, place = (c[fits] for c in (doc, start, length, anchor, hot, place))
        at = base[place] + start

        warm = hot == 0
        order = np.flatnonzero(warm)
        for route, (rows,) in deal((anchor[order] % tk.U64(routes)).astype(np.int64), [order]):
            body = b"".join([raw[at[i] : at[i] + length[i]].tobytes() for i in rows])
            out.append((route, BYTES, pack([doc[rows], start[rows], length[rows], _part(anchor[rows])]), zstandard.ZstdCompressor(level=1).compress(body)))

        if hot.any():
            rows = np.flatnonzero(~warm)
            windows = (length[rows] - LENGTH + 1).astype(np.int64)
            keys: list[list[np.ndarray]] = []
            # a chunk of segments at a time
            turn = (np.cumsum(length[rows].astype(np.int64)) - length[rows]) // tk.CHUNK
            for now in np.unique(turn):
                some = rows[turn == now]
                long = length[some].astype(np.int64)
                top = np.cumsum(long)
                own = raw[np.repeat(at[some] - (top - long), long) + np.arange(top[-1])]
                n = long - LENGTH + 1
                where = np.repeat(top - long - (np.cumsum(n) - n), n) + np.arange(n.sum())
                keys.append([tk.RangeHash(own, which=k).of(where, where + LENGTH) for k in (0, 1)])
            inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            kept, gone = _settle(np.repeat(doc[rows], windows), (np.repeat(start[rows], windows) + inner).astype(np.int32), np.full(len(inner), LENGTH, np.int32), *(np.concatenate(k) for k in zip(*keys, strict=True)))
            out += _deal_spans(*gone, routes)
            d, s, _, h1, h2 = kept
            by = np.lexsort((s, d))
            d, s, h1, h2 = (c[by] for c in (d, s, h1, h2))
            out += [(r, WINDOWS, pack(c)) for r, c in deal((h1 % tk.U64(routes)).astype(np.int64), [d, s, h1, h2])]
        return _table(out)

    return run


def _sort_suffixes(routes: int):
    """Per anchor (or window hash): the windows that also occur earlier."""

    @tk.trimmed
    def run(group: pa.Table) -> pa.Table:
        out = [(group.column("route")[0].as_py(), SPANS, head) for head, _ in _by_kind(group, SPANS)]
        blocks = _by_kind(group, BYTES)
        if blocks:
            every = unpack_all((h for h, _ in blocks), _BYTES)
            whole = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b) for _, b in blocks), np.uint8)
            until = np.cumsum(every[2].astype(np.int64))
            # neighbouring parts, of SORTED bytes or one part at least
            weight = np.bincount(every[3], weights=every[2], minlength=256)
            turn = ((np.cumsum(weight) - weight) // SORTED).astype(np.int64)[every[3]]
            for now in np.unique(turn):
                rows = np.flatnonzero(turn == now)
                doc, start, length = (c[rows] for c in every[:3])
                long = length.astype(np.int64)
                top = np.cumsum(long)
                raw = whole[np.repeat(until[rows] - top, long) + np.arange(top[-1])]
                windows = long - LENGTH + 1
                inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                candidates = np.repeat(top - long, windows) + inner
                d, s = np.repeat(doc, windows), np.repeat(start.astype(np.int64), windows) + inner
                by = np.lexsort((s, d))
                order = np.empty(len(by), np.int64)
                order[by] = np.cumsum(_runs(d[by], s[by]))
                found = repeated_prefixes(raw.astype(np.int16) + 1, candidates, order, LENGTH)
                back = np.searchsorted(candidates, found)
                out += _deal_spans(d[back], s[back], s[back] + LENGTH, routes)
        hashed = _by_kind(group, WINDOWS)
        if hashed:
            d, s, h1, h2 = unpack_all((h for h, _ in hashed), _WINDOW)
            _, gone = _settle(d, s, np.full(len(d), LENGTH, np.int32), h1, h2)
            out += _deal_spans(*gone, routes)
        return _table(out)

    return run


def _apply(carried: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * carried]
    types = [pa.int64()] * 4 + [pa.string()] * 2

    @tk.trimmed
    def run(group: pa.Table) -> pa.Table:
        doc, start, end = unpack_all((h for h, _ in _by_kind(group, SPANS)), _SPAN)
        by = np.lexsort((start, doc))
        doc, start, end = doc[by], start[by].tolist(), end[by].tolist()
        ids, bodies = group.column("doc_id"), group.column("body")
        unpack = zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []
        texts = np.flatnonzero(group.column("kind").to_numpy() == TEXT)
        for i in texts:
            d, data = ids[int(i)].as_py(), unpack(bodies[int(i)].as_py())
            a, b = (np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")) if d is not None else (0, 0)
            kept, at, runs, gone = [], 0, 0, 0
            for k in range(a, b):
                s, e = start[k], min(end[k], len(data))
                if s > at or not runs:
                    kept.append(data[at:s])
                    runs += 1
                    gone += max(0, e - s)
                else:
                    gone += max(0, e - at)
                at = max(at, e)
            kept.append(data[at:])
            left = b"".join(kept)
            row = (d, len(data), gone, runs, hashlib.sha256(left).hexdigest())
            rows.append((*row, left.decode("utf-8", "ignore")) if carried else row)
        columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(zip(names, types, strict=False))]
        if carried:
            return pa.table([*columns, group.column("carried").take(pa.array(texts))], names=[*names, "carried"])
        return pa.table(columns, names=names)

    return run


def _dedup(docs: DataFrame, carried: bool, bytes_per_route: int) -> DataFrame:
    """``docs`` has doc_id, text and, if ``carried``, a struct of that name, which stays as it is."""
    spark = docs.sparkSession
    routes = routes_for(scratch.size_bytes(docs, "text"), bytes_per_route)
    source = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = source.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_find_segments(routes), BLOCK)
    decided = scratch.save(found.groupBy("route").applyInArrow(_decide_segments(routes), BLOCK))
    scratch.release(spark)

    def texts(carry: bool) -> DataFrame:
        @tk.trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=1).compress
            for b in batches:
                doc = b.column(0)
                route = route_of(doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), routes)
                route = np.where(doc.is_null().to_numpy(zero_copy_only=False), np.arange(len(route)) % routes, route)
                block = as_batch(_SCHEMA, [route, np.full(b.num_rows, TEXT), doc, [None] * b.num_rows, [squeeze((t.as_py() or "").encode()) for t in b.column(1)]])
                yield pa.RecordBatch.from_arrays([*block.columns, b.column(2)], [*_SCHEMA.names, "carried"]) if carry else block

        kind = T.StructType.fromDDL(BLOCK)
        return source.select("doc_id", "text", *["carried"] * carry).mapInArrow(run, kind.add(source.schema["carried"]) if carry else kind)

    fetched = decided.where(F.col("kind") == UNDECIDED).union(texts(False)).groupBy("route").applyInArrow(_fetch_bytes(routes), BLOCK)
    sorted_ = scratch.save(fetched.groupBy("route").applyInArrow(_sort_suffixes(routes), BLOCK))
    scratch.release(spark)
    spans = decided.where(F.col("kind") == SPANS).union(sorted_)
    result = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * carried)
    if carried:
        own = source.schema["carried"].dataType
        spans, result = spans.withColumn("carried", F.lit(None).cast(own)), result.add("carried", own)
    return spans.union(texts(carried)).groupBy("route").applyInArrow(_apply(carried), result)


def dedup(docs: DataFrame, bytes_per_route: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs(doc_id, text)``."""
    return _dedup(docs.select("doc_id", "text"), False, bytes_per_route)


def remove_repeats(docs: DataFrame, bytes_per_route: int = 2 << 20) -> DataFrame:
    """``docs`` with text reduced to what :func:`dedup` keeps (without characters that a run's
    border cuts) and n_chars, where there is such a column, set anew for the changed texts. Null
    texts stay null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("text").isNull().alias("no_text"), *([F.struct(*others).alias("row")] if others else []))
    made = _dedup(docs.select("doc_id", "text", row.alias("carried")), True, bytes_per_route)
    columns = []
    for c in docs.columns:
        if c == "doc_id":
            value = F.col("doc_id").cast(docs.schema[c].dataType)
        elif c == "text":
            value = F.when(~F.col("carried.no_text"), F.col("text"))
        elif c == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("carried")["row"][c])
        else:
            value = F.col("carried")["row"][c]
        columns.append(value.alias(c))
    return made.select(*columns)
