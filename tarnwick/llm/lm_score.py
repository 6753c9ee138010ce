"""Stupid-backoff scores under the corpus' own n-gram counts.

    S(w | context) = count(context w) / count(context)   if context w occurs,
                     0.4 * S(w | context without its first word)   otherwise,

down to count(w) / tokens. log_score leaves the document itself out of the counts (else every n-gram
would be known and nothing would ever back off), with half a count for words that occur nowhere else;
corpus_log_score counts the whole corpus.

1. Documents are dealt to blocks of a bounded size, which are written once.
2. For each order, the n-grams of a block are exploded and combined, so that an n-gram is one entry in
   a block however often it occurs there. The entries are dealt by ranges of their hash. A range's
   group sums them, which makes its part of the count table, and joins the totals to the entries; one
   number an entry goes back to its block, in the order of the hashes, which both sides know.
3. A block's totals of all orders meet its texts. A document's own occurrences are counted there and
   taken off, and the scores are summed for each document.

Plain rows of n-gram, document and count would be some ten times the input for each order; as blocks
of sorted hashes an entry costs about six bytes, and only one order's are on disk at a time. No n-gram
is hot: the busiest has one entry a block.

Hashes have 64 bits: with n distinct n-grams, one in 2^64 / n shares its hash with another (at 10^13,
the trigrams of some 100 TB, one in two million).

Defined cases: texts without a word (null, empty) have n_words 0 and null scores; every row is a
document of its own, whether its doc_id is repeated or null; a very long text is hashed in pieces and
scored whole; an empty table gives an empty result. Columns other than doc_id and text are ignored,
however they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textkit as tk
from .exchange import as_batch, pack, routes_for, unpack, unpack_all

BACKOFF = 0.4
#: Words whose n-grams are combined at once; a block has one such unit or a few.
UNIT = 1 << 21

#: What a block of texts holds: numbers of its rows, and the texts one after another.
_BLOCK = pa.schema([("block", pa.int32()), ("rows", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("z", pa.binary())])
BLOCK = "block int, rows long, tokens long, ids array<long>, sizes array<long>, z binary"
#: Entries of n-grams, or (with their range as ``part``) the answers to them.
_ENTRIES = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
ENTRIES = "range int, block int, part int, n int, body binary"


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range that each hash lies in; hashes in rising order lie in rising ranges."""
    return ((key >> tk.U64(32)) * tk.U64(ranges) >> tk.U64(32)).astype(np.int64)


def ngrams(words: np.ndarray, owner: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of the ``order`` words that end at each word; 0 where there aren't as many."""
    h = words.copy()
    for k in range(1, order):
        h[k:] = tk.mix(h[k:] * tk.U64(3) + words[:-k])
        h[:k] = 0
    h = np.maximum(tk.mix(h + tk.U64(order)), tk.U64(1))
    if order > 1 and len(h):
        h[order - 1 :][owner[order - 1 :] != owner[: len(owner) - order + 1]] = 0
        h[: order - 1] = 0
    return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of its text, hashed a few texts at a time."""
    words, owners, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= tk.CHUNK):
            size += len(texts[to])
            to += 1
        offsets = np.cumsum([0, *map(len, texts[at:to])])
        raw = np.frombuffer(b"".join(texts[at:to]), np.uint8)
        start, end, bounds = tk.word_ranges(raw, offsets)
        words.append(tk.RangeHash(raw).of(start, end))
        owners.append((tk.owner(bounds) + at).astype(np.int32))
        at = to
    return np.concatenate(words), np.concatenate(owners)


def _texts(row: dict) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(row["z"])
    ends = np.cumsum(row["sizes"]).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@tk.trimmed
def _gather(group: pa.Table) -> pa.Table:
    """One row of a block's texts."""
    unpack_text = zstandard.ZstdDecompressor().decompress
    texts = [unpack_text(z.as_py()) for z in group.column("z")]
    words, _ = word_hashes(texts)
    whole = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
    row = [group.column("block")[0].as_py()], [len(texts)], [len(words)], [group.column("doc_id").to_pylist()], [list(map(len, texts))], [whole]
    return pa.Table.from_batches([as_batch(_BLOCK, list(row))])


def _explode(order: int, ranges: int):
    @tk.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, owner = word_hashes(_texts(row))
                key = ngrams(words, owner, order)
                for part, at in enumerate(range(0, len(key), UNIT)):
                    own = key[at : at + UNIT]
                    keys, counts = np.unique(own[own != 0], return_counts=True)
                    where = range_of(keys, ranges)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(keys)]])
                    spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
                    bodies = [pack([keys[a:b].view(np.int64), counts[a:b].astype(np.uint32)]) for a, b in spans]
                    yield as_batch(_ENTRIES, [[where[a] for a, _ in spans], [row["block"]] * len(spans), [part] * len(spans), [b - a for a, b in spans], bodies])

    return run


@tk.trimmed
def _count(group: pa.Table) -> pa.Table:
    """A range's part of the count table, joined to the entries."""
    blocks = [unpack(b.as_py(), [np.int64, np.uint32]) for b in group.column("body")]
    keys = np.concatenate([b[0] for b in blocks]).view(np.uint64)
    order = np.argsort(keys, kind="stable")
    rising = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = rising[1:] != rising[:-1]
    counts = np.concatenate([b[1] for b in blocks]).astype(np.int64)
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    joined = np.empty(len(keys), np.int64)
    joined[order] = total[np.cumsum(new) - 1]
    ends = np.cumsum([len(b[0]) for b in blocks])
    bodies = [pack([joined[b - len(x[0]) : b].astype(np.uint64)]) for x, b in zip(blocks, ends, strict=True)]
    columns = [group.column(c).combine_chunks() for c in ("range", "block", "part", "n")]
    return pa.table([*columns, pa.array(bodies, pa.binary())], schema=_ENTRIES)


def _score(order: int, tokens: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64()), ("corpus_log_score", pa.float64())])

    @tk.trimmed
    def run(group: pa.Table) -> pa.Table:
        is_text = group.column("z").is_valid().to_numpy()
        row = group.slice(int(np.flatnonzero(is_text)[0]), 1).to_pylist()[0]
        words, owner = word_hashes(_texts(row))
        kinds, parts, ranges = (group.column(c).fill_null(-1).to_numpy() for c in ("order", "part", "range"))
        bodies = group.column("body")
        others, totals = {}, {}
        for k in range(1, order + 1):
            key = ngrams(words, owner, k)
            totals[k] = np.zeros(len(key), np.int64)
            for part, at in enumerate(range(0, len(key), UNIT)):
                some = np.flatnonzero(key[at : at + UNIT]) + at
                _, back = np.unique(key[some], return_inverse=True)
                mine = np.flatnonzero((kinds == k) & (parts == part))
                mine = mine[np.argsort(ranges[mine])]
                (answers,) = unpack_all((bodies[int(i)].as_py() for i in mine), [np.uint64])
                totals[k][some] = answers.astype(np.int64)[back]
            joint = tk.mix(key ^ tk.mix(owner.astype(np.uint64) + tk.U64(1)))
            _, back, own = np.unique(joint, return_inverse=True, return_counts=True)
            others[k] = np.where(key != 0, totals[k] - own[back], -1)

        n = np.bincount(owner, minlength=row["rows"])
        rest = np.maximum(tokens - n, 1)[owner]
        score = np.log(np.maximum(others[1], 0.5) / rest)
        whole = np.log(np.maximum(totals[1], 1) / max(tokens, 1))
        for k in range(2, order + 1):
            exists = others[k] >= 0  # else there are fewer words before, and a lower order's score stands
            before = lambda counts: np.maximum(np.concatenate([[0], counts[k - 1][:-1]])[: len(words)], 1)  # noqa: B023, E731
            score = np.where(others[k] > 0, np.log(np.maximum(others[k], 1) / before(others)), np.where(exists, score + np.log(BACKOFF), score))
            whole = np.where(exists, np.log(np.maximum(totals[k], 1) / before(totals)), whole)
        score, whole = (np.bincount(owner, weights=x, minlength=row["rows"]) for x in (score, whole))
        empty = n == 0
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(score, mask=empty), pa.array(score / np.maximum(n, 1), mask=empty), pa.array(whole, mask=empty)], schema=schema)

    return run


def lm_scores(docs: DataFrame, order: int = 3, bytes_per_block: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, log_score (the sum over the words), mean_log_score and corpus_log_score for
    every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    parts = routes_for(scratch.size_bytes(docs, "text"), bytes_per_block)
    # rows with one doc_id may be many, so their places count too
    block = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    packed = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("z", pa.binary())])

    @tk.trimmed
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield as_batch(packed, [b.column(0), b.column(1), [squeeze((t.as_py() or "").encode()) for t in b.column(2)]])

    dealt = docs.select(block.alias("block"), F.col("doc_id").cast("long"), "text").mapInArrow(compress, "block int, doc_id long, z binary")
    blocks = scratch.save(dealt.groupBy("block").applyInArrow(_gather, BLOCK))
    scratch.release(spark)
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    answers = []
    for k in range(1, order + 1):
        entries = blocks.mapInArrow(_explode(k, parts), ENTRIES)
        answers.append(scratch.save(entries.groupBy("range").applyInArrow(_count, ENTRIES)).withColumn("order", F.lit(k)))
        scratch.release(spark)
    none = lambda kind: F.lit(None).cast(kind)
    every = blocks.select("block", "rows", "ids", "sizes", "z", none("int").alias("order"), none("int").alias("part"), none("int").alias("range"), none("binary").alias("body"))
    for one in answers:
        every = every.union(one.select("block", none("long"), none("array<long>"), none("array<long>"), none("binary"), "order", "part", "range", "body"))
    return every.groupBy("block").applyInArrow(_score(order, tokens), "doc_id long, n_words long, log_score double, mean_log_score double, corpus_log_score double")
