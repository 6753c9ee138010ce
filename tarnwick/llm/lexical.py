"""Ranked lexical search over a tiered index of all documents.

A term occurring tf times in a document of n terms has there the impact

    (10^9 * tf) div (1000 * tf + 8 * m),   m = 25 + (75 * n * N) div L,

and a document's score for an item sums weight * impact over the item's terms, repeats included;
a term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))). All but the logarithm is 64-bit integer.

Index. Documents lie in shards of a few MB, in which a term's postings are ordered by impact and cut
into tiers: the first 16, the next 240, the rest. A row holds the postings of one term, shard and tier,
and the residual bound: the greatest impact that follows in lower tiers. Rows are written by tier, so
a search that needs the first tier reads no other. Nothing is shuffled to build it, no list grows with
the input, and the busiest term has one row a shard and tier.

Search. Items go in blocks of a bounded number, each term of a block is joined to its rows, and a
shard scores a block in one group: a lower bound for each document by the postings that were read, an
upper bound by the residual bounds of the item's terms in which it wasn't seen. The k-th best lower
bound over all shards is an item's threshold. A shard whose inexact documents all stay below it is
proven for the item; items lacking that proof in a shard fall through to the next tier there. In the
last tier all bounds are exact.

Defined cases: a null or empty text has no terms, in documents (never found) and in items (no rows);
every row is a document or an item of its own, whether its id is repeated or null (null ids first among
equals); a very long text is a shard of its own; an empty table on either side gives no rows; further
columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, terms
from . import textkit as tk
from .exchange import as_batch

#: Where a term's postings in a shard, by falling impact, are cut.
CUTS = (16, 256)
#: Documents and text bytes of a shard, items of a block.
SHARD_ROWS, SHARD_BYTES, ITEMS = 8192, 4 << 20, 256
#: The terms of the items are sent to all tasks up to this size, else both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: Under this name, which no term has, a shard keeps the ids of its documents.
IDS = ""

_POSTINGS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("rest", pa.int32()), ("docs", pa.binary()), ("impacts", pa.binary()), ("tier", pa.int32())])
POSTINGS = "shard long, term string, df int, rest int, docs binary, impacts binary, tier int"


class Index(NamedTuple):
    """Postings by tier, the number of documents with a term and the number of all terms."""

    postings: DataFrame
    documents: int
    length: int


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = length = 0
    for batch in batches:
        for part in tk.split_by_bytes(batch, 0, SHARD_BYTES):
            n = terms.count_terms(part.column(0), terms.LETTERS_AND_DIGITS)
            documents += int((n > 0).sum())
            length += int(n.sum())
    yield pa.RecordBatch.from_pydict({"documents": [documents], "length": [length]})


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 25 + 75 * n * documents // max(length, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Ranges of an array as binary values."""
    places = pa.py_buffer((bounds * data.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, places, pa.py_buffer(np.ascontiguousarray(data))])


def _post(documents: int, length: int):
    @tk.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in tk.split_by_bytes(batch, 1, SHARD_BYTES, SHARD_ROWS):
                part = part.sort_by([("doc_id", "ascending")]) if part.num_rows > 1 else part
                ids = part.column(0)
                known = terms.terms_of(part.column(1), terms.LETTERS_AND_DIGITS)
                n = np.bincount(known.text, weights=known.count, minlength=part.num_rows).astype(np.int64)
                strength = impact(known.count, n[known.text], documents, length)
                order = np.lexsort((known.text, -strength, known.term))
                term, docs, strength = known.term[order], known.text[order], strength[order]
                first = np.searchsorted(term, np.arange(len(known.names)))
                place = np.arange(len(term)) - first[term]
                tier = np.searchsorted(np.asarray(CUTS), place, "right")
                begin = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(tier) != 0)])) if len(term) else np.zeros(0, np.int64)
                bounds = np.append(begin, len(term))
                df = np.bincount(term, minlength=len(known.names))
                follows = np.append(term[begin][1:] == term[begin][:-1], False) if len(begin) else np.zeros(0, bool)
                rest = np.where(follows, strength[np.minimum(bounds[1:], max(len(term) - 1, 0))], 0) if len(begin) else np.zeros(0, np.int64)
                names = terms.strings(known.names).take(pa.array(term[begin]))
                yield as_batch(_POSTINGS, [np.full(len(begin), shard), names, df[term[begin]].astype(np.int32), rest.astype(np.int32), _slices(docs.astype(np.int32), bounds), _slices(strength.astype(np.int32), bounds), tier[begin].astype(np.int32)])
                # null ids sort last in Arrow; they are put first when results are ranked
                values, valid = ids.fill_null(0).to_numpy().astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False)
                yield as_batch(_POSTINGS, [[shard], [IDS], [0], [0], [values.tobytes()], [valid.astype(np.uint8).tobytes()], [0]])
                shard += 1

    return run


def build(docs: DataFrame) -> Index:
    """An index of every row of ``docs(doc_id, text)``."""
    totals = docs.select("text").mapInArrow(_totals, "documents long, length long").agg(F.sum("documents"), F.sum("length")).first()
    documents, length = totals[0] or 0, totals[1] or 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_post(documents, length), POSTINGS)
    return Index(scratch.save(rows, "tier"), documents, length)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of an item."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.string()), ("times", pa.int64())])
    for batch in batches:
        for part in tk.split_by_bytes(batch, 1, SHARD_BYTES):
            known = terms.terms_of(part.column(1), terms.LETTERS_AND_DIGITS)
            yield as_batch(schema, [part.column(0).take(pa.array(known.text)), terms.strings(known.names).take(pa.array(known.term)), known.count])


_SCORED = pa.schema([("item", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("most", pa.int64()), ("proof", pa.bool_())])
SCORED = "item long, shard long, doc_id long, score long, most long, proof boolean"


def _score(k: int):
    """Bounds of a shard's documents for the items of a block. A row with ``proof`` is one of the best k
    by lower bound ``score``, ``most`` being its upper bound; a row without is the greatest upper bound of
    all documents that aren't exact."""

    @tk.trimmed
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        rows = group.combine_chunks().sort_by([("term", "ascending"), ("tier", "ascending")]).to_pylist()
        ids = next(r for r in rows if r["term"] == IDS)
        doc_ids, valid = np.frombuffer(ids["docs"], np.int64), np.frombuffer(ids["impacts"], np.uint8).astype(bool)
        items = np.unique(np.concatenate([np.asarray(r["items"], np.int64) for r in rows]))
        low = np.zeros((len(items), len(doc_ids)), np.int64)
        seen, residual = np.zeros_like(low), np.zeros(len(items), np.int64)
        for i, row in enumerate(rows):
            if row["term"] == IDS:
                continue
            mine = np.searchsorted(items, np.asarray(row["items"], np.int64))
            times = np.asarray(row["times"], np.int64) * row["weight"]
            docs = np.frombuffer(row["docs"], np.int32)
            low[mine[:, None], docs] += times[:, None] * np.frombuffer(row["impacts"], np.int32).astype(np.int64)
            # the last tier that was read has the bound for what follows
            last = i
            while last + 1 < len(rows) and rows[last + 1]["term"] == row["term"]:
                last += 1
            if rest := rows[last]["rest"]:
                seen[mine[:, None], docs] += (times * rest)[:, None]
                if last == i:
                    residual[mine] += times * rest
        most = low + residual[:, None] - seen
        rank = np.arange(len(doc_ids))  # by id, null first
        rank = np.where(valid, rank + len(doc_ids), rank)
        out = []
        for i, item in enumerate(items):
            found = np.flatnonzero(low[i])
            if len(found) > 4 * k:
                cut = np.partition(low[i][found], len(found) - k)[len(found) - k]
                found = found[low[i][found] >= cut]
            found = found[np.lexsort((rank[found], -low[i][found]))][:k]
            out += [(item, shard, int(doc_ids[d]) if valid[d] else None, int(low[i, d]), int(most[i, d]), True) for d in found]
            open_ = most[i][most[i] > low[i]]
            if len(open_):
                out.append((item, shard, None, 0, int(open_.max()), False))
        return pa.table([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_SCORED)], schema=_SCORED)

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for every row of ``items(item_id, text)`` the k documents
    with the highest scores above 0, equal ones by ascending doc_id."""
    scope = scratch.mark()
    asked = scratch.save(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")))
    blocks = F.lit(max(1, -(-asked.count() // ITEMS)))
    wanted = asked.select("item", "text").mapInArrow(_asked, "item long, term string, times long")
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item"), blocks).cast("int"))
    wanted = scratch.save(wanted.groupBy("block", "term").agg(F.collect_list(F.struct("item", "times")).alias("uses")))
    small = scratch.size_bytes(wanted) <= BROADCAST_BYTES
    sent = F.broadcast if small else lambda df: df

    df_of = index.postings.where("tier = 0").select("term", "df").join(sent(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    known = wanted.join(df_of, "term").select("block", "term", weight.alias("weight"), F.col("uses.item").alias("items"), F.col("uses.times").alias("times"))
    ids = known.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    ids = ids.select("block", F.lit(IDS).alias("term"), F.lit(0).cast("long").alias("weight"), "items", F.transform("items", lambda _: F.lit(0).cast("long")).alias("times"))
    known = scratch.save(known.union(ids))

    floor = done = None
    for tier in range(len(CUTS) + 1):
        rows = index.postings.where(F.col("tier") <= tier).join(sent(known), "term")
        if done is not None:
            still = pending.groupBy("shard", F.pmod(F.xxhash64("item"), blocks).cast("int").alias("block")).agg(F.collect_list("item").alias("open"))  # noqa: F821
            rows = rows.join(still, ["shard", "block"]).withColumn("uses", F.filter(F.arrays_zip("items", "times"), lambda u: F.array_contains("open", u["items"])))
            rows = rows.where(F.size("uses") > 0).withColumns({"items": F.col("uses.items"), "times": F.col("uses.times")})
        rows = rows.select("shard", "block", "term", "tier", "rest", "docs", "impacts", "weight", "items", "times")
        scored = scratch.save(rows.groupBy("shard", "block").applyInArrow(_score(k), SCORED))
        every = scored if done is None else scored.union(done)
        floor = best(every.where("proof"), k).groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("floor"))
        floor = scratch.save(floor)
        judged = scored.join(sent(floor), "item", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(0)), F.lit(1)))
        pending = scratch.save(judged.where("NOT proof AND most >= floor").select("item", "shard"))
        proven = judged.where("proof AND score = most AND score >= floor").join(pending, ["item", "shard"], "left_anti").select(scored.columns)
        done = scratch.save(proven if done is None else proven.union(done))
        if pending.isEmpty():
            break
    out = best(done, k).join(asked.select("item", "item_id"), "item")
    out = scratch.save(out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    scratch.drop_since(scope, out)
    return out


def oracle() -> str:
    """What :func:`search` finds among ``documents`` for ``benchmark``."""
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"regexp_extract_all({fold}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents), c AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
    p AS (SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY r, t),
    f AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY t),
    i AS (SELECT item_id, unnest({split}) AS t FROM benchmark), q AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY item_id, t),
    s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t), c GROUP BY item_id, r)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
