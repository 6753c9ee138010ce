"""How the sources of each language differ in their words.

In a language the kept terms are those in at least 3 of its documents, V of them. A group, that is a
(lang, source) or the whole language, gives a kept term that it has ``count`` times

    p = 1 + floor(10^9 * (count + 1) / (N + V)),   N = its occurrences of all kept terms.

Part ``pair`` compares a group with each other source of its language by the sum over all kept terms of
floor((p - q)^2 / q), q being the other's share; part ``term`` lists the group's 200 terms with the
greatest such value among those that it has and uses more than its language.

1. Terms are counted by language and source in Arrow batches, a few MB at once, and added up by Spark;
   the counts of a third of all rows are combined in each task first.
2. (lang, block of terms) is one dense tile, an int64 matrix of sources by kept terms. Blocks follow the
   input, so tiles have a bounded number of terms. Sums over tiles give N and V.
3. Each tile, with the language's sources and their N, makes the matrix of shares and compares every row
   with all others in one broadcast; a tile's pair sums are a partial matrix, and each group keeps the
   200 greatest of the tile's terms. Partial matrices are added up, the tiles' heaps are merged.

All arithmetic is exact in 64 bits while N + V < 2^53 and V < 2^30: quotients are divided out in three
steps of 1000, and no sum of a pair exceeds (10^9 + V)^2.

Defined cases: null text, lang and source are ''; a group without terms has N = 0 and p like any other;
a language without kept terms gives its pairs the value 0 and no terms; every row is a document of its
own, whether its doc_id is repeated or null; an empty table gives no rows; other columns are ignored.
A very long text is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, terms
from . import textkit as tk
from .exchange import as_batch, routes_for

#: Documents of its language that a kept term is in, terms listed for a group.
LEAST, LISTED = 3, 200
#: Text that is counted at once; input bytes to a block of terms; cells of a matrix that is made at once.
GATHERED, BLOCK_BYTES, CELLS = 16 << 20, 8 << 20, 1 << 21

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("df", pa.int64())])
COUNTED = "lang string, source string, term string, count long, df long"
_TILE = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("kept", pa.int64()), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("counts", pa.binary())])
TILE = "lang string, block int, kept long, sources array<string>, sums array<long>, terms array<string>, counts binary"
_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
PART = "lang string, source string, part string, item string, value long"


@tk.trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group. The empty term stands for the group itself."""
    for batch in terms.gathered(batches, 2, GATHERED):
        for part in tk.split_by_bytes(batch, 2, 2 * GATHERED):
            known = terms.terms_of(part.column(2), terms.LETTERS)
            names = pa.concat_arrays([terms.strings(known.names), pa.array([""])])
            pairs = pa.table({"lang": part.column(0), "source": part.column(1)})
            groups = pairs.group_by(["lang", "source"], use_threads=False).aggregate([])
            number = pa.table({"lang": groups["lang"], "source": groups["source"], "g": np.arange(len(groups))})
            key = {(a, b): g for a, b, g in zip(*(number.column(c).to_pylist() for c in ("lang", "source", "g")), strict=True)}
            of_text = np.array([key[x] for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
            cell, back, df = np.unique(of_text[known.text] * len(names) + known.term, return_inverse=True, return_counts=True)
            count = np.zeros(len(cell), np.int64)
            np.add.at(count, back, known.count)
            group = np.concatenate([cell // len(names), np.arange(len(groups))])
            term = np.concatenate([cell % len(names), np.full(len(groups), len(names) - 1)])
            zero = np.zeros(len(groups), np.int64)
            group, count, df = pa.array(group), np.concatenate([count, zero]), np.concatenate([df, zero])
            yield as_batch(_COUNTED, [groups[c].combine_chunks().take(group) for c in ("lang", "source")] + [names.take(pa.array(term)), count, df])


@tk.trimmed
def _tile(group: pa.Table) -> pa.Table:
    """The counts of a block's kept terms by source; sources without any have their row too."""
    group = group.combine_chunks()
    sources, terms_ = (group.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    s, t = sources.indices.to_numpy().astype(np.int64), terms_.indices.to_numpy().astype(np.int64)
    df = np.zeros(len(terms_.dictionary), np.int64)
    np.add.at(df, t, group.column("df").to_numpy())
    kept = np.flatnonzero(df >= LEAST)
    column = np.full(len(df), -1)
    column[kept] = np.arange(len(kept))
    counts = np.zeros((len(sources.dictionary), len(kept)), np.int64)
    mine = column[t] >= 0
    counts[s[mine], column[t[mine]]] = group.column("count").to_numpy()[mine]
    data = zstandard.ZstdCompressor(level=1).compress(counts.tobytes())
    row = [group.column("lang")[0].as_py()], [group.column("block")[0].as_py()], [len(kept)], [sources.dictionary.to_pylist()], [counts.sum(axis=1)], [terms_.dictionary.take(pa.array(kept)).to_pylist()], [data]
    return pa.Table.from_batches([as_batch(_TILE, list(row))])


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (counts + 1) / total), exactly: 10^9 counts may exceed 64 bits."""
    whole, left = np.divmod(counts + 1, total)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


@tk.trimmed
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tile's partial pair matrix and each group's greatest terms."""
    for batch in batches:
        for row in batch.to_pylist():
            names, lang, v = row["all_sources"], row["lang"], row["v"]
            place = {x: i for i, x in enumerate(names)}
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), np.int64).reshape(len(row["sources"]), row["kept"])
            rows = np.array([place[x] for x in row["sources"]], np.int64)
            total = np.asarray(row["all_sums"], np.int64) + v
            step = max(1, CELLS // len(names))
            heaps = [[] for _ in names]
            for a in range(0, row["kept"], step):
                counts = np.zeros((len(names), min(step, row["kept"] - a)), np.int64)
                counts[rows] = own[:, a : a + step]
                p = shares(counts, total[:, None])
                q = shares(counts.sum(axis=0), total.sum() - (len(names) - 1) * v)
                for i in np.flatnonzero(counts.any(axis=1)):
                    found = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                    value = _apart(p[i][found], q[found])
                    heaps[i] = sorted(heaps[i] + [(-int(x), row["terms"][a + int(j)].encode()) for x, j in _greatest(value, found)])[:LISTED]
            listed = [(lang, names[i], "term", t.decode(), -x) for i, heap in enumerate(heaps) for x, t in heap]
            for at in range(0, len(listed), 1 << 16):
                yield as_batch(_PART, [list(c) for c in zip(*listed[at : at + (1 << 16)], strict=True)])
            band = max(1, CELLS // len(names))  # rows of the pair matrix that are summed at once
            for top in range(0, len(names), band):
                pairs = np.zeros((min(band, len(names) - top), len(names)), np.int64)
                for a in range(0, row["kept"], step):
                    counts = np.zeros((len(names), min(step, row["kept"] - a)), np.int64)
                    counts[rows] = own[:, a : a + step]
                    p = shares(counts, total[:, None])
                    for i in range(len(pairs)):
                        pairs[i] += _apart(p[top + i], p).sum(axis=1)
                i, j = np.nonzero(np.arange(len(pairs))[:, None] + top != np.arange(len(names)))
                all_ = pa.array(names)
                yield as_batch(_PART, [[lang] * len(i), all_.take(pa.array(i + top)), ["pair"] * len(i), all_.take(pa.array(j)), pairs[i, j]])


def _greatest(value: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
    """The values that may be among the first LISTED, with equals of the last one, and their places."""
    if len(value) > LISTED:
        cut = np.partition(value, len(value) - LISTED)[len(value) - LISTED]
        value, found = value[value >= cut], found[value >= cut]
    return list(zip(value.tolist(), found.tolist(), strict=True))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of every group of ``docs(text, lang, source)``."""
    scope = scratch.mark()
    blocks = routes_for(scratch.size_bytes(docs, "text"), BLOCK_BYTES)
    none = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    counted = docs.select(none("lang"), none("source"), none("text")).mapInArrow(_count, COUNTED)
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    tiles = scratch.save(counted.withColumn("block", block).groupBy("lang", "block").applyInArrow(_tile, TILE))

    sums = tiles.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    listed = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("all"))
    langs = tiles.groupBy("lang").agg(F.sum("kept").alias("v")).join(listed, "lang")
    langs = scratch.save(langs.select("lang", "v", F.col("all.source").alias("all_sources"), F.col("all.n").alias("all_sums")))
    parts = scratch.save(tiles.join(langs, "lang").mapInArrow(_compare, PART))

    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    out = scratch.save(ranked(pairs).union(ranked(parts.where("part = 'term'")).where(F.col("rank") <= LISTED)))
    scratch.drop_since(scope, out)
    return out


def oracle() -> str:
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({fold}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    x AS (SELECT r, lang, source, unnest(w) AS t FROM d), kept AS (SELECT lang, t FROM x GROUP BY lang, t HAVING count(DISTINCT r) >= 3), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, t, count(*) AS c FROM x JOIN kept USING (lang, t) GROUP BY ALL),
    n AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.t, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (n + v) AS p FROM g JOIN kept k USING (lang) JOIN n USING (lang, source) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
    q AS (SELECT lang, t, 1 + (1000000000 * (sum(c)::BIGINT + 1)) // (any_value(n) + any_value(v)) AS q FROM p JOIN (SELECT lang, sum(n)::BIGINT AS n FROM n GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, t),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, t AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 200"""
