"""Near-duplicate groups by MinHash, banding, verification and connected components.

1. Each text's set of word shingles is hashed; the minima of ``PERMUTATIONS`` universal hash
   functions make its signature, bands of it make bucket keys. Equal sets share a digest: the least
   doc_id of a digest stands for all, so copies never meet each other in a bucket.
2. A text is a candidate of the least one that it shares any bucket with (a star, not all pairs).
   Those whose sets' sizes rule the similarity out are dropped, all others are verified on the full
   sets. Members are brought to their centre in salted groups of a bounded number, as compressed
   texts.
3. Components of the links come from large-star and small-star. A bucket whose members then lie in
   different components may hide a link that the star missed; only there members come together with
   their texts, in groups of a bounded size, and those of different components are verified on the full
   sets, by an index of a bounded number of members at a time.
4. Components of all links give each document's least reachable doc_id.

Two texts at the threshold share no bucket with a chance below 1e-6; nothing else is approximate.

Defined cases: a text without words (or a null one) has an empty set and is linked with nothing;
one with fewer words than a shingle has its whole sequence as its only shingle; rows with the same
doc_id count as one node; a row without doc_id is linked with nothing and kept, with a null
component_id; a very long text is one set, sketched in pieces; an empty table gives an empty result.
Columns other than doc_id and text are ignored, however they are named.
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
from .components import connected_components
from .exchange import as_batch

PERMUTATIONS = 120
#: Members that are verified against one centre in one group.
GROUP = 256
#: Shingles of the members that one group verifies, about, and of one side of a split bucket.
WEIGHT, SIDE = 1 << 18, 1 << 16
#: Bytes of text whose sets are indexed at once.
BLOCK = 4 << 20

_draw = np.random.default_rng(77)
_A = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * tk.U64(2) + tk.U64(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def band_rows(percent: int) -> int:
    """The most rows per band by which a pair at the threshold is missed once in a million."""
    return max(r for r in (1, 2, 3, 4, 5, 6, 8, 10, 12) if (1 - (percent / 100) ** r) ** (PERMUTATIONS // r) < 1e-6)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after another, and their bounds."""
    start, end, bounds = tk.word_ranges(raw, offsets)
    h, by = tk.shingle_hashes(tk.RangeHash(raw, fold=True).of(start, end), bounds, width)
    text = tk.owner(by)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(offsets)))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minima of all hash functions, a row for each text; texts without shingles have zeros."""
    out = np.zeros((len(bounds) - 1, PERMUTATIONS), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at = bounds[:-1][full]
        for k in range(PERMUTATIONS):
            out[full, k] = np.minimum.reduceat(sets * _A[k] + _B[k], at)
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sign(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (d1, d2) and band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @tk.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tk.split_by_bytes(whole, 1):
                sets, bounds = shingle_sets(*tk.text_bytes(part.column(1)), width)
                minima = signatures(sets, bounds)
                mixed = tk.mix(minima + np.arange(PERMUTATIONS, dtype=np.uint64)[None, :])
                keys = tk.mix(mixed.reshape(len(minima), -1, rows).sum(axis=2, dtype=np.uint64)).view(np.int64)
                n = np.diff(bounds)
                yield as_batch(schema, [part.column(0), n, _sums(tk.mix(sets), bounds).view(np.int64), _sums(tk.mix(sets ^ tk.U64(0x5851F42D4C957F2D)), bounds).view(np.int64), [k if m else k[:0] for k, m in zip(keys, n, strict=True)]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id and z, the text's bytes under zstd (a null text's are empty): for cheap shuffles."""
    schema = pa.schema([("doc_id", pa.int64()), ("z", pa.binary())])

    @tk.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield as_batch(schema, [batch.column(0), [pack((t.as_py() or "").encode()) for t in batch.column(1)]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, z binary")


def _sized(edges: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The candidates ``edges(u, v)`` whose sets' sizes allow the similarity."""
    size = lambda key: reps.select(F.col("rep").alias(key), F.col("n_shingles").alias(f"n{key}"))
    return edges.join(size("u"), "u").join(size("v"), "v").where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v", "nu")


def verify(edges: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``edges(u, v, nu)`` whose full sets are similar enough; v is the centre of its group, nu
    the number of u's shingles."""
    sizes = edges.groupBy("v").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("nu") / WEIGHT)).cast("int").alias("salts"))
    members = edges.join(sizes, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"))
    centres = sizes.select(F.col("v").alias("u"), "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = members.union(centres).hint("shuffle_hash").join(compressed(docs), F.col("u") == F.col("doc_id")).select("v", "salt", "u", "z")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    @tk.trimmed
    def run(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        v = group.column("v")[0].as_py()
        u = group.column("u").to_numpy()
        texts = [unpack(z) for z in group.column("z").to_pylist()]
        own = _sets_of(texts, width)
        centres = np.flatnonzero(u == v)
        linked = [int(u[i]) for i in np.flatnonzero(u != v) if any(similar(own[c], own[i], percent) for c in centres)]
        return pa.table([pa.array(linked, pa.int64()), pa.array([v] * len(linked), pa.int64())], schema=schema)

    return rows.groupBy("v", "salt").applyInArrow(run, "u long, v long").distinct()


def _sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The shingle set of each text, hashed a few texts at a time."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= tk.CHUNK):
            size += len(texts[to])
            to += 1
        part = texts[at:to]
        sets, bounds = shingle_sets(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), width)
        out += [sets[bounds[k] : bounds[k + 1]].copy() for k in range(len(part))]
        at = to
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _blocks(sizes: np.ndarray, limit: int) -> list[np.ndarray]:
    """Neighbouring places whose sizes add up to about ``limit``."""
    part = (np.cumsum(sizes) - sizes) // limit
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1)


class SetIndex:
    """How many elements sets share with each of the given ones."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.owners = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in sets])[order]

    def shared(self, own: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
        first = np.searchsorted(self.values, own, "left")
        each = np.searchsorted(self.values, own, "right") - first
        out = np.zeros(self.n, np.int64)
        for part in _blocks(each, limit):
            k = each[part]
            places = np.repeat(first[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            out += np.bincount(self.owners[places], minlength=self.n)
        return out


def _cells(placed: DataFrame) -> DataFrame:
    """The members of buckets in which several components meet, dealt to groups of a bounded size: those
    outside the centre's component, the strays, must meet each other and all others. A heavy bucket is
    split to blocks of strays and blocks of the others, and every pair of blocks with strays is a group."""
    stray = F.col("component") != F.col("main")
    weight = lambda which: F.coalesce(F.sum(F.when(which, F.col("n_shingles"))), F.lit(0))
    blocks = lambda which: F.greatest(F.lit(1), F.ceil(weight(which) / SIDE)).cast("int")
    mixed = placed.groupBy("band", "key").agg(blocks(stray).alias("strays"), blocks(~stray).alias("rest"), F.count_if(stray).alias("n")).where("n > 0").drop("n")
    rows = placed.join(mixed, ["band", "key"]).withColumn("stray", stray)
    part = F.pmod(F.xxhash64("rep"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("rest"))).cast("int")
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    whole = F.array(cell(0, F.lit(0), F.lit(0)))
    of_rest = F.transform(upto("strays"), lambda i: cell(2, i, F.col("part")))
    of_stray = F.concat(F.transform(upto("strays"), lambda j: cell(1, F.least("part", j), F.greatest("part", j))), F.transform(upto("rest"), lambda k: cell(2, F.col("part"), k)))
    cells = F.when((F.col("strays") == 1) & (F.col("rest") == 1), whole).when(F.col("stray"), of_stray).otherwise(of_rest)
    return rows.withColumn("part", part).select("band", "key", "rep", "component", "stray", "part", F.explode(cells).alias("cell")).select("band", "key", "rep", "component", "stray", "part", "cell.*")


def _across(buckets: DataFrame, component: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different components. Members come with their
    texts, so no pair is ever a row; a pair is tested in the first bucket that it shares, on its full
    sets, until its components are found to be one."""
    of = lambda key, out: component.select(F.col("node").alias(key), F.col("component").alias(out))
    placed = buckets.join(of("rep", "own"), "rep", "left").join(of("centre", "its"), "centre", "left").select("band", "key", "rep", "n_shingles", F.coalesce("own", "rep").alias("component"), F.coalesce("its", "centre").alias("main"))
    rows = scratch.save(_cells(placed))
    texts = reps.join(rows.select("rep").distinct(), "rep", "left_semi").hint("shuffle_hash").join(compressed(docs), F.col("rep") == F.col("doc_id")).select("rep", "n_shingles", "bands", "z")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    @tk.trimmed
    def run(group: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        band = group.column("band")[0].as_py()
        rep, comp, size = (group.column(k).to_numpy() for k in ("rep", "component", "n_shingles"))
        earlier = np.array(group.column("bands").to_pylist(), np.int64).reshape(len(rep), -1)[:, :band]
        label = np.unique(comp, return_inverse=True)[1]
        main = ~group.column("stray").to_numpy()
        kind, side = group.column("kind")[0].as_py(), group.column("part").to_numpy()
        halves = kind == 1 and group.column("x")[0].as_py() != group.column("y")[0].as_py()
        z = group.column("z")
        blocks = _blocks(np.array([zstandard.frame_content_size(x.as_py()) for x in z], np.int64), BLOCK)
        sets_of = lambda part: _sets_of([unpack(z[int(i)].as_py()) for i in part], width)

        def others(i: int, part: np.ndarray) -> np.ndarray:
            # of two strays, the later one looks at the earlier one; each in one group only
            if kind == 2:
                part = part[main[part]]
            elif halves:
                part = part[side[part] != side[i]]
            part = part[(main[part] | (part < i)) & (label[part] != label[i]) & (100 * np.minimum(size[part], size[i]) >= percent * np.maximum(size[part], size[i]))]
            return part[~(earlier[part] == earlier[i]).any(axis=1)]

        links = []
        for part in blocks:
            index = None
            for some in blocks:
                todo = [int(i) for i in some if not main[i] and len(others(i, part))]
                if not todo:
                    continue
                if index is None:
                    index = SetIndex(sets_of(part))
                for i, own in zip(todo, _sets_of([unpack(z[i].as_py()) for i in todo], width), strict=True):
                    found = others(i, part)
                    if not len(found):
                        continue
                    shared = index.shared(own)[found - part[0]]
                    for j in found[100 * shared >= percent * (size[i] + size[found] - shared)]:
                        if label[i] != label[j]:
                            label[label == label[j]] = label[i]
                            links.append((int(rep[i]), int(rep[j])))
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

    return rows.join(texts, "rep").groupBy("band", "key", "kind", "x", "y").applyInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    begin = scratch.mark()
    rows = band_rows(percent)
    signed = scratch.save(sign(docs, width, rows))
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    reps = scratch.save(linked.join(classes, ["d1", "d2"]).where("doc_id = rep").select("rep", "n_shingles", "bands").dropDuplicates(["rep"]))
    all_buckets = reps.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    centres = all_buckets.groupBy("band", "key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = scratch.save(all_buckets.join(centres, ["band", "key"]))
    scratch.release(spark)
    star = buckets.where("rep <> centre").groupBy(F.col("rep").alias("u")).agg(F.min("centre").alias("v"))
    links = scratch.save(verify(_sized(star, reps, percent), docs, width, percent))
    scratch.release(spark)
    component = connected_components(links)
    more = scratch.save(_across(buckets, component, reps, docs, width, percent))
    if not more.isEmpty():
        component = connected_components(more.union(component.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    scratch.drop_since(begin, signed, classes, component)
    scratch.release(spark)
    named = classes.join(component, classes.rep == component.node, "left").select("d1", "d2", F.coalesce("component", "rep").alias("found"))
    out = signed.join(named, ["d1", "d2"], "left")
    least = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", least.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
