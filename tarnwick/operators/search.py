"""Ranked full-text search by BM25 over an inverted index kept as DataFrames.

The index is postings (term, doc_id, tf, length) and one row of corpus statistics, which are always taken
before any filter. A query has few terms, so its side is a literal: each prefix is a predicate on
postings, pushed to their scan, and only matching postings are aggregated. Written in the order of its
terms, the index is read by row groups; it grows by segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import workspace
from tarnwick.functions.stem import plain, porter, unaccented
from tarnwick.versions import Store

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Postings that are sorted at once.
RUN = 1 << 20


@dataclass
class Index:
    """postings(term, doc_id, tf, length) and stats(n, total), one row."""

    postings: DataFrame
    stats: DataFrame
    stemmed: bool = True


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings_of(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """The postings of ``docs(doc_id, text)``, counted and stemmed within each document: nothing is shuffled.
    Words of one stem are postings of their own, which a search adds up."""
    words = docs.select("doc_id", F.sort_array(tokens(F.col("text"))).alias("words"))
    words = words.select("doc_id", "words", F.size("words").alias("n"), F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: (i < F.size("words")) & ((i == 0) | (F.get("words", i) != F.get("words", i - 1)))).alias("first"))
    runs = F.transform("first", lambda at, i: F.struct(F.get("words", at).alias("term"), (F.coalesce(F.get("first", i + 1), F.col("n")) - at).cast("long").alias("tf")))
    counted = words.select("doc_id", F.col("n").cast("long").alias("length"), F.explode(runs).alias("run")).select("run.term", "doc_id", "run.tf", "length")
    if not stemmed:
        return counted
    bare = F.when(F.col("term").rlike(r"[^\x00-\x7F]"), plain(F.col("term"))).otherwise(F.col("term"))
    return counted.select(bare.alias("term"), "doc_id", "tf", "length").mapInArrow(_stems, counted.schema)


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word is stemmed once in each task, of the last million words that it met."""
    known: dict[str, str] = {}
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        if len(known) > 1 << 20:
            known.clear()
        stems = [known[w] if w in known else known.setdefault(w, porter(w)) for w in coded.dictionary.to_pylist()]
        term = pa.array(stems, batch.schema.field(0).type).take(coded.indices)
        yield pa.RecordBatch.from_arrays([term, *batch.columns[1:]], schema=batch.schema)


def lengths_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("length"))


def build_index(docs: DataFrame, stemmed: bool = True) -> Index:
    """An index of ``docs(doc_id, text)`` that is worked out anew by every search."""
    stats = lengths_of(docs).agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    return Index(postings_of(docs, stemmed), stats, stemmed)


def in_order(postings: DataFrame) -> DataFrame:
    """Sorted by term in runs of a million rows, so that a prefix reads some pages of each run. Neither a shuffle
    nor a sort of whole files, which both would write the postings to disk once more."""
    return postings.mapInArrow(_sorted_runs, postings.schema)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        coded = rows.column(0).chunk(0).dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        yield from rows.take(np.argsort(rank[coded.indices.to_numpy()], kind="stable")).to_batches(max_chunksize=1 << 16)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= RUN:
            yield from run()
            held, n = [], 0
    if held:
        yield from run()


def stored(index: Index) -> Index:
    """``index`` written once in the shared folder, to serve all searches."""
    return Index(workspace.save(in_order(index.postings)), workspace.save(index.stats), index.stemmed)


def query_terms(query: str, stemmed: bool = True) -> list[str]:
    """Distinct tokens of two characters or more; accents come off where the index is stemmed."""
    found = [t for t in re.findall(r"[^\W_]+", query.lower()) if len(t) >= 2]
    return list(dict.fromkeys(porter(unaccented(t)) if stemmed else t for t in found))


def bm25(index: Index, terms: Sequence[str], every: bool = True) -> DataFrame:
    """doc_id and score (the lower, the better) of documents in which all of the prefixes ``terms``
    (or any, unless ``every``) occur."""
    spark = index.postings.sparkSession
    if not terms:
        return spark.createDataFrame([], "doc_id long, score double")
    hit = [F.startswith("term", F.lit(t)) for t in terms]
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    tf = index.postings.where(any_hit).groupBy("doc_id").agg(F.max("length").alias("length"), *(F.sum(F.when(h, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, h in enumerate(hit)))
    found = tf.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(terms))))
    stats = index.stats.select("n", F.try_divide("total", "n").alias("mean"))
    # stats and found are one row each
    rows = tf.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(found))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
        idf = F.when(F.col("n") - F.col(f"n{i}") <= F.col(f"n{i}"), F.lit(LEAST_IDF)).otherwise(idf)
        t = F.col(f"tf{i}").cast("double")
        score = score - idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.try_divide("length", "mean")))
    if every:
        for i in range(len(terms)):
            rows = rows.where(F.col(f"tf{i}") > 0)
    return rows.select("doc_id", score.alias("score"))


def search(index: Index, query: str, limit: int = 20, every: bool = True) -> DataFrame:
    """The best ``limit`` documents; ties go to the lower doc_id."""
    return bm25(index, query_terms(query, index.stemmed), every).orderBy("score", "doc_id").limit(limit)


class SegmentedIndex:
    """An index that changes with its documents.

    What is new or changed is written as a further segment, with the ids whose older postings count no
    more; nothing is rewritten. A posting is alive unless a later segment names its document. The number
    of documents and of tokens is kept exactly, in each version's manifest. When the newest segments are
    no smaller than half of the one before, they are merged into it without their dead postings, so there
    are some log(documents) segments, and each posting is written as often.
    """

    def __init__(self, spark: SparkSession, folder: str, stemmed: bool = True):
        self.store, self.stemmed = Store(spark, folder), stemmed
        self.spark = spark

    def _segments(self, manifest: dict) -> list[int]:
        return sorted(int(n.split("-")[1]) for n in manifest["tables"] if n.startswith("postings-"))

    def _alive(self, manifest: dict, kind: str, segments: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of ``kind`` of some segments (all) that no later segment names."""
        every = self._segments(manifest)
        out = None
        for s in every if segments is None else segments:
            rows = self.store._table(manifest["tables"][f"{kind}-{s}"]).withColumn("segment", F.lit(s))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return None
        gone = self._gone(manifest, every)
        if gone is None:
            return out.drop("segment")
        last = gone.groupBy("doc_id").agg(F.max("until").alias("until")).withColumnRenamed("doc_id", "gone")
        return out.join(last, (F.col("doc_id") == F.col("gone")) & (F.col("segment") < F.col("until")), "left_anti").drop("segment")

    def _gone(self, manifest: dict, segments: Sequence[int]) -> DataFrame | None:
        out = None
        for s in segments:
            if manifest["tables"][f"gone-{s}"]["rows"]:
                rows = self.store._table(manifest["tables"][f"gone-{s}"]).withColumn("until", F.lit(s))
                out = rows if out is None else out.unionByName(rows)
        return out

    def index(self, version: int | None = None) -> Index:
        """What a search reads, as of a version."""
        manifest = self.store.manifest(version)
        postings = self._alive(manifest, "postings")
        if postings is None:
            postings = self.spark.createDataFrame([], "term string, doc_id long, tf long, length long")
        notes = manifest["notes"]
        stats = self.spark.range(1).select(F.lit(notes.get("n", 0)).cast("long").alias("n"), F.lit(notes.get("total", 0)).cast("long").alias("total"))
        return Index(postings, stats, self.stemmed)

    def apply(self, changed: DataFrame, removed: DataFrame | None = None, merge: bool = True) -> int:
        """``changed(doc_id, text)``, one row each, in place of what the index has of them, and without
        ``removed(doc_id)``. Returns the new version."""
        parent = self.store.current()
        manifest = self.store.manifest(parent)
        segments = self._segments(manifest)
        number = max(segments, default=0) + 1
        keys = changed.select("doc_id")
        keys = (keys.union(removed.select("doc_id")) if removed is not None else keys).distinct()
        old = self._alive(manifest, "lengths")
        replaced = workspace.save(old.join(keys, "doc_id", "left_semi")) if old is not None else None
        lengths = workspace.save(lengths_of(changed))
        total = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())
        more, less = total(lengths), total(replaced) if replaced is not None else (0, 0)
        notes = {"n": manifest["notes"].get("n", 0) + more[0] - less[0], "total": manifest["notes"].get("total", 0) + more[1] - less[1]}
        gone = replaced.select("doc_id") if replaced is not None else lengths.select("doc_id").limit(0)
        version = self.store.publish({f"postings-{number}": in_order(postings_of(changed, self.stemmed)), f"lengths-{number}": lengths, f"gone-{number}": gone}, parent, notes)
        for df in (replaced, lengths):
            if df is not None:
                workspace.drop(df)
        return self.merge() if merge else version

    def merge(self) -> int:
        """The newest segments as one, while they are at least half as large as the one before."""
        version = self.store.current()
        manifest = self.store.manifest(version)
        segments = self._segments(manifest)
        size = {s: manifest["tables"][f"lengths-{s}"]["rows"] + manifest["tables"][f"gone-{s}"]["rows"] for s in segments}
        first, held = len(segments) - 1, size[segments[-1]] if segments else 0
        while first > 0 and 2 * held >= size[segments[first - 1]]:
            first -= 1
            held += size[segments[first]]
        part = segments[first:]
        if len(part) < 2:
            return version
        number = part[-1]
        tables = {f"{kind}-{number}": self._alive(manifest, kind, part) for kind in ("postings", "lengths")}
        tables[f"postings-{number}"] = in_order(tables[f"postings-{number}"])
        gone = self._gone(manifest, part)
        # of the oldest segment nothing is older, so nothing that it names is left
        empty = tables[f"lengths-{number}"].select("doc_id").limit(0)
        tables[f"gone-{number}"] = empty if first == 0 or gone is None else gone.select("doc_id").distinct()
        return self.store.publish(tables, version, drop=[f"{kind}-{s}" for s in part[:-1] for kind in ("postings", "lengths", "gone")])


def keyword_overlap(docs: DataFrame, keywords: Sequence[str], limit: int) -> DataFrame:
    """Documents by how many keywords their lower-case text contains."""
    low = F.lower(F.coalesce("text", F.lit("")))
    n = sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    return docs.select("doc_id", n.alias("n_keywords")).orderBy(F.col("n_keywords").desc(), "doc_id").limit(limit)
