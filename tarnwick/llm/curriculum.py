"""Mixing sources to target weights along a curriculum, in Spark's own expressions only.

A source's size is the words of its documents. Sources, by code point and null last, weigh 3, 1, 2 and
so on again, and share 1.5 times all words by weight; none gets more than twice its size, and what it
can't take is shared again by weight. That is a water level: target = min(2 size, level * weight), and
sources reach their limits in the order of size / weight, so prefix sums in that order give the level.

A source's documents, in the order of a digest, are its stream, of which the mix takes the first
floor(target) words, running through it at most twice: copies begin where the stream's cumulative demand
has come to, and the last one taken may end within a document.

Over training time u from 0 to 1 a source is wanted with a weight that runs in straight lines between
the knots of its schedule. The integral of the weight, scaled to the source's total, is its cumulative
demand at u; inverting it at a copy's first word gives the copy's position, where the demand reaches it.
Sorted by range of position, the copies are the training order, in which each source comes at its rate.

Running totals go in two steps: within slices by the digest, and over the slices' totals. Of n rows there
are sqrt(n) slices, so at any size neither step sorts more than some sqrt(n) rows of a source together,
however hot it is.

Defined cases: null or empty text has size 0 and is never taken; without any word all targets are 0;
null source is a source of its own; rows that share a doc_id are documents of their own (the digest
takes the text in; rows alike in both are interchangeable and share a slice, which is sorted on disk
if need be); a very long text is one number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: The weights in turn, the share of all words, the most copies of a document.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2
#: Relative weights at equally spaced times from the begin to the end of training, in turn by source:
#: steady, late and early ones.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.6, 1.0, 0.4))


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_turn(values: tuple, number: Column) -> Column:
    """The value that is the ``number``-th (from 1) one's, repeating."""
    return F.element_at(F.array(*[F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for v in values]), (F.pmod(number - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source, with number, weight and target. The sources,
    not the documents, are sorted as a whole."""
    numbered = sizes.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    numbered = numbered.withColumn("weight", in_turn(weights, F.col("number")).cast("double"))
    limit = F.col("source_size") * copies
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    all_, before = lambda c: F.sum(c).over(everything), lambda c: F.coalesce(F.sum(c).over(by_limit), F.lit(0))
    left = (all_("source_size") * share - before(limit)).cast("double")
    level = left / (all_("weight") - before("weight"))
    # the level where the first source stays within its limit is everyone's; earlier ones are at theirs, and
    # behind it the same quotient only falls
    out = numbered.withColumn("level", F.when(F.col("weight") * level <= limit, level))
    out = out.withColumn("level", F.max("level").over(everything))
    return out.select("source", "source_size", "number", "weight", F.least(limit.cast("double"), F.col("weight") * F.col("level")).alias("target"))


def slice_count(rows: int) -> int:
    return math.isqrt(rows) + 1


def inverse(done: Column, knots: Column) -> Column:
    """The time at which a share ``done`` of all demand is reached under weights in straight lines between
    ``knots``, equally spaced in time."""
    n = F.size(knots) - 1
    areas = F.transform(F.sequence(F.lit(1), n), lambda i: (F.element_at(knots, i) + F.element_at(knots, i + 1)) / 2)
    total = F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    first = F.struct(F.lit(0).alias("piece"), (done * total).alias("left"))
    # the piece in which the demand falls, and what is left of it there
    at = F.aggregate(F.slice(areas, 1, n - 1), first, lambda a, x: F.when((a["left"] >= x) & (a["piece"] >= 0), F.struct((a["piece"] + 1).alias("piece"), (a["left"] - x).alias("left"))).otherwise(F.struct(F.when(a["piece"] >= 0, -a["piece"] - 1).otherwise(a["piece"]).alias("piece"), a["left"].alias("left"))))
    piece = F.when(at["piece"] < 0, -at["piece"] - 1).otherwise(at["piece"])
    begin, slope = F.element_at(knots, piece + 1), F.element_at(knots, piece + 2) - F.element_at(knots, piece + 1)
    # begin x + slope x^2 / 2 = left, in the form that holds for slope 0 as well
    root = F.sqrt(F.greatest(begin * begin + 2 * slope * at["left"], F.lit(0.0)))
    x = F.when(at["left"] <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * at["left"] / (begin + root)))
    return (piece + x) / n


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, copies: int = COPIES, schedules: tuple = SCHEDULES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and ``copies``, an array of struct(position, words),
    of every row of ``docs(doc_id, text, source)``."""
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    sized = scratch.save(docs.select("doc_id", "source", words(F.col("text")).alias("size"), digest.alias("digest")))
    slices = F.lit(slice_count(sized.count()))
    # what has no word moves no total, and goes anywhere
    place = F.when(F.col("size") > 0, F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32)))
    key = F.concat(F.lit("="), F.col("source"))
    sized = sized.withColumns({"key": F.coalesce(key, F.lit("")), "slice": F.floor(place * slices / float(1 << 32)).cast("long")})

    totals = scratch.save(sized.groupBy("key", "source", "slice").agg(F.sum("size").alias("words")))
    sources = scratch.save(targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, copies))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("key", "source", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(sources, starts.source.eqNullSafe(sources.source)).drop("source")

    within = Window.partitionBy("key", "slice").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = ranked.join(starts, ["key", "slice"]).withColumn("at", F.col("start") + F.col("inside"))
    wanted = F.floor("target").cast("long")

    def copy(k: Column) -> Column:
        begin = k * F.col("source_size") + F.col("at")
        got = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - begin))
        return F.struct(inverse(F.try_divide(begin, wanted), in_turn(schedules, F.col("number"))).alias("position"), got.alias("words"))

    made = F.filter(F.transform(F.array(*[F.lit(k).cast("long") for k in range(copies)]), copy), lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return rows.withColumn("copies", made).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "digest")


def training_order(mixed: DataFrame) -> DataFrame:
    """The copies of a mix, sorted by range of position: doc_id, source, position, words."""
    one = mixed.select("doc_id", "source", "digest", F.explode("copies").alias("c")).select("doc_id", "source", "digest", "c.*")
    return one.orderBy("position", "digest", "doc_id").select("doc_id", "source", "position", "words")


def mixed_by_position(docs: DataFrame) -> DataFrame:
    """The mix sorted by range of each document's first position, documents not taken at the end:
    doc_id, size, source_size, target, taken, position, next_position."""
    scope = scratch.mark()
    position = lambda k: F.get(F.col("copies.position"), F.lit(k))
    # written first, as a sort by ranges goes through its input twice
    rows = scratch.save(mix(docs).select("doc_id", "size", "source_size", "target", "taken", position(0).alias("position"), position(1).alias("next_position"), "digest"))
    out = scratch.save(rows.orderBy(F.col("position").asc_nulls_last(), "digest").select("doc_id", "size", "source_size", "target", "taken", "position", "next_position"))
    scratch.drop_since(scope, out)
    return out


def oracle() -> str:
    """The contract's columns of :func:`mixed_by_position`; positions are tested by brute force."""
    return r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS digest FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s),
    w AS (SELECT *, [3, 1, 2][(number - 1) % 3 + 1] AS weight FROM n), o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
      coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, coalesce(sum(weight) OVER (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
    l AS (SELECT *, (total * 1.5 - full_before)::DOUBLE / (weights - weight_before)::DOUBLE AS own FROM o), t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, weight * max(CASE WHEN weight * own <= 2 * source_size THEN own END) OVER ()) AS target FROM l),
    r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
    SELECT doc_id, size::BIGINT AS size, source_size, target, (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - source_size - start)))::BIGINT AS taken FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source"""
