"""Enrichment as a stream: payloads come in, the profiles of those people change whose content does.

A micro-batch's payloads are parsed to contributions and kept as a segment. The people in it are merged
anew from all their contributions, and those whose merged content has another fingerprint than before get
a new profile, in a segment as well; the others' profiles aren't touched. Contributions and profiles are
published together with the number of the micro-batch, so one that is replayed after a failure changes
nothing, whether it had been published or not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators import merge
from tarnwick.versions import Store

#: Above so many segments they are put together.
MOST_SEGMENTS = 8


#: A micro-batch with fewer rows than this share of the store's picks its people's rows out before they move.
SMALL_BATCH = 0.1


def _keyed(contributions: DataFrame) -> DataFrame:
    """Contributions with the keys and years of their entries, which are written anew as JSON. Segments have
    them, so an entry is parsed once; those of earlier versions may lack them."""
    if "key" in contributions.columns:
        return contributions
    return merge.keyed(contributions.withColumn("entry", F.try_parse_json("entry"))).withColumn("entry", F.to_json("entry"))


def _with_keys(profiles: DataFrame) -> DataFrame:
    """Profiles whose entries have their keys; those of earlier versions may lack them."""
    if "key" in profiles.schema["entries"].dataType.elementType.names:
        return profiles
    return profiles.withColumn("entries", F.transform("entries", lambda e: e.withField("key", merge.variant_key(e["field"], F.try_parse_json(e["entry"])))))


def _segments(store: Store, kind: str, manifest: dict) -> list[tuple[int, DataFrame]]:
    """All segments of a kind with the number of each, rising."""
    complete = {"contributions": _keyed, "profiles": _with_keys}[kind]
    return sorted(((int(name.split("-")[1]), complete(store._table(entry))) for name, entry in manifest["tables"].items() if name.startswith(f"{kind}-")), key=lambda s: s[0])


def _union(segments: list[tuple[int, DataFrame]]) -> DataFrame:
    """The rows of some segments, with the number of each."""
    return reduce(DataFrame.unionByName, (rows.withColumn("_segment", F.lit(number)) for number, rows in segments))


def _newest(segments: list[tuple[int, DataFrame]]) -> DataFrame | None:
    """Of profiles (or some of their columns) each person's newest; None without segments. Those of the last
    segment stay where they are, of older ones those go whom a later one has."""
    out, later = None, None
    for _, rows in reversed(segments):
        people = rows.select("person_id")
        kept = rows if later is None else rows.join(later, "person_id", "left_anti")
        out = kept if out is None else out.unionByName(kept)
        later = people if later is None else later.unionByName(people)
    return out


def profiles(store: Store, version: int | None = None) -> DataFrame | None:
    """Each person's newest profile: person_id, entries, raw_hash; None before the first."""
    return _newest(_segments(store, "profiles", store.manifest(version)))


def _merged(contributions: DataFrame) -> DataFrame:
    """Profiles of ``contributions(person_id, field, source, confidence, pos, entry)``, entry as JSON, with keys
    or without."""
    rows = merge.merge_keyed(_keyed(contributions), ["person_id"])
    entry = F.struct("field", F.col("place").cast("long").alias("place"), "entry", "sources", "key")
    profile = rows.groupBy("person_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return profile.withColumn("raw_hash", F.sha2(F.to_json("entries"), 256))


def _current(own: DataFrame) -> DataFrame:
    """Of contributions with their segments what each source said last. They are dealt by person and sorted,
    so that what follows neither moves them nor sorts them anew."""
    dealt = own.repartition("person_id").sortWithinPartitions("person_id", "field", "source")
    newest = Window.partitionBy("person_id", "field", "source")
    return dealt.withColumn("_newest", F.max("_segment").over(newest)).where("_segment = _newest").drop("_newest")


def _profiled(own: DataFrame) -> DataFrame:
    """Profiles by what each source said last, of contributions with their segments. All is by person and more,
    so rows move once."""
    return _merged(_current(own).drop("_segment"))


def apply_batch(store: Store, contributions: DataFrame, epoch: int) -> None:
    """One micro-batch. What a person's source says replaces what it said before."""
    manifest = store.manifest()
    if manifest["notes"].get("epoch", -1) >= epoch:
        return
    number = epoch + 1
    batch = _keyed(contributions.select("person_id", "field", "source", "confidence", "pos", "entry"))
    have, known = _segments(store, "contributions", manifest), _segments(store, "profiles", manifest)
    had = sum(entry["rows"] for name, entry in manifest["tables"].items() if name.startswith("contributions-"))

    def changed(batch: DataFrame) -> DataFrame:
        if not have:
            return _merged(batch.repartition("person_id"))
        rows = _union(have)
        if batch.count() < had * SMALL_BATCH:
            rows = rows.join(batch.select("person_id").distinct(), "person_id", "left_semi")
        own = _current(rows.unionByName(_union([(number, batch)])))
        # of people of whom the batch says nothing no row is new
        heard = F.max("_segment").over(Window.partitionBy("person_id")) == number
        new = _merged(own.withColumn("_heard", heard).where("_heard").drop("_heard", "_segment"))
        old = _newest([(n, rows.select("person_id", F.col("raw_hash").alias("_hash"))) for n, rows in known])
        return new.join(old, "person_id", "left").where(~F.col("raw_hash").eqNullSafe(F.col("_hash"))).select(new.columns)

    # the profiles are made of the batch as it was written, so it is parsed once
    store.publish({f"contributions-{number}": batch, f"profiles-{number}": changed}, manifest["version"], {"epoch": epoch})
    if sum(name.startswith("profiles-") for name in store.manifest()["tables"]) > MOST_SEGMENTS:
        compact(store)


def compact(store: Store) -> None:
    """The segments as one, without what later ones replace."""
    manifest = store.manifest()
    have = _segments(store, "contributions", manifest)
    numbers = [n for n, _ in have]
    last = max(numbers)
    tables = {f"contributions-{last}": _current(_union(have)).drop("_segment"), f"profiles-{last}": profiles(store)}
    store.publish(tables, manifest["version"], drop=[f"{kind}-{n}" for n in numbers if n != last for kind in ("contributions", "profiles")])


def enrich_stream(payloads: DataFrame, parse: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str) -> None:
    """Work through what the stream ``payloads`` has; ``parse`` maps a micro-batch to its contributions."""
    write = lambda batch, epoch: apply_batch(store, parse(batch), epoch)
    payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
