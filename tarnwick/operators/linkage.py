"""Record linkage between people and roster rows, and duplicate handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.names import author_key, compatible, whole_compatible
from tarnwick.functions.text import email_local, letters_only


def tiered_match(people: DataFrame, roster: DataFrame) -> DataFrame:
    """Each person's best roster row: person_id, roster_id, tier.

    ``people(person_id, first, last, email)``, ``roster(roster_id, pos, first, last, email)``. Tiers:
    1 equal address, 2 equal local part, both with compatible names; 3 equal normalised names;
    4 one last name within the other and one whole first name beginning the other, only for people whom
    the first three leave. Within a tier the first roster row by pos counts. Of rows with equal keys the
    last is kept, at the place of the first.

    Both sides are keyed in one pass, so tiers 1 to 3 are one equi-join on (tier, key). So is tier 4: its
    first names share their first letter, and the beginning (three letters, or all of a shorter name)
    of one last name is a piece of the other; what meets by letter and piece is checked in full.
    """

    def side(df: DataFrame, tag: str, *kept: str) -> DataFrame:
        f, n = letters_only(F.col("first")), letters_only(F.col("last"))
        mail, local = F.lower(F.trim("email")), email_local(F.col("email"))
        named = (f != "") & (n != "")
        keys = F.array(F.struct(F.lit(1).alias("tier"), mail.alias("key")), F.struct(F.lit(2).alias("tier"), F.when(mail != "", local).alias("key")), F.struct(F.lit(3).alias("tier"), F.when(named, author_key(F.col("first"), F.col("last"))).alias("key")))
        return df.select(*kept, f.alias(f"{tag}f"), n.alias(f"{tag}l"), F.explode(F.filter(keys, lambda k: F.coalesce(k["key"] != "", F.lit(False)))).alias("k")).select("*", "k.*").drop("k")

    same_key = Window.partitionBy("tier", "key")
    index = side(roster, "t", "roster_id", "pos").withColumns({"at": F.min("pos").over(same_key), "newest": F.max("pos").over(same_key)}).where("pos = newest")
    ours = side(people, "o", "person_id")
    named = compatible(F.col("of"), F.col("ol"), F.col("tf"), F.col("tl"))
    exact = ours.join(index, ["tier", "key"]).where((F.col("tier") == 3) | named).select("person_id", "roster_id", "tier", "at")

    # whoever has names has the key of tier 3
    left = ours.where("tier = 3").select("person_id", "of", "ol").join(exact.select("person_id").distinct(), "person_id", "left_anti")
    theirs = index.where("tier = 3").select("roster_id", "at", "tf", "tl")
    block = lambda f, piece: F.concat(F.left(f, F.lit(1)), F.lit("|"), piece)
    begin = lambda f, n: block(f, F.left(n, F.lit(3)))

    def pieces(f: Column, n: Column) -> Column:
        spots = F.sequence(F.lit(1), F.length(n))
        return F.explode(F.array_distinct(F.flatten(F.transform(spots, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.length(n) - i + 1)), lambda k: block(f, F.substring(n, i, k)))))))

    ours_within = left.withColumn("block", begin(F.col("of"), F.col("ol"))).join(theirs.withColumn("block", pieces(F.col("tf"), F.col("tl"))), "block")
    theirs_within = left.withColumn("block", pieces(F.col("of"), F.col("ol"))).join(theirs.withColumn("block", begin(F.col("tf"), F.col("tl"))), "block")
    whole = whole_compatible(F.col("of"), F.col("ol"), F.col("tf"), F.col("tl"))
    found = lambda df: df.where(whole).select("person_id", "roster_id", F.lit(4).alias("tier"), "at")
    # a pair that meets in both counts once, as only the first place is taken
    order = Window.partitionBy("person_id").orderBy("tier", "at", "roster_id")
    return exact.union(found(ours_within)).union(found(theirs_within)).withColumn("place", F.row_number().over(order)).where("place = 1").select("person_id", "roster_id", "tier")


def claims(matches: DataFrame) -> DataFrame:
    """``matches`` with claimed: false for all but the first person (by id) of a roster row."""
    return matches.withColumn("claimed", F.row_number().over(Window.partitionBy("roster_id").orderBy("person_id")) == 1)


def dedupe_people(rows: DataFrame, key: Column, preferred: Column, pos: str) -> DataFrame:
    """One row for each key: the first preferred one, else the first."""
    order = Window.partitionBy(key).orderBy(preferred.desc(), pos)
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def merge_lists(lists: Sequence[DataFrame], keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows of all lists by lower-case keys: the first non-blank value of each field, in the lists'
    order, and how many lists have the key."""
    union = None
    for i, rows in enumerate(lists):
        part = rows.select(F.lit(i).alias("_list"), *(F.lower(k).alias(f"_{k}") for k in keys), *fields)
        union = part if union is None else union.union(part)
    value = lambda f: F.min_by(F.struct(f), F.when((F.col(f).isNotNull()) & (F.col(f) != ""), F.struct("_list", f)))[f].alias(f)
    return union.groupBy(*(f"_{k}" for k in keys)).agg(*(value(f) for f in fields), F.count_distinct("_list").alias("n_lists")).drop(*(f"_{k}" for k in keys))
