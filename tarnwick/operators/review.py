"""Review of identities: how candidates are gathered, offered, decided and taken back.

Candidates are rows with id, person_id, source, external_id, display_name, score, status, decided_at,
orcid and, where noted, what was checked. Each function maps tables to their new state (and a log), as
:mod:`tarnwick.operators.snapshot` does; people and candidates are joined by person, never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.names import similarity
from tarnwick.functions.text import last_path_part
from tarnwick.operators.budget import with_lookups
from tarnwick.operators.identity import AUTO_SCORE, LEAST_SCORE, RECORD_NAME, TIE_MARGIN, best_name, corroboration, decide, merge_reason, no_footprint, with_alternate
from tarnwick.operators.rules import first_match

#: The score of a candidate found by the person register alone, and how many spellings are tried.
REGISTER_SCORE, MOST_VARIANTS = 0.8, 4

LOG = ["person_id", "source_name", "field_updated", "old_value", "new_value", "method", "retrieved_at"]


@dataclass
class State:
    people: DataFrame
    candidates: DataFrame
    log: DataFrame


# Gathering


def recall_cascade(hits: DataFrame) -> DataFrame:
    """Of ``hits(person_id, tier, pos, external_id, score, affiliated)`` those of each person's first tier
    that has any: 0 by the exact name, 1 by spellings (each profile once, as first met), 2 without the
    filter by institution, where only affiliated ones count. By falling score, ties as met."""
    good = hits.where((F.col("score") >= LEAST_SCORE) & ((F.col("tier") < 2) | F.coalesce(F.col("affiliated"), F.lit(False))))
    met = Window.partitionBy("person_id", "tier", "external_id").orderBy("pos")
    once = good.withColumn("nth", F.row_number().over(met)).where((F.col("nth") == 1) | (F.col("tier") != 1)).drop("nth")
    first = once.groupBy("person_id").agg(F.min("tier").alias("tier"))
    kept = once.join(first, ["person_id", "tier"])
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("person_id").orderBy(F.col("score").desc(), "pos")))


def register_candidate(found: DataFrame) -> DataFrame:
    """The candidate that a person register gives where the author index has none, from
    ``found(person_id, orcid, hits, affiliated, employed, name_similarity, email_match)``: affiliated
    records only, at a fixed score, with what was verified."""
    return found.where(F.col("orcid").isNotNull() & F.col("affiliated")).select(
        "person_id", F.lit("orcid").alias("source"), F.col("orcid").alias("external_id"), F.lit(REGISTER_SCORE).alias("score"), (F.col("hits") == 1).alias("unique_hit"), F.col("employed").alias("employment_verified"), F.col("name_similarity").alias("record_name_similarity"), F.col("email_match").alias("record_email_match")
    )


def exact_primary_name(first: Column, last: Column, display_name: Column) -> Column:
    """Whether the name that a profile shows (its first and last words, not an alias) is the person's."""
    words = F.split(F.trim(F.coalesce(display_name, F.lit(""))), r"\s+")
    return (F.size(words) >= 2) & (similarity(first, last, F.get(words, F.lit(0)), F.element_at(words, -1)) == 1.0)


def may_corroborate(source: Column, name: Column, exact: Column, affiliated: Column, orcid: Column) -> Column:
    """Whether it is worth verifying an indexed profile's ORCID: a full match of the shown name, and an
    affiliation."""
    return F.coalesce((source == "openalex") & (name == 1.0) & exact & affiliated & orcid.isNotNull(), F.lit(False))


def corroborates(employed: Column, name: Column) -> Column:
    """What a verified ORCID record must show; what couldn't be fetched doesn't."""
    return F.coalesce(employed & (F.coalesce(name, F.lit(0.0)) >= RECORD_NAME), F.lit(False))


def fallback_qualifies(email_match: Column, unique: Column, employed: Column, name: Column) -> Column:
    """Whether a register candidate is accepted as it is: it shows the person's address, or it is the
    only hit, employed there, under exactly that name."""
    return F.coalesce(email_match, F.lit(False)) | F.coalesce(unique & employed & (name == 1.0), F.lit(False))


def offered_to_model(candidates: DataFrame) -> DataFrame:
    """Pending candidates that a model may judge: a person's indexed ones if there are any, else those
    of the register."""
    pending = candidates.where("status = 'pending'")
    indexed = F.max((F.col("source") == "openalex").cast("int")).over(Window.partitionBy("person_id"))
    return pending.withColumn("indexed", indexed).where((F.col("source") == "openalex") == (F.col("indexed") == 1)).drop("indexed")


# The queue


def refreshed(candidates: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """``candidates`` with the pending ones of the people in ``found`` replaced by those of ``found``."""
    anew = found.select("person_id").distinct()
    kept = candidates.where("status <> 'pending'").unionByName(candidates.where("status = 'pending'").join(anew, "person_id", "left_anti"))
    return kept.unionByName(found.withColumns({"status": F.lit("pending"), "created_at": now}), allowMissingColumns=True)


def annotated(candidates: DataFrame, verdicts: DataFrame, now: Column, model: str) -> DataFrame:
    """Pending candidates get a model's verdict, confidence and reasoning; the others stay as they are."""
    v = verdicts.select("id", *(F.col(c).alias(f"_{c}") for c in ("verdict", "confidence", "reasoning")), F.lit(True).alias("_judged"))
    rows = candidates.join(v, "id", "left")
    hit = (F.col("status") == "pending") & F.coalesce(F.col("_judged"), F.lit(False))
    new = {"llm_verdict": F.col("_verdict"), "llm_confidence": F.col("_confidence"), "llm_reasoning": F.col("_reasoning"), "llm_evaluated_at": now, "llm_model": F.lit(model)}
    old = lambda c: F.col(c) if c in candidates.columns else F.lit(None)
    return rows.withColumns({c: F.when(hit, x).otherwise(old(c)) for c, x in new.items()}).drop("_verdict", "_confidence", "_reasoning", "_judged")


def review_order(candidates: DataFrame) -> DataFrame:
    """One row for each person with pending candidates, in the order of review: those with one that the
    model accepts, the surest first; then the others; last those whose candidates it all rejects. Ties
    by name."""
    pick = F.max(F.when(F.col("llm_verdict") == "accept", F.coalesce(F.col("llm_confidence"), F.lit(0.0))))
    none = F.bool_and(F.coalesce(F.col("llm_verdict") == "reject", F.lit(False)))
    groups = candidates.where("status = 'pending'").groupBy("person_id", "name").agg(F.count("*").alias("n"), pick.alias("pick"), none.alias("none"))
    tier = F.when(F.col("pick").isNotNull(), 0).when(F.col("none"), 2).otherwise(1)
    return groups.select("person_id", "name", "n", tier.alias("tier"), F.coalesce("pick", F.lit(0.0)).alias("confidence")).orderBy("tier", F.col("confidence").desc(), "name", "person_id")


# Decisions


def decided(people: DataFrame, candidates: DataFrame, decisions: DataFrame, now: Column, reject_siblings: bool = False) -> State:
    """After ``decisions(id, decision[, pos])`` of accept, merge and reject, taken one by one: in the order
    of pos, without it of id. A candidate that isn't pending any more is left alone. A merge without a
    primary profile, or of a register's candidate, is an acceptance, so the second profile that is
    accepted or merged in a batch meets what the first one wrote. Accepting writes ids only where there
    are none, merging adds an alternate, and who is accepted is confirmed; ``reject_siblings`` rejects the
    person's other pending candidates at that moment, and later decisions about them change nothing."""
    pos = F.col("pos") if "pos" in decisions.columns else F.lit(0)
    acts = decisions.select("id", "decision", pos.alias("pos")).join(candidates.where("status = 'pending'").select("id", "person_id", "source", "external_id", "orcid"), "id")
    # a person has a few candidates, so a few decisions
    queue = acts.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "decision", "source", "external_id", "orcid"))).alias("queue"))
    rows = people.select("id", "openalex_id", "orcid", "openalex_id_alt").withColumnRenamed("id", "person_id").join(queue, "person_id", "right")
    folded = rows.select("person_id", _taken_in_turn(F.col("queue"), reject_siblings).alias("end")).select("person_id", "end.*")

    done = folded.select("person_id", F.explode("done").alias("d")).select("person_id", "d.*")
    outcome = done.select("id", F.col("how").alias("_how"))
    closed = folded.where("closed").select("person_id", F.lit(True).alias("_closed"))
    after = candidates.join(outcome, "id", "left").join(closed, "person_id", "left")
    status = F.coalesce("_how", F.when(F.col("_closed") & (F.col("status") == "pending"), "rejected"))
    after = after.withColumns({"status": F.coalesce(status, F.col("status")), "decided_at": F.when(status.isNotNull(), now).otherwise(F.col("decided_at"))}).select(*candidates.columns)

    ids = ("openalex_id", "orcid", "openalex_id_alt")
    ends = folded.select(F.col("person_id").alias("id"), F.lit(True).alias("_decided"), F.col("confirmed").alias("_confirmed"), *(F.col(c).alias(f"_{c}") for c in ids))
    new = {c: F.when(F.col("_decided"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ids}
    new["identity_status"] = F.when(F.col("_confirmed"), "confirmed").otherwise(F.col("identity_status"))
    new_people = people.join(ends, "id", "left").select(*(new.get(c, F.col(c)).alias(c) for c in people.columns))
    log = done.where("how <> 'rejected'").join(people.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    log = log.select("person_id", F.col("source").alias("source_name"), F.col("field").alias("field_updated"), F.col("old").alias("old_value"), F.col("external_id").alias("new_value"), F.concat(F.lit("identity_"), F.col("how")).alias("method"), now.alias("retrieved_at"))
    return State(new_people, after, log)


_DONE = "array<struct<id:bigint,how:string,source:string,external_id:string,field:string,old:string>>"


def _taken_in_turn(queue: Column, reject_siblings: bool) -> Column:
    """A person's ids after the decisions of ``queue``, with what became of each candidate."""

    def step(acc: Column, act: Column) -> Column:
        index, primary = act["source"] == "openalex", acc["openalex_id"]
        how = decide(F.lit("pending"), act["decision"], F.coalesce(primary, F.lit("")) != "", index)
        how = F.when(acc["closed"] | F.exists(acc["done"], lambda x: x["id"] == act["id"]) | (how == "pending"), F.lit(None)).otherwise(how)
        accepts, merges = F.coalesce(how == "accepted", F.lit(False)), F.coalesce(how == "merged", F.lit(False))
        orcid = F.when(index, act["orcid"]).when(act["source"] == "orcid", act["external_id"])
        field = F.when(merges, "openalex_id_alt").when(index, "openalex_id").otherwise("orcid")
        old = F.when(merges, F.to_json(acc["openalex_id_alt"])).when(index, primary).otherwise(acc["orcid"])
        entry = F.struct(act["id"].alias("id"), how.alias("how"), act["source"].alias("source"), act["external_id"].alias("external_id"), field.alias("field"), old.alias("old"))
        return F.struct(
            F.when(accepts & index, F.coalesce(primary, act["external_id"])).otherwise(primary).alias("openalex_id"),
            F.when(accepts | merges, F.coalesce(acc["orcid"], orcid)).otherwise(acc["orcid"]).alias("orcid"),
            F.when(merges, with_alternate(acc["openalex_id_alt"], primary, act["external_id"])).otherwise(acc["openalex_id_alt"]).alias("openalex_id_alt"),
            (acc["confirmed"] | accepts).alias("confirmed"),
            (acc["closed"] | (accepts if reject_siblings else F.lit(False))).alias("closed"),
            F.when(how.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(entry).cast(_DONE))).alias("done"),
        )

    start = F.struct("openalex_id", "orcid", "openalex_id_alt", F.lit(False).alias("confirmed"), F.lit(False).alias("closed"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(queue, start, step)


def unmerged(people: DataFrame, candidates: DataFrame, ids: DataFrame, now: Column) -> State:
    """Merged indexed candidates among ``ids(id)`` are pending again and leave their people's
    alternates, with a log of each."""
    back = candidates.join(ids, "id", "left_semi").where("status = 'merged' AND source = 'openalex'")
    mark = back.select("id", F.lit(True).alias("_back"))
    hit = F.coalesce(F.col("_back"), F.lit(False))
    after = candidates.join(mark, "id", "left").withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "decided_at": F.when(~hit, F.col("decided_at"))}).select(*candidates.columns)
    gone = back.groupBy(F.col("person_id").alias("id")).agg(F.collect_set("external_id").alias("_gone"))
    empty = F.array().cast("array<string>")
    left = F.array_except(F.coalesce("openalex_id_alt", empty), F.coalesce("_gone", empty))
    new = people.join(gone, "id", "left").withColumn("openalex_id_alt", F.when(F.col("_gone").isNull(), F.col("openalex_id_alt")).when(F.size(left) > 0, left)).select(*people.columns)
    old = people.select(F.col("id").alias("person_id"), F.to_json("openalex_id_alt").alias("old_value"))
    log = back.join(old, "person_id", "left").select("person_id", F.lit("openalex").alias("source_name"), F.lit("openalex_id_alt").alias("field_updated"), "old_value", F.lit(None).cast("string").alias("new_value"), F.lit("identity_unmerge").alias("method"), now.alias("retrieved_at"))
    return State(new, after, log)


def not_findable(people: DataFrame, candidates: DataFrame, ids: DataFrame, now: Column) -> State:
    """The people among ``ids(id)`` can't be found anywhere: their status and pending candidates are
    rejected."""
    mark = ids.select("id", F.lit(True).alias("_gone")).distinct()
    new = people.join(mark, "id", "left").withColumn("identity_status", F.when(F.coalesce(F.col("_gone"), F.lit(False)), "rejected").otherwise(F.col("identity_status"))).select(*people.columns)
    rows = candidates.join(mark.withColumnRenamed("id", "person_id"), "person_id", "left")
    hit = F.coalesce(F.col("_gone"), F.lit(False)) & (F.col("status") == "pending")
    after = rows.withColumns({"status": F.when(hit, "rejected").otherwise(F.col("status")), "decided_at": F.when(hit, now).otherwise(F.col("decided_at"))}).select(*candidates.columns)
    return State(new, after, people.limit(0).select(*(F.lit(None).cast("string").alias(c) for c in LOG)))


def restored(candidates: DataFrame, reopened: DataFrame) -> DataFrame:
    """``candidates`` with those among ``reopened(id)`` pending again."""
    mark = reopened.select("id", F.lit(True).alias("_back"))
    hit = F.coalesce(F.col("_back"), F.lit(False))
    return candidates.join(mark, "id", "left").withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "decided_at": F.when(~hit, F.col("decided_at"))}).select(*candidates.columns)


def without_footprint(people: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """People who weren't found and have no research to find end as no_footprint, with a log of each."""
    ends = (F.col("identity_status") == "not_found") & no_footprint(F.col("pi_eligible").cast("boolean"), F.col("title"), F.col("job_code_description"))
    ends = F.coalesce(ends, F.lit(False))
    log = people.where(ends).select(F.col("id").alias("person_id"), F.lit("roster").alias("source_name"), F.lit("identity_status").alias("field_updated"), F.lit("not_found").alias("old_value"), F.lit("no_footprint").alias("new_value"), F.lit("identity_no_footprint").alias("method"), now.alias("retrieved_at"))
    return people.withColumn("identity_status", F.when(ends, "no_footprint").otherwise(F.col("identity_status"))), log


def merge_outcomes(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """id, person_id and reason of every pending candidate, by which it is merged as another profile of
    a person whose primary one it agrees with, or not; ``candidates`` have orcid and email."""
    p = people.select(F.col("id").alias("person_id"), F.col("openalex_id").alias("_primary"), F.col("orcid").alias("_orcid"), F.col("email").alias("_email"))
    rows = candidates.where("status = 'pending'").join(p, "person_id")
    agreed = corroboration(F.col("_orcid"), F.col("orcid"), F.col("_email"), F.col("email"))
    reason = merge_reason(F.col("source"), F.col("score"), F.nullif(F.col("_primary"), F.lit("")), F.col("llm_verdict"), agreed)
    return rows.select("id", "person_id", reason.alias("reason"))


def resweep(resolved: DataFrame) -> DataFrame:
    """What a pass over the queue decides about every pending candidate, from ``resolved`` people with
    candidates, status and the clique that :func:`tarnwick.operators.identity.resolve` found: of one who
    is now accepted the chosen profile is accepted, its clique merged and the others rejected; of the
    rest all stay pending."""
    each = resolved.select("person", "status", F.col("chosen.external_id").alias("chosen"), F.transform("clique.cluster", lambda m: m["external_id"]).alias("members"), F.explode("candidates").alias("c"))
    external = F.col("c.external_id")
    decision = first_match([(F.col("status") != "auto", "pending"), (external == F.col("chosen"), "accept"), (F.array_contains("members", external), "merge")], "reject")
    return each.select("person", external.alias("external_id"), decision.alias("decision"))




def swept(people: DataFrame, verified: DataFrame, order: Sequence[str], most_lookups: int | None = None) -> DataFrame:
    """A pass over people whose candidates are pending, in the queue's ``order``, by the conservative rules:
    person, outcome, looked_up, chosen, members and adopted_orcid.

    ``people(person, candidates, first, last, *order)`` have what :func:`tarnwick.operators.identity.resolve`
    adds (clique, chosen, runner_up); ``verified(orcid, employed, name_similarity, unique_hit, email_match)``
    is what the register says of an ORCID where it was looked up. Tiers: a clear lead of several profiles of one
    person with a good score is accepted; a clear lead whose ORCID may corroborate it is if the register
    confirms employment and name; a register's own candidate is if it qualifies by what was verified.
    The latter two cost a look-up each, which the first ``most_lookups`` in line get; the rest stay pending."""
    top, c = F.get("candidates", F.lit(0))["score"], F.col("chosen")
    clear = F.round(top - F.col("runner_up"), 9) > TIE_MARGIN
    several, index = F.size("clique.cluster") > 1, F.coalesce(c["source"] == "openalex", F.lit(False))
    tie = F.coalesce(several & clear & (top >= AUTO_SCORE), F.lit(False))
    name = best_name(F.col("first"), F.col("last"), F.array(c["display_name"]))
    exact = exact_primary_name(F.col("first"), F.col("last"), c["display_name"])
    precheck = index & F.coalesce(clear, F.lit(False)) & may_corroborate(c["source"], name, exact, c["current"] | c["listed"], c["orcid"])
    register = F.coalesce(c["source"] == "orcid", F.lit(False))
    rows = people.withColumns({"_tie": tie, "_precheck": ~tie & precheck, "_register": ~tie & ~precheck & register})
    rows = with_lookups(rows, order, F.col("_precheck") | F.col("_register"), most_lookups)
    asked = F.when(F.col("granted"), last_path_part(F.when(F.col("_register"), c["external_id"]).otherwise(c["orcid"])))
    v = verified.select(last_path_part(F.col("orcid")).alias("_orcid"), F.struct("employed", "name_similarity", "unique_hit", "email_match").alias("v"))
    rows = rows.withColumn("_asked", asked).join(v, F.col("_asked") == F.col("_orcid"), "left")
    confirmed = F.col("_precheck") & corroborates(F.col("v.employed"), F.col("v.name_similarity"))
    qualified = F.col("_register") & fallback_qualifies(F.col("v.email_match"), F.col("v.unique_hit"), F.col("v.employed"), F.col("v.name_similarity"))
    outcome = first_match([(F.col("_tie"), "accepted_tie_collapse"), (confirmed, "accepted_orcid_corroboration"), (qualified, "accepted_orcid_fallback")], "left_pending")
    # the profile that is accepted of a clique takes over the ORCID of the first other one that has one
    orcids = F.filter(F.transform("clique.cluster", lambda m: m["orcid"]), lambda o: o.isNotNull())
    adopted = F.when(F.col("_tie") & c["orcid"].isNull(), F.get(orcids, F.lit(0)))
    members = F.when(outcome == "accepted_tie_collapse", F.transform("clique.cluster", lambda m: m["external_id"]))
    return rows.select("person", outcome.alias("outcome"), "granted", F.when(outcome != "left_pending", c["external_id"]).alias("chosen"), members.alias("members"), adopted.alias("adopted_orcid")).withColumnRenamed("granted", "looked_up")


def sweep_counts(outcomes: DataFrame) -> DataFrame:
    """One row of what a pass did."""
    kinds = ("accepted_tie_collapse", "accepted_orcid_corroboration", "accepted_orcid_fallback", "left_pending")
    return outcomes.agg(F.count("*").alias("people_seen"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds), F.count_if("looked_up").alias("orcid_lookups"))


def merge_counts(outcomes: DataFrame) -> DataFrame:
    """One row of what :func:`merge_outcomes` found: how many of each reason, and how many people are
    touched; the same for a dry run, which stops here."""
    reasons = ("merged", "skipped_no_primary", "skipped_llm_reject", "skipped_no_orcid_match", "not_eligible")
    return outcomes.agg(*(F.count_if(F.col("reason") == r).alias(r) for r in reasons), F.count_distinct(F.when(F.col("reason") == "merged", F.col("person_id"))).alias("people_touched"))


def auto_merged(people: DataFrame, candidates: DataFrame, now: Column) -> State:
    """The candidates that :func:`merge_outcomes` finds to be other profiles of their people, merged."""
    hits = merge_outcomes(candidates, people).where("reason = 'merged'")
    state = decided(people, candidates, hits.select("id", F.lit("merge").alias("decision")), now)
    return State(state.people, state.candidates, state.log.withColumn("method", F.lit("identity_auto_merge")))
