"""All queries over the generated tables, with the SQL that each equals.

Each query binds an operator to whole tables. The SQL is written for DuckDB and independent of the
operators: it is the yardstick, not the implementation.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick import workspace
from tarnwick.functions import jsonx, names, text
from tarnwick.functions.stem import stem, stem_sql
from tarnwick.operators import identity, linkage, merge, ranking, report, rules, search, snapshot
from tarnwick.plans import enrich, match
from tarnwick.plans import reconcile as reconciling
from tarnwick.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(f):
    """What several queries begin with is worked out once for each application and folder."""
    made: dict[tuple[str, str], object] = {}

    @functools.wraps(f)
    def first(spark: SparkSession, d: str):
        key = (spark.sparkContext.applicationId, d)
        if key not in made:
            made[key] = f(spark, d)
        return made[key]

    return first


# Pages, look-ups, top rows


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name IS NOT NULL AND c_name <> '' ORDER BY c_name NULLS FIRST, c_custkey LIMIT 20 OFFSET 40")
def q_dir_page(spark, d):
    rows = table(spark, d, "customer").where(~text.blank(F.col("c_name"))).select("c_custkey", "c_name", "c_mktsegment")
    return ranking.page(rows, [F.col("c_name"), F.col("c_custkey")], limit=20, offset=40)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def q_recent_n(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type").orderBy(F.col("event_id").desc()).limit(25)


@query("""SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS place FROM events) WHERE place <= 15""")
def q_topn_per_key(spark, d):
    return ranking.top_per_key(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.col("value").desc_nulls_last(), F.col("event_id")], 15).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


_WANTED = [70, 3, 999999999, 32, 1, 5]


@query("SELECT o.o_orderkey, w.place FROM orders o JOIN (VALUES (0, 70), (1, 3), (2, 999999999), (3, 32), (4, 1), (5, 5)) AS w(place, k) ON o.o_orderkey = w.k")
def q_multi_get_ordered(spark, d):
    return ranking.in_given_order(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", _WANTED).select("o_orderkey", "place")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 100000 ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderkey LIMIT 100")
def q_queue_select(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 100000))
    return rows.orderBy((F.col("o_orderpriority") == "1-URGENT").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query("""SELECT person_id, row_number() OVER (ORDER BY pi_eligible DESC NULLS LAST, department, person_id) AS place FROM (SELECT c_custkey AS person_id, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 0 END AS pi_eligible, c_mktsegment AS department,
    (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS last_enriched, CASE c_nationkey % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'ambiguous' END AS identity_status FROM customer) WHERE last_enriched IS NULL AND identity_status IN ('auto', 'confirmed')""")
def q_backfill_select(spark, d):
    last = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_enriched"))
    rows = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    status = F.when(F.col("c_nationkey") % 4 == 0, "auto").when(F.col("c_nationkey") % 4 == 1, "confirmed").when(F.col("c_nationkey") % 4 == 2, "ambiguous")
    people = rows.select(F.col("c_custkey").alias("person_id"), F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") > 0, 0).alias("pi_eligible"), F.col("c_mktsegment").alias("department"), "last_enriched", status.alias("identity_status"))
    # the place that the order gives, as a comparison of rows can't tell their order
    return enrich.backfill(people).withColumn("place", F.monotonically_increasing_id()).select("person_id", F.row_number().over(Window.orderBy("place")).cast("long").alias("place"))


# Full-text search

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}]+)', 1)"


def _bm25_sql(query_: str, every: bool, of: str = "documents") -> str:
    """Scores of a query's words as prefixes of stems, in a table of doc_id and text."""
    terms = search.query_terms(query_)
    hits = " OR ".join(f"starts_with(term, '{t}')" for t in terms)
    tfs = ", ".join(f"count(*) FILTER (WHERE starts_with(term, '{t}')) AS tf{i}" for i, t in enumerate(terms))
    ns = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS n{i}" for i in range(len(terms)))
    part = lambda i: f"(CASE WHEN n - n{i} <= n{i} THEN 1e-6 ELSE greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) END) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))"
    keep = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""texts AS (SELECT doc_id, {_TOKENS} AS w FROM {of}),
        lengths AS (SELECT doc_id, len(w) AS length FROM texts),
        stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
        spelt AS (SELECT doc_id, unnest(w) AS raw FROM texts), words AS (SELECT DISTINCT raw FROM spelt), stems AS ({stem_sql('raw')}),
        tf AS (SELECT doc_id, {tfs} FROM spelt JOIN stems USING (raw) WHERE {hits} GROUP BY doc_id),
        found AS (SELECT {ns} FROM tf),
        scored AS (SELECT doc_id, -({" + ".join(part(i) for i in range(len(terms)))}) AS score FROM tf JOIN lengths USING (doc_id), stats, found WHERE {keep})"""


@once
def index_of(spark: SparkSession, d: str) -> search.Index:
    """The one index of ``documents``, written by the first search that needs it."""
    return search.stored(search.build_index(table(spark, d, "documents")))


@query(f"WITH {_bm25_sql('Ther onan x', True)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score, doc_id LIMIT 20")
def q_fts_and_bm25(spark, d):
    return search.search(index_of(spark, d), "Ther onan x", limit=20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql('ciónde, einver; ther', False)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score, doc_id LIMIT 60")
def q_fts_or_bm25(spark, d):
    return search.search(index_of(spark, d), "ciónde, einver; ther", limit=60, every=False).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql('ther onan', True)} SELECT count(*) AS total FROM scored")
def q_fts_count_total(spark, d):
    return search.bm25(index_of(spark, d), ["ther", "onan"]).agg(F.count("*").alias("total"))


@query(f"WITH {_bm25_sql('leningly thated', False)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score, doc_id LIMIT 20")
def q_fts_porter(spark, d):
    return search.search(index_of(spark, d), "leningly thated", limit=20, every=False).select("doc_id", F.round("score", 6).alias("score"))


_WORDS_SQL = f"""texts AS (SELECT {_TOKENS} AS w FROM documents), words AS (SELECT DISTINCT raw || tail AS raw FROM (SELECT DISTINCT unnest(w) AS raw FROM texts), (VALUES (''), ('s'), ('ing'), ('ational'), ('iveness'), ('ed'), ('y'), ('ies'), ('ll'), ('tional'), ('ement'), ('ion'), ('e')) AS v(tail))"""


@query(f"WITH {_WORDS_SQL} {stem_sql('raw')}")
def q_stems(spark, d):
    """The stems of all words of the documents, as they are and with endings."""
    tails = ["", "s", "ing", "ational", "iveness", "ed", "y", "ies", "ll", "tional", "ement", "ion", "e"]
    words = table(spark, d, "documents").select(F.explode(search.tokens(F.col("text"))).alias("w")).distinct().select(F.explode(F.array(*(F.concat("w", F.lit(t)) for t in tails))).alias("raw")).distinct()
    return words.select("raw", stem(F.col("raw")).alias("term"))


#: A third of the documents change, a tenth go, and others come.
_CHANGED_SQL = """now AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN reverse(text) || ' therapy onan' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 4 = 2)"""


@once
def _grown(spark, d) -> search.Index:
    """An index that got its documents in several steps, some of them twice."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = search.SegmentedIndex(spark, workspace.folder(spark, "segments"))
    index.apply(docs.where("doc_id % 4 <> 2"), merge=False)
    index.apply(docs.where("doc_id % 4 = 2"), merge=False)
    changed = docs.where("doc_id % 3 = 1").select("doc_id", F.concat(F.reverse("text"), F.lit(" therapy onan")).alias("text"))
    index.apply(changed.unionByName(docs.where("doc_id % 4 = 2").select((-1 - F.col("doc_id")).alias("doc_id"), "text")), merge=False)
    index.apply(changed.where("doc_id % 6 = 1 AND doc_id % 10 <> 7"), docs.where("doc_id % 10 = 7").select("doc_id"))
    return index.index()


@query(f"WITH {_CHANGED_SQL}, {_bm25_sql('therapy onan', False, 'now')} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score, doc_id LIMIT 500")
def q_fts_segments(spark, d):
    return search.search(_grown(spark, d), "therapy onan", limit=500, every=False).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_CHANGED_SQL} SELECT count(*) AS n, sum(len({_TOKENS}))::BIGINT AS total FROM now""")
def q_fts_segment_totals(spark, d):
    return _grown(spark, d).stats


@query(f"""WITH {_bm25_sql('zuver mentepa', False)},
    best AS (SELECT doc_id, 0 AS tier, row_number() OVER (ORDER BY scored.score, doc_id) AS place FROM scored JOIN documents USING (doc_id) WHERE n_chars > 200 ORDER BY place LIMIT 30),
    rest AS (SELECT doc_id, 1 AS tier, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM best) ORDER BY place LIMIT 60)
    SELECT doc_id, tier, place FROM (SELECT * FROM best UNION ALL SELECT * FROM rest) ORDER BY tier, place LIMIT 60""")
def q_candidates_padded(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    scored = search.bm25(index_of(spark, d), search.query_terms("zuver mentepa"), every=False).join(docs.where("n_chars > 200").select("doc_id"), "doc_id").orderBy("score", "doc_id").limit(30)
    return ranking.fill_up(scored, docs, "doc_id", F.col("score"), [F.col("n_chars").desc_nulls_last()], 60).select("doc_id", F.col("tier").cast("int").alias("tier"), F.col("place").cast("long").alias("place"))


@query("""SELECT doc_id, (CASE WHEN contains(lower(coalesce(text, '')), 'thereon') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(text, '')), 'con la') THEN 1 ELSE 0 END) AS n_keywords
    FROM documents ORDER BY n_keywords DESC, doc_id LIMIT 60""")
def q_keyword_overlap(spark, d):
    return search.keyword_overlap(table(spark, d, "documents"), ["thereon", "license", "con la"], 60)


@query("SELECT count(*) FILTER (WHERE quality = 1) AS with_profile, count(*) - count(*) FILTER (WHERE quality = 1) AS without_profile FROM labels")
def q_match_pool(spark, d):
    return match.pool_counts(table(spark, d, "labels"), F.col("quality") == 1)


@query("""WITH t AS (SELECT item_id, list_transform(string_split(text, '. '), lambda x: lower(trim(x))) AS terms FROM benchmark)
    SELECT item_id, len(list_distinct(list_concat(terms, list_filter(flatten(list_transform(terms, lambda x: regexp_split_to_array(x, '\\s+'))), lambda w: length(w) > 3)))) AS n_keywords FROM t""")
def q_expand_keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(text.expand_keywords(F.split("text", r"\. "))).cast("long").alias("n_keywords"))


# Reports


@query("""SELECT c_mktsegment, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS positive, count(*) FILTER (WHERE c_acctbal > 5000) AS rich,
    CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER (WHERE c_acctbal > 0) * 100.0 / count(*), 1) ELSE 0 END AS pct_positive FROM customer GROUP BY c_mktsegment""")
def q_status_by_group(spark, d):
    return report.counts(table(spark, d, "customer"), ["c_mktsegment"], ["positive"], positive=F.col("c_acctbal") > 0, rich=F.col("c_acctbal") > 5000)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE text IS NOT NULL AND text <> '') AS with_text, count(*) FILTER (WHERE n_chars >= 1000) AS long_text FROM documents")
def q_coverage(spark, d):
    return report.counts(table(spark, d, "documents"), with_text=~text.blank(F.col("text")), long_text=F.col("n_chars") >= 1000)


_STAGE_SQL = """SELECT o_orderkey, o_orderpriority, CASE
    WHEN o_orderstatus = 'F' AND n_lines >= 6 THEN 'enriched'
    WHEN o_orderstatus IN ('F', 'P') AND n_lines >= 4 AND o_totalprice > 200000 THEN 'sources_dry'
    WHEN o_orderstatus IN ('F', 'P') AND n_lines >= 4 THEN 'normalizer_no_input'
    WHEN o_orderstatus IN ('F', 'P') THEN 'resolved_not_enriched'
    WHEN n_lines = 3 THEN 'stuck_in_identity_review' WHEN n_lines = 2 THEN 'identity_not_found' WHEN n_lines = 1 THEN 'no_footprint_or_rejected'
    ELSE 'unresolved' END AS stage
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""


def _staged(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus").isin("F", "P"), "auto").when(F.col("n_lines") == 3, "ambiguous").when(F.col("n_lines") == 2, "not_found").when(F.col("n_lines") == 1, "rejected").otherwise("unresolved")
    enriched = F.when((F.col("o_orderstatus") == "F") & (F.col("n_lines") >= 6), "text")
    return rows.select("o_orderkey", "o_orderpriority", rules.funnel_stage(enriched, status, F.col("n_lines") >= 4, F.col("o_totalprice") > 200000).alias("stage"))


@query(f"WITH s AS ({_STAGE_SQL}) SELECT k.place, k.stage, count(s.stage) AS n FROM (VALUES {', '.join(f'({i}, {s!r})' for i, s in enumerate(rules.STAGES))}) AS k(place, stage) LEFT JOIN s ON s.stage = k.stage GROUP BY 1, 2")
def q_funnel(spark, d):
    return report.stage_counts(_staged(spark, d), "stage", rules.STAGES)


@query(f"WITH s AS ({_STAGE_SQL}) SELECT o_orderpriority, {', '.join(f'count(*) FILTER (WHERE stage = {s!r}) AS {s}' for s in rules.STAGES)}, count(*) AS total FROM s GROUP BY 1")
def q_funnel_by_group(spark, d):
    return report.dense_counts(_staged(spark, d), "stage", rules.STAGES, ["o_orderpriority"])


@query("SELECT lower(p_brand || '|' || p_type) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def q_dup_names_having(spark, d):
    return report.duplicates(table(spark, d, "part"), F.lower(F.concat("p_brand", F.lit("|"), "p_type")))


@query("SELECT count(*) FILTER (WHERE text IS NULL OR text = '') AS no_text, count(*) FILTER (WHERE lang IS NULL OR lang = '') AS no_lang, count(*) AS total FROM documents")
def q_missing_counts(spark, d):
    return report.counts(table(spark, d, "documents"), no_text=text.blank(F.col("text")), no_lang=text.blank(F.col("lang")))


@query("""SELECT source, total, with_quality, CASE WHEN p >= 80 THEN 'on target' WHEN p >= 60 THEN 'approaching' ELSE 'below' END AS label FROM (
    SELECT source, count(*) AS total, count(*) FILTER (WHERE n_chars >= 700) AS with_quality, count(*) FILTER (WHERE n_chars >= 700) * 100.0 / count(*) AS p FROM documents GROUP BY source)""")
def q_threshold_label(spark, d):
    rows = report.counts(table(spark, d, "documents"), ["source"], with_quality=F.col("n_chars") >= 700)
    return rows.withColumn("label", report.coverage_label(F.col("with_quality") * 100 / F.col("total")))


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def q_distinct_sorted(spark, d):
    return table(spark, d, "documents").select("source").distinct().orderBy("source")


@query("SELECT coalesce(event_type, 'unknown') AS method, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, method")
def q_log_by_method(spark, d):
    return table(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("unknown")).alias("method")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "method")


_TRIAGE_SQL = """SELECT user_id, count(*) AS n, CASE WHEN bool_and(value > 20) THEN 'clear' WHEN bool_or(value > 20) AND count(*) > 1 THEN 'mixed' WHEN bool_or(event_type = 'click') THEN 'weak' ELSE 'none' END AS bucket FROM events GROUP BY user_id"""


def _triaged(spark, d) -> DataFrame:
    return report.triage(table(spark, d, "events"), "user_id", F.col("value") > 20, F.col("event_type") == "click")


@query(_TRIAGE_SQL)
def q_triage_buckets(spark, d):
    return _triaged(spark, d)


@query(f"SELECT bucket, count(*) AS users, sum(n)::BIGINT AS rows FROM ({_TRIAGE_SQL}) GROUP BY bucket")
def q_triage_by_group(spark, d):
    return _triaged(spark, d).groupBy("bucket").agg(F.count("*").alias("users"), F.sum("n").alias("rows"))


@query("""SELECT threshold, accepted, right_ AS "right", n, CASE WHEN accepted > 0 THEN round(right_ * 1.0 / accepted, 6) END AS precision, round(accepted * 1.0 / n, 6) AS coverage FROM (
    SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE score >= t) AS accepted, count(*) FILTER (WHERE score >= t AND quality = 1) AS right_, count(*) AS n
    FROM (SELECT least(n_chars / 5000.0, 1.0) AS score, quality FROM labels JOIN documents USING (doc_id)), (VALUES (0.1), (0.25), (0.5), (0.75), (0.9), (1.5)) AS g(t) GROUP BY t)""")
def q_calibration(spark, d):
    cases = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"), (F.col("quality") == 1).alias("correct"))
    return report.calibration(cases, [0.1, 0.25, 0.5, 0.75, 0.9, 1.5])


# Functions


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' & ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def q_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"))


@query("SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g') AS name FROM documents")
def q_normalize_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.letters_only(F.col("text")).alias("name"))


_MADE_UP = "CASE WHEN c_custkey % 3 = 0 THEN c_name || '@Example.org' WHEN c_custkey % 3 = 1 THEN '' END"


@query(f"""SELECT c_custkey, lower(c_mktsegment) || ':' || CASE WHEN c_custkey % 7 = 0 THEN 'orcid:0000-' || c_custkey WHEN c_custkey % 3 = 0 THEN 'email:' || lower({_MADE_UP})
    ELSE 'name:' || regexp_replace(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '|' || regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS stable_key FROM customer""")
def q_stable_key(spark, d):
    orcid = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("0000-"), F.col("c_custkey")))
    return table(spark, d, "customer").select("c_custkey", names.stable_key(F.lower("c_mktsegment"), orcid, F.expr(_MADE_UP), F.col("c_name"), F.col("c_mktsegment")).alias("stable_key"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x00-\\x1f]', ' ', 'g') AS line FROM documents), u AS (SELECT doc_id, trim(line) AS line FROM t)
    SELECT doc_id, CASE WHEN contains(line, ',') THEN regexp_split_to_array(trim(substring(line, instr(line, ',') + 1)), ' +')[1] ELSE regexp_split_to_array(line, ' +')[1] END AS first,
    CASE WHEN contains(line, ',') THEN trim(left(line, instr(line, ',') - 1)) ELSE coalesce(array_to_string(regexp_split_to_array(line, ' +')[2:], ' '), '') END AS last FROM u""")
def q_name_parse(spark, d):
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1f]", " ")
    return table(spark, d, "documents").select("doc_id", names.parse_name(line).alias("n")).select("doc_id", "n.first", "n.last")


@query(f"SELECT c_custkey, CASE WHEN instr({_MADE_UP}, '@') > 0 THEN lower(trim(left({_MADE_UP}, instr({_MADE_UP}, '@') - 1))) ELSE coalesce(lower(trim({_MADE_UP})), '') END AS email_local FROM customer")
def q_email_local(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.email_local(F.expr(_MADE_UP)).alias("email_local"))


_PAIRS_SQL = """SELECT a.p_partkey AS a, b.p_partkey AS b, split_part(a.p_type, ' ', 1) AS af, a.p_brand || 'x' AS al, left(split_part(b.p_type, ' ', 1), 1 + b.p_partkey % 7) AS bf, b.p_brand || CASE WHEN b.p_partkey % 2 = 0 THEN 'x' ELSE 'xy' END AS bl
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"""
_LETTERS = lambda c: f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"


def _pairs(spark, d) -> DataFrame:
    """Pairs of names as letters, which each part gives once; merged by brand and size, so that all cores pair."""
    part, word = table(spark, d, "part"), F.split_part("p_type", F.lit(" "), F.lit(1))
    side = lambda tag, key, f, l: part.select("p_brand", "p_size", F.col("p_partkey").alias(key), text.letters_only(f).alias(f"{tag}f"), text.letters_only(l).alias(f"{tag}l"))  # noqa: E731, E741
    ours = side("o", "a", word, F.concat("p_brand", F.lit("x")))
    theirs = side("t", "b", F.left(word, (F.col("p_partkey") % 7 + 1).cast("int")), F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("xy")))
    return ours.join(theirs.hint("merge"), ["p_brand", "p_size"]).where(F.col("a") < F.col("b"))


@query(f"""WITH p AS ({_PAIRS_SQL}), n AS (SELECT a, b, {_LETTERS('af')} AS of, {_LETTERS('al')} AS ol, {_LETTERS('bf')} AS tf, {_LETTERS('bl')} AS tl FROM p)
    SELECT a, b, CASE WHEN of = '' OR ol = '' OR tf = '' OR tl = '' THEN 0 ELSE coalesce(round(0.6 * (CASE WHEN ol = tl THEN 1.0 WHEN contains(tl, ol) OR contains(ol, tl) THEN 0.8 END)
    + 0.4 * (CASE WHEN of = tf THEN 1.0 WHEN starts_with(tf, of) OR starts_with(of, tf) THEN 0.85 WHEN left(tf, 3) = left(of, 3) THEN 0.6 WHEN left(tf, 1) = left(of, 1) THEN 0.3 END), 3), 0) END::DOUBLE AS similarity FROM n""")
def q_name_similarity(spark, d):
    return _pairs(spark, d).select("a", "b", names.letters_similarity(*map(F.col, ("of", "ol", "tf", "tl"))).alias("similarity"))


@query(f"""WITH p AS ({_PAIRS_SQL}), n AS (SELECT a, b, {_LETTERS('af')} AS of, {_LETTERS('al')} AS ol, {_LETTERS('bf')} AS tf, {_LETTERS('bl')} AS tl FROM p)
    SELECT a, b, of <> '' AND ol <> '' AND tf <> '' AND tl <> '' AND (ol = tl OR contains(tl, ol) OR contains(ol, tl)) AND (starts_with(tf, left(of, 3)) OR starts_with(of, left(tf, 3))) AS compatible FROM n""")
def q_names_compatible(spark, d):
    return _pairs(spark, d).select("a", "b", names.compatible(*map(F.col, ("of", "ol", "tf", "tl"))).alias("compatible"))


@query("""WITH t AS (SELECT p_partkey, trim(p_name) AS f, trim(p_type) AS l, regexp_split_to_array(trim(p_name), '[-\\s]+') AS fs, list_filter(regexp_split_to_array(trim(p_type), '[-\\s]+'), lambda x: x <> '') AS ls FROM part),
    v AS (SELECT p_partkey, f, l, unnest([CASE WHEN len(fs) > 1 THEN fs[1] || '/' || l END, left(fs[1], 1) || '/' || l, CASE WHEN len(ls) > 1 THEN f || '/' || array_to_string(ls, '') END, CASE WHEN len(ls) > 1 THEN f || '/' || ls[-1] END, CASE WHEN len(ls) > 1 THEN f || '/' || ls[1] END]) AS v, unnest([1, 2, 3, 4, 5]) AS i FROM t)
    SELECT p_partkey, string_agg(v, ';' ORDER BY i) AS variants FROM (SELECT p_partkey, v, min(i) AS i FROM v WHERE v IS NOT NULL AND v <> f || '/' || l GROUP BY 1, 2) GROUP BY 1""")
def q_name_variants(spark, d):
    v = F.transform(names.variants(F.col("p_name"), F.col("p_type")), lambda x: F.concat_ws("/", x["first"], x["last"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(v, ";").alias("variants"))


_TITLES = [("^PROMO", "Promotion"), ("^STANDARD (POL|BRU)", "Standard finish"), ("^STANDARD", "Standard"), ("STEEL$", "Steel"), ("^ECONOMY", "Economy")]


@query(f"SELECT p_partkey, CASE {' '.join(f'WHEN regexp_matches(upper(trim(p_type)), {p!r}) THEN {v!r}' for p, v in _TITLES)} END AS title FROM part")
def q_case_map_title(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.by_pattern(F.col("p_type"), _TITLES).alias("title"))


_REGISTRY = [{"slug": "first", "label": "First source", "equals": ["SRC0"], "bundle": "core"}, {"slug": "teens", "label": "Teens", "contains": ["src1"], "bundle": "wide"}, {"slug": "nine", "label": "Nine", "exact": ["c9"]}]


@query("""SELECT doc_id, CASE WHEN lower(trim(source)) = 'src0' THEN 'first' WHEN contains(lower(source), 'src1') THEN 'teens' WHEN contains(source, 'c9') THEN 'nine' WHEN trim(coalesce(source, '')) = '' THEN 'other' ELSE lower(source) END AS slug,
    CASE WHEN lower(trim(source)) = 'src0' THEN 'core' WHEN contains(lower(source), 'src1') THEN 'wide' ELSE 'default' END AS bundle FROM documents""")
def q_division_map(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.division(F.col("source"), _REGISTRY).alias("v")).select("doc_id", "v.slug", "v.bundle")


@query("""WITH b(bundle, own) AS (VALUES ('core', ['orcid', 'pubmed']), ('wide', ['dblp'])) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['openalex', 'orcid'], coalesce(own, ['crossref'])))), ',') AS sources
    FROM (SELECT doc_id, CASE WHEN lower(trim(source)) = 'src0' THEN 'core' WHEN contains(lower(source), 'src1') THEN 'wide' ELSE 'default' END AS bundle FROM documents) LEFT JOIN b USING (bundle)""")
def q_source_routing(spark, d):
    bundles = spark.createDataFrame([("core", "orcid"), ("core", "pubmed"), ("wide", "dblp"), ("default", "crossref")], "bundle string, source string")
    rows = q_division_map(spark, d).select("doc_id", "bundle")
    return rules.sources_of(rows, bundles, ["openalex", "orcid"]).select("doc_id", F.array_join("sources", ",").alias("sources"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS raw_hash FROM documents")
def q_sha_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fingerprint(F.coalesce("text", F.lit(""))).alias("raw_hash"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR text <> trim(text)")
def q_fingerprint_skip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.trim("text")), 256).alias("raw_hash"))
    return merge.changed(docs, old, "doc_id", F.col("text")).select("doc_id")


@query(r"SELECT doc_id, array_to_string(e, ',') AS emails FROM (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+'), lambda x, i: i = list_position(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+'), x)) AS e FROM documents) WHERE len(e) > 0")
def q_email_extract(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.emails(F.col("text")).alias("e"))
    return rows.where(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("emails"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS short FROM documents")
def q_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shortened(F.col("text"), 300).alias("short"))


#: Tags taken out step by step; entities last, the ampersand's behind the others.
_HTML_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<head(\s[^>]*)?>.*?</head>', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script(\s[^>]*)?>.*?</script>', '', 'g'), '(?is)<style(\s[^>]*)?>.*?</style>', '', 'g'), '(?is)<noscript(\s[^>]*)?>.*?</noscript>', '', 'g'), '(?is)<template(\s[^>]*)?>.*?</template>', '', 'g') AS h FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?(p|div|li|br|tr|h[1-6]|article|section|ul|ol|table|nav|header|footer)(\s[^>]*)?/?>', chr(10), 'g'), '</?[a-zA-Z!][^>]*>', '', 'g') AS h FROM b),
    d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS h FROM c)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(h, chr(160), ' '), chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM d"""


@query(_HTML_SQL)
def q_html_text(spark, d):
    from tarnwick.sources.html import html_text

    return table(spark, d, "pages").select("page_id", html_text("html").alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_variant(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' OR turn % 4 < 2 THEN length(text) END AS n_chars, CASE WHEN role = 'user' OR turn % 4 < 2 THEN md5(text) END AS digest FROM conversations""")
def q_json_recovery(spark, d):
    """Replies around each turn's text: in a fence, cut off in a second entry, within prose, or no JSON at
    all. Brackets and quotes in the text are not the reply's."""
    entry = F.to_json(F.struct(F.concat("text", F.lit('')).alias("t"), F.lit('a "]}" b').alias("odd")))
    whole = F.concat(F.lit("["), entry, F.lit("]"))
    user, turn = F.col("role") == "user", F.col("turn") % 4
    reply = F.when(user & (turn < 2), F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```\nand {so} on"))).when(user, F.concat(F.lit("["), entry, F.lit(", {\"t\": \"cut"))).when(turn < 2, F.concat(F.lit("see {x} "), whole, F.lit(" ok"))).otherwise("no JSON [here, or {there")
    found = jsonx.recovered(reply)
    one = F.when(F.startswith(found, F.lit("[")), F.get(F.from_json(found, "array<struct<t:string>>"), F.lit(0))).otherwise(F.from_json(found, "struct<t:string>"))["t"]
    return table(spark, d, "conversations").select("conv_id", "turn", one.alias("t")).select("conv_id", "turn", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


# Linkage

#: First names of which some begin others and some only look alike, last names of which some lie within others.
_FIRST = ["Daniel", "Danny", "Dan", "Maria", "Mario", "J.", "Jo-Ann", "Joan", "José", "Li"]
_LAST = ["Lee", "Leeds", "McLeeds", "Soto", "Sotomayor", "Kim", "Kimball", "Ng", "Nguyen", "O'Hara", "Hara", "Li"]
_LINK_SQL = f"""
    p AS (SELECT c_custkey AS person_id, {_FIRST}[1 + c_custkey % 10] AS f, {_LAST!r}[1 + c_nationkey % 12] || CASE WHEN c_custkey % 3 = 0 THEN '-' || c_mktsegment ELSE '' END AS l, CASE WHEN c_custkey % 5 < 2 THEN 'u' || c_custkey || '@x.org' ELSE '' END AS mail FROM customer),
    r AS (SELECT s_suppkey AS roster_id, s_suppkey AS pos, {_FIRST}[1 + s_suppkey // 3 % 10] AS f, {_LAST!r}[1 + s_nationkey % 12] || CASE WHEN s_suppkey % 4 = 0 THEN ' BUILDING' ELSE '' END AS l, CASE WHEN s_suppkey % 2 = 0 THEN 'u' || s_suppkey || '@x.org' ELSE 'u' || s_suppkey || '@y.org' END AS mail FROM supplier)""".replace('"O\'Hara"', "'O''Hara'")
_NORM = lambda a: f"regexp_replace(lower({a}), '[^a-z]', '', 'g')"
_LAST_FITS = f"(contains({_NORM('p.l')}, {_NORM('t.l')}) OR contains({_NORM('t.l')}, {_NORM('p.l')}))"
_COMPATIBLE = f"""{_LAST_FITS} AND (starts_with({_NORM('p.f')}, left({_NORM('t.f')}, 3)) OR starts_with({_NORM('t.f')}, left({_NORM('p.f')}, 3)))"""
_WHOLE = f"""{_LAST_FITS} AND (starts_with({_NORM('p.f')}, {_NORM('t.f')}) OR starts_with({_NORM('t.f')}, {_NORM('p.f')}))"""


def _indexed(key: str) -> str:
    return f"(SELECT *, min(pos) OVER (PARTITION BY {key}) AS first_pos, max(pos) OVER (PARTITION BY {key}) AS last_pos FROM r QUALIFY pos = last_pos)"


_LINKED_SQL = f"""WITH {_LINK_SQL},
    exact AS (
        SELECT person_id, roster_id, 1 AS tier, first_pos FROM p JOIN {_indexed('lower(mail)')} t ON lower(p.mail) = lower(t.mail) WHERE p.mail <> '' AND {_COMPATIBLE}
        UNION ALL SELECT person_id, roster_id, 2, first_pos FROM p JOIN {_indexed("split_part(lower(mail), '@', 1)")} t ON split_part(lower(p.mail), '@', 1) = split_part(lower(t.mail), '@', 1) WHERE p.mail <> '' AND {_COMPATIBLE}
        UNION ALL SELECT person_id, roster_id, 3, first_pos FROM p JOIN {_indexed(_NORM('l') + " || '|' || " + _NORM('f'))} t ON {_NORM('p.l')} = {_NORM('t.l')} AND {_NORM('p.f')} = {_NORM('t.f')}),
    loose AS (SELECT person_id, roster_id, 4 AS tier, first_pos FROM p JOIN {_indexed(_NORM('l') + " || '|' || " + _NORM('f'))} t ON {_WHOLE} WHERE person_id NOT IN (SELECT person_id FROM exact)),
    linked AS (SELECT person_id, roster_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY tier, first_pos, roster_id) AS place FROM (SELECT * FROM exact UNION ALL SELECT * FROM loose)) WHERE place = 1)"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    pick = lambda names_, k: F.element_at(F.array(*map(F.lit, names_)), (k % len(names_) + 1).cast("int"))
    mail = lambda k, host: F.concat(F.lit("u"), F.col(k).cast("string"), F.lit(host))
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    last = F.concat(pick(_LAST, F.col("c_nationkey")), F.when(k % 3 == 0, F.concat(F.lit("-"), "c_mktsegment")).otherwise(""))
    people = table(spark, d, "customer").select(k.alias("person_id"), pick(_FIRST, k).alias("first"), last.alias("last"), F.when(k % 5 < 2, mail("c_custkey", "@x.org")).otherwise("").alias("email"))
    last = F.concat(pick(_LAST, F.col("s_nationkey")), F.when(s % 4 == 0, " BUILDING").otherwise(""))
    roster = table(spark, d, "supplier").select(s.alias("roster_id"), s.alias("pos"), pick(_FIRST, F.floor(s / 3)).alias("first"), last.alias("last"), F.when(s % 2 == 0, mail("s_suppkey", "@x.org")).otherwise(mail("s_suppkey", "@y.org")).alias("email"))
    return people, roster


@query(f"{_LINKED_SQL} SELECT person_id, roster_id, tier, row_number() OVER (PARTITION BY roster_id ORDER BY person_id) = 1 AS claimed FROM linked")
def q_tier_linkage(spark, d):
    return linkage.claims(linkage.tiered_match(*_sides(spark, d)))


@query(f"""{_LINKED_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY roster_id ORDER BY person_id) = 1 AS claimed FROM linked)
    SELECT c_custkey AS person_id, roster_id, CASE WHEN roster_id IS NULL AND c_nationkey = 3 THEN 'frozen' WHEN roster_id IS NULL THEN 'inactive' WHEN NOT claimed THEN 'duplicate' WHEN s_nationkey = 3 THEN 'kept' WHEN s_nationkey <> c_nationkey THEN 'moved' ELSE 'matched' END AS outcome,
    CASE WHEN roster_id IS NOT NULL AND claimed AND s_nationkey <> 3 AND s_nationkey <> c_nationkey THEN s_nationkey ELSE c_nationkey END::VARCHAR AS division
    FROM customer LEFT JOIN c ON person_id = c_custkey LEFT JOIN supplier ON s_suppkey = roster_id
    UNION ALL SELECT NULL, s_suppkey, 'new', s_nationkey::VARCHAR FROM supplier WHERE s_nationkey <> 3 AND s_suppkey NOT IN (SELECT roster_id FROM linked)""")
def q_reconcile(spark, d):
    people, roster = _sides(spark, d)
    people = people.join(table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").cast("string").alias("division")), "person_id")
    roster = roster.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("roster_id"), F.col("s_nationkey").cast("string").alias("division")), "roster_id")
    return reconciling.reconcile(people, roster, F.col("division") == "3")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, event_id) AS place FROM events) WHERE place = 1")
def q_dedupe_best(spark, d):
    return linkage.dedupe_people(table(spark, d, "events").select("user_id", "event_id", "event_type"), F.col("user_id"), F.col("event_type") == "purchase", "event_id").select("user_id", "event_id")


@query("""SELECT lower(source) AS name, min(n) AS size, count(DISTINCT i) AS n_lists FROM (SELECT 0 AS i, source, lang AS n FROM documents WHERE lang <> 'en' UNION ALL SELECT 1, upper(source), 'zz' FROM documents) GROUP BY 1""")
def q_merge_lists(spark, d):
    docs = table(spark, d, "documents")
    a = docs.where("lang <> 'en'").select("source", F.col("source").alias("name"), F.col("lang").alias("size"))
    b = docs.select(F.upper("source").alias("source"), F.lower("source").alias("name"), F.lit("zz").alias("size"))
    return linkage.merge_lists([a, b], ["source"], ["name", "size"]).select("name", "size", "n_lists")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_semi_reopen(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT DISTINCT c_name AS name, c_nationkey AS nation FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 3000)")
def q_anti_insert(spark, d):
    new = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    have = table(spark, d, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("nation"))
    return new.dropDuplicates(["name", "nation"]).join(have, "nation", "left_anti").select("name", "nation")


@query("""SELECT e.event_id, e.user_id, c.c_name, o.o_orderkey FROM events e JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON o.o_custkey = e.user_id AND o.o_orderstatus = left(upper(e.event_type), 1)""")
def q_log_join_left(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey"))
    rows = table(spark, d, "events").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"))
    return rows.join(orders, (F.col("o_custkey") == F.col("user_id")) & (F.col("o_orderstatus") == F.left(F.upper("event_type"), F.lit(1))), "left").select("event_id", "user_id", "c_name", "o_orderkey")


# Merging

_CONTRIBUTIONS = """SELECT l_orderkey AS id, 'line' || (l_partkey % 12) AS title, year(l_shipdate) AS yr, l_discount AS confidence, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS pos FROM lineitem"""


@query(f"""SELECT id, title, yr, place FROM (SELECT id, title, yr, row_number() OVER (PARTITION BY id ORDER BY yr DESC NULLS LAST, pos) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY id, title ORDER BY confidence DESC, pos) AS n FROM ({_CONTRIBUTIONS})) WHERE n = 1) WHERE place <= 3""")
def q_priority_merge(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("line"), (F.col("l_partkey") % 12).cast("string")).alias("title"), F.year("l_shipdate").alias("yr"), F.col("l_discount").alias("confidence"), (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"))
    merged = merge.merge_lists(rows, ["id"], "title", [F.col("confidence").desc(), F.col("pos")], [F.col("yr").desc_nulls_last(), F.col("pos")], 3)
    return merged.select("id", "title", F.col("yr").cast("long").alias("yr"), F.col("place").cast("long").alias("place"))


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber::VARCHAR || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT AS source, l_discount AS confidence, CASE WHEN l_tax > 0.04 THEN l_returnflag WHEN l_tax > 0.02 THEN '' END AS flag, l_quantity AS quantity FROM lineitem)
    SELECT id, first(flag ORDER BY confidence DESC, source) FILTER (WHERE flag IS NOT NULL AND flag <> '') AS flag, first(quantity ORDER BY confidence DESC, source) FILTER (WHERE quantity IS NOT NULL) AS quantity FROM s GROUP BY id""")
def q_priority_scalar(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("source"), F.col("l_discount").alias("confidence"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).when(F.col("l_tax") > 0.02, "").alias("flag"), F.col("l_quantity").alias("quantity"))
    return merge.merge_scalars(rows, ["id"], "confidence", "source", ["flag", "quantity"])


@query("SELECT l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS works, sum(l_linenumber)::BIGINT AS cites, max(l_partkey) AS h FROM lineitem GROUP BY 1")
def q_alt_fold(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("works"), F.col("l_linenumber").cast("long").alias("cites"), F.col("l_partkey").alias("h"))
    return merge.fold_profiles(rows, ["l_orderkey"], ["works", "cites"], ["h"])


@query("SELECT conv_id, string_agg('- ' || role || ': ' || CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END, chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY conv_id")
def q_render_lines(spark, d):
    line = F.concat(F.lit("- "), F.col("role"), F.lit(": "), text.shortened(F.col("text"), 80))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["line"]), "\n").alias("lines"))


# Identity


@query("""SELECT c_custkey, s_suppkey, round(0.55 * sim + 0.3 * (CASE WHEN current THEN 1.0 WHEN listed THEN 0.7 ELSE 0.4 END) + 0.15 * (CASE WHEN fit IS NULL THEN 0.7 WHEN fit THEN 1.0 ELSE 0.4 END), 3)::DOUBLE AS score FROM (
    SELECT c_custkey, s_suppkey, CASE WHEN c_custkey % 3 = s_suppkey % 3 THEN 1.0 ELSE 0.94 END AS sim, s_acctbal > 5000 AS current, s_acctbal > 0 AS listed, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment IN ('BUILDING', 'MACHINERY') END AS fit FROM customer JOIN supplier ON c_nationkey = s_nationkey)""")
def q_identity_score(spark, d):
    """Nations are few, so their customers are dealt to eight parts each, and suppliers come to all of them."""
    customers = table(spark, d, "customer").select("*", F.col("c_nationkey").alias("nation"), F.pmod("c_custkey", F.lit(8)).alias("deal"))
    suppliers = table(spark, d, "supplier").select("*", F.col("s_nationkey").alias("nation"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(8)))).alias("deal"))
    rows = customers.join(suppliers.hint("merge"), ["nation", "deal"])
    fit = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    score = lambda name: identity.candidate_score(names.similarity(*map(F.lit, ("Ann", "Lee", name, "Lee"))), F.col("s_acctbal") > 5000, F.col("s_acctbal") > 0, fit)
    return rows.select("c_custkey", "s_suppkey", F.when(F.col("c_custkey") % 3 == F.col("s_suppkey") % 3, score("Ann")).otherwise(score("Anna")).alias("score"))


def _rivals(spark, d) -> DataFrame:
    """Documents of one source and length class as rival profiles."""
    docs = table(spark, d, "documents")
    group = F.concat_ws("-", "source", F.floor(F.col("n_chars") / 400).cast("string"))
    middle = F.element_at(F.array(F.lit("Ann Lee"), F.lit("Ann K. Lee"), F.lit("Ann R. Lee")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(group.alias("person"), F.col("doc_id").alias("pos"), F.format_string("A%06d", "doc_id").alias("external_id"), F.lit("openalex").alias("source"), middle.alias("display_name"), (F.lit(1.0) - (F.col("doc_id") % 5) / 50).alias("score"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("o"), (F.col("doc_id") % 2).cast("string"))).alias("orcid"), (F.col("doc_id") % 7 != 0).alias("current"), F.lit(False).alias("listed"), F.array("lang").alias("domains"), F.col("n_chars").alias("works"), F.lit(0).cast("long").alias("cites"))


def _candidates(spark, d) -> DataFrame:
    return identity.sorted_candidates(_rivals(spark, d), "person")


_SAME = "CASE WHEN m.orcid IS NOT NULL AND x.orcid IS NOT NULL THEN m.orcid = x.orcid ELSE (m.mid = '' OR x.mid = '' OR m.mid = x.mid) AND m.aff AND x.aff AND coalesce(m.lang = x.lang, FALSE) END"
#: Candidates one by one: the best one's clique, and all cliques, as lists that grow.
_FOLD_SQL = f"""WITH RECURSIVE c AS (SELECT concat_ws('-', source, floor(n_chars / 400)::BIGINT) AS person, {{'pos': doc_id, 'id': 'A' || lpad(doc_id::VARCHAR, 6, '0'), 'score': 1.0 - (doc_id % 5) / 50.0, 'orcid': CASE WHEN doc_id % 11 = 0 THEN 'o' || (doc_id % 2) END, 'mid': ['', 'k', 'r'][1 + doc_id % 3], 'aff': doc_id % 7 <> 0, 'lang': lang, 'works': coalesce(n_chars, 0)}} AS x FROM documents),
    n AS (SELECT person, x, row_number() OVER (PARTITION BY person ORDER BY x.score DESC, x.pos) AS k, first(x.score) OVER (PARTITION BY person ORDER BY x.score DESC, x.pos) AS top FROM c),
    f AS (SELECT person, k, [x] AS members, 0.0::DOUBLE AS runner, 0 AS n_rest, [[x]] AS cliques FROM n WHERE k = 1 UNION ALL
        SELECT n.person, n.k, CASE WHEN joins THEN list_append(members, x) ELSE members END, CASE WHEN joins THEN runner ELSE greatest(runner, x.score) END, n_rest + CASE WHEN joins THEN 0 ELSE 1 END,
            CASE WHEN spot IS NULL OR spot = 0 THEN list_append(cliques, [x]) ELSE list_transform(cliques, lambda g, i: CASE WHEN i = spot THEN list_append(g, x) ELSE g END) END
        FROM (SELECT n.*, f.members, f.runner, f.n_rest, f.cliques, round(top - x.score, 9) <= 0.05 AND len(list_filter(f.members, lambda m: NOT ({_SAME}))) = 0 AS joins, list_position(list_transform(f.cliques, lambda g: len(list_filter(g, lambda m: NOT ({_SAME}))) = 0), TRUE) AS spot FROM f JOIN n ON n.person = f.person AND n.k = f.k + 1) AS n),
    last AS (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY person)),
    chosen AS (SELECT person, arg_max(m.id, {{'w': m.works, 'e': m.id}}) AS canonical FROM (SELECT person, unnest(members) AS m FROM last) GROUP BY person)"""


@query(f"""{_FOLD_SQL} SELECT person, array_to_string(list_transform(members, lambda m: m.id), ',') AS cluster, n_rest, len(cliques) AS n_cliques, canonical FROM last JOIN chosen USING (person)""")
def q_greedy_clique(spark, d):
    c = identity.cliques(_rivals(spark, d), "person")
    return c.select("person", F.array_join(F.transform("cluster", lambda m: m["external_id"]), ",").alias("cluster"), "n_rest", "n_cliques", identity.canonical(F.col("cluster"))["external_id"].alias("canonical"))


@query(f"""{_FOLD_SQL}, r AS (SELECT person, members[1].score AS top, round(members[1].score - runner, 9) > 0.05 AS clear, len(members) AS size, k % 2 = 0 AS corroborated, runner FROM last)
    SELECT person, CASE WHEN clear AND (top >= 0.9 OR corroborated) THEN 'auto' ELSE 'ambiguous' END AS status, CASE WHEN top >= 0.9 AND clear AND size = 1 THEN 'identity_auto' WHEN clear AND (top >= 0.9 OR corroborated) THEN 'identity_auto_rule' ELSE 'none' END AS method, canonical AS chosen, runner::DOUBLE AS runner_up FROM r JOIN chosen USING (person)""")
def q_resolve(spark, d):
    people = _candidates(spark, d).withColumns({"status_before": F.lit("unresolved"), "corroborated": F.size("candidates") % 2 == 0, "fallback_ok": F.lit(False)})
    return identity.resolve(people).select("person", "status", "method", F.col("chosen.external_id").alias("chosen"), "runner_up")


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'auto' WHEN quality = 1 THEN 'ambiguous' WHEN n_chars < 200 THEN 'not_found' ELSE 'rejected' END AS decision FROM labels JOIN documents USING (doc_id)")
def q_decision_case(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    good = F.col("quality") == 1
    return rows.select("doc_id", rules.first_match([(good & (F.col("toxic") == 0), "auto"), (good, "ambiguous"), (F.col("n_chars") < 200, "not_found")], "rejected").alias("decision"))


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'not_an_accept' WHEN source = 'src3' THEN 'candidate_not_listed' WHEN n_chars % 5 = 0 THEN 'no_affiliation' WHEN least(n_chars / 1000.0, 1.0) < 0.75 THEN 'name_similarity_below_floor' WHEN (doc_id % 10) / 10.0 < 0.5 THEN 'confidence_below_threshold' ELSE 'ok' END AS reason FROM documents""")
def q_guardrail_reason(spark, d):
    reason = identity.guardrail(F.when(F.col("lang") == "fr", "abstain").otherwise("accept"), F.col("source") != "src3", F.col("n_chars") % 5 != 0, F.least(F.col("n_chars") / 1000.0, F.lit(1.0)), (F.col("doc_id") % 10) / 10.0, least_confidence=0.5)
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


_VERDICTS_SQL = """SELECT *, event_type = 'purchase' AND event_id % 50 <> user_id % 50 AND c BETWEEN 0 AND 1 AS accepts, event_type IN ('click', 'view') AND c BETWEEN 0 AND 1 AS settles, 'A' || user_id AS who FROM (SELECT event_id, user_id, event_type, floor(value) / 250 AS c FROM events)"""


@query(f"""SELECT event_id, CASE WHEN accepts THEN 'accept' WHEN settles AND event_type = 'click' THEN 'reject_all' ELSE 'abstain' END AS decision, CASE WHEN accepts THEN who END AS external_id, CASE WHEN accepts OR settles THEN c ELSE 0 END::DOUBLE AS confidence, CASE WHEN accepts OR settles THEN repeat('why ', event_id % 700)[:2000] ELSE '' END AS reasoning FROM ({_VERDICTS_SQL})""")
def q_verdicts(spark, d):
    """Replies from the events: confidences beyond 1, candidates that aren't listed, words that are none of
    the decisions, and JSON that ends too early."""
    kind, user = F.col("event_type"), F.concat(F.lit("A"), F.col("user_id").cast("string"))
    word = F.when(kind == "purchase", "accept").when(kind == "click", "reject_all").when(kind == "view", "abstain").otherwise(kind)
    whole = F.to_json(F.struct(word.alias("decision"), user.alias("candidate_external_id"), (F.floor("value") / 250).alias("confidence"), F.repeat(F.lit("why "), (F.col("event_id") % 700).cast("int")).alias("reasoning")))
    reply = F.when(kind == "signup", F.left(whole, F.length(whole) - 3)).otherwise(whole)
    listed = F.when(F.col("event_id") % 50 != F.col("user_id") % 50, F.array(F.lit("B"), user)).otherwise(F.array(F.lit("B")))
    return table(spark, d, "events").select("event_id", identity.verdict(reply, listed).alias("v")).select("event_id", "v.decision", "v.external_id", "v.confidence", "v.reasoning")


@query("""SELECT o_orderkey, CASE WHEN s <> 'pending' THEN s WHEN d = 'merge' AND o_totalprice > 100000 THEN 'merged' WHEN d IN ('merge', 'accept') THEN 'accepted' WHEN d = 'reject' THEN 'rejected' ELSE s END AS status FROM (
    SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'pending' END AS s, ['merge', 'accept', 'reject', 'later'][1 + o_orderkey % 4] AS d FROM orders)""")
def q_state_machine(spark, d):
    decision = F.element_at(F.array(*(F.lit(x) for x in ("merge", "accept", "reject", "later"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("pending")
    return table(spark, d, "orders").select("o_orderkey", identity.decide(status, decision, F.col("o_totalprice") > 100000, F.lit(True)).alias("status"))


@query("""WITH c AS (SELECT l_orderkey AS person_id, l_linenumber AS id, CASE WHEN l_returnflag = 'A' THEN 'accepted' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'pending' END AS status, year(l_shipdate) AS decided_at FROM lineitem)
    SELECT person_id, id FROM c WHERE status = 'rejected' AND (EXISTS (SELECT 1 FROM c a WHERE a.person_id = c.person_id AND a.status = 'accepted' AND a.decided_at = c.decided_at) OR NOT EXISTS (SELECT 1 FROM c a WHERE a.person_id = c.person_id AND a.status = 'accepted'))""")
def q_reopen(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("person_id"), F.col("l_linenumber").alias("id"), status.alias("status"), F.year("l_shipdate").alias("decided_at"))
    return identity.reopened(c).select("person_id", "id")


# Snapshots


@query("""WITH n AS (SELECT c_name AS name, c_acctbal + 1 AS balance, c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'new-' || s_name, s_acctbal, NULL FROM supplier)
    SELECT coalesce(o.c_name, n.name) AS name, CASE WHEN n.name IS NOT NULL THEN n.balance ELSE o.c_acctbal END AS balance, o.c_custkey IS NULL AS added FROM customer o FULL JOIN n ON o.c_name = n.name""")
def q_upsert_snapshot(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = old.where("id % 3 = 0").select("name", (F.col("balance") + 1).alias("balance")).union(table(spark, d, "supplier").select(F.concat(F.lit("new-"), "s_name"), "s_acctbal"))
    top = old.agg(F.max("id").alias("top"))
    return snapshot.upsert(old, new, "name", "id").crossJoin(F.broadcast(top)).select("name", "balance", (F.col("id") > F.col("top")).alias("added"))


@query("SELECT event_id FROM events WHERE NOT coalesce(ts < TIMESTAMP '2024-01-15' AND CASE WHEN user_id % 10 = 0 THEN NULL ELSE event_type END NOT IN ('purchase'), FALSE)")
def q_retention(spark, d):
    rows = table(spark, d, "events").withColumn("method", F.when(F.col("user_id") % 10 != 0, F.col("event_type")))
    return snapshot.retain(rows, "ts", F.lit("2024-01-15").cast("timestamp"), "method", ["purchase"]).select("event_id")


@query("""SELECT 'orders' AS kind, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F') UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT 'kept_links', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def q_purge_cascade(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    left = snapshot.purge(orders, F.col("o_orderstatus") == "F", "o_orderkey", {"lines": (lines, "l_orderkey", "cascade"), "log": (lines, "l_orderkey", "null")})
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(left["parents"], "orders").union(count(left["lines"], "lines")).union(count(left["log"].where("l_orderkey IS NOT NULL"), "kept_links"))


@query("""SELECT o_orderkey, field_updated, old_value, new_value FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS field_updated, unnest([o_orderstatus, o_orderpriority]) AS old_value, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END]) AS new_value FROM orders) WHERE old_value IS DISTINCT FROM new_value""")
def q_change_log(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    new = old.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("priority")).alias("priority"))
    return merge.change_log(old, new, "o_orderkey", ["status", "priority"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def q_latest_value(spark, d):
    return snapshot.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""SELECT person, rank, score FROM (SELECT doc_id AS person, row_number() OVER (ORDER BY (n_chars % 101) DESC, place) AS rank, n_chars % 101 AS score FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60) WHERE n_chars % 101 >= 40) WHERE rank <= 15""")
def q_rank_matches(spark, d):
    pool = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(60)
    pool = pool.withColumn("place", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id")) - 1)
    ranked = match.rank_matches(pool.select("place", (F.col("n_chars") % 101).alias("score")), pool)
    return ranked.select(F.col("doc_id").alias("person"), F.col("rank").cast("long").alias("rank"), "score")


from tarnwick import catalog_lookups, catalog_pages, catalog_people, catalog_streams  # noqa: E402, F401  (their queries register themselves)
