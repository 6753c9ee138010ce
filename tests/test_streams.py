"""Streams: what a restart, a replay and time do; queues and their budgets; extracts read in splits."""

import csv
import io
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import budget, merge
from tarnwick.plans import incremental
from tarnwick.sources import files
from tarnwick.streaming import cooldown, harvest
from tarnwick.versions import Store


def page(*records, token=""):
    body = "".join(f"<record><metadata><oai_dc:dc>{r}</oai_dc:dc></metadata></record>" for r in records)
    return f'<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/" xmlns:oai_dc="a" xmlns:dc="b"><ListRecords>{body}<resumptionToken cursor="0">{token}</resumptionToken></ListRecords></OAI-PMH>'


def record(title, *creators, more=""):
    return f"<dc:title>{title}</dc:title>" + "".join(f"<dc:creator>{c}</dc:creator>" for c in creators) + more


def test_records_of_a_page():
    xml = page(
        record("A &amp; B", "Lee, Ann", " ", "Wu, Bo", more="<dc:date>n.d.</dc:date><dc:date>2001-02</dc:date><dc:source> </dc:source><dc:source>J</dc:source><dc:identifier>https://doi.org/10.1/X</dc:identifier><dc:identifier>http://x.edu/1</dc:identifier><dc:identifier>http://x.edu/2</dc:identifier>"),
        record("", "Lee, Ann"), record("No one"), record("C", *[f"L{i}, F" for i in range(30)]),
    )
    first, second = harvest.records(xml)
    assert first == (["Lee, Ann", "Wu, Bo"], "A & B", 2001, "J", "10.1/X", "http://x.edu/1")
    assert second[1:] == ("C", None, None, None, None) and len(second[0]) == harvest.MOST_CREATORS


def test_a_harvest_goes_on_after_a_restart_and_a_failure(spark, tmp_path):
    folder, uri = tmp_path / "pages", f"file://{tmp_path}/pages"
    folder.mkdir()
    put = lambda token, xml: (folder / harvest.page_name(token)).write_text(xml)
    store, checkpoint = Store(spark, f"file://{tmp_path}/store"), f"{tmp_path}/checkpoint"
    run = lambda: sorted((r.author_norm, r.title, r.page) for r in harvest.harvest(spark, uri, store, checkpoint).collect())

    put("", page(record("T1", "Lee, Ann"), record("T1", "LEE, ann K."), token="a/b&amp;1"))
    one = [("lee|ann", "T1", 0)]
    assert run() == one and harvest.next_token(uri, "") == "a/b&1"
    # nothing new, then a refusal where the page should be, then the page
    assert run() == one
    put("a/b&1", "<OAI-PMH><error code='x'>later</error></OAI-PMH>")
    assert run() == one and harvest.next_token(uri, "a/b&1") is None
    put("a/b&1", page(record("T1", "Lee, Ann"), record("T2", "Wu, Bo"), token="t3"))
    put("t3", page(record("T3", "Wu, Bo")))
    three = one + [("wu|bo", "T2", 1), ("wu|bo", "T3", 2)]
    assert run() == three and run() == three and harvest.next_token(uri, "t3") == ""
    version = store.current()

    # the micro-batch was published, but its end was not noted: it is read again, and changes nothing
    commits = sorted((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    os.remove(f"{checkpoint}/commits/{commits[-1]}")
    for f in os.listdir(f"{checkpoint}/commits"):
        if f.startswith(f".{commits[-1]}"):
            os.remove(f"{checkpoint}/commits/{f}")
    assert run() == three and store.current() == version
    # all at once, the result is the same
    spark.dataSource.register(harvest.HarvestSource)
    batch = harvest.by_author(spark.read.format("harvest").option("path", uri).load())
    assert sorted((r.author_norm, r.title, r.page) for r in batch.collect()) == three
    shutil.rmtree(folder)
    folder.mkdir()
    assert spark.read.format("harvest").option("path", uri).load().count() == 0


def test_looking_up_doesnt_shuffle_the_table(spark):
    rows = spark.createDataFrame([(f"l{i % 50}|f", f"T{i}", 2000 + i % 9, None, None, None, 0, i) for i in range(2000)], "author_norm string, title string, year int, journal string, doi string, url string, page long, place long")
    people = spark.createDataFrame([(1, "F", "L1"), (2, "f.", "l-2"), (3, "G", "L1")], "person_id long, first string, last string").repartition(2)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = harvest.bucketed(rows, "harvested_test", 4)
        found = harvest.look_up(spark.createDataFrame([(i, "F", f"L{chr(97 + i % 26)}") for i in range(30)], "person_id long, first string, last string"), table)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # the only exchanges are the people's, before the join, and the places', behind it
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(author_norm") <= 1
        assert harvest.look_up(people, rows).count() == 0  # digits don't make names
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS harvested_test")


def test_cooldown(spark, tmp_path):
    schema = "key string, row string, stamp timestamp, model string, gone boolean"
    put = lambda *rows: spark.createDataFrame(rows, "key string, row string, stamp string, model string, gone boolean").withColumn("stamp", F.col("stamp").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        changes = cooldown.into_folder(cooldown.freshness(stream, "m", 10), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return {r.key: r.fresh_until and r.fresh_until.strftime("%m-%d") for r in cooldown.latest(changes).collect()}

    put(("a", "1", "2024-01-01", "m", False), ("a", "2", "2024-01-03", "m", False), ("b", "1", "2024-01-02", "m", False), ("c", "1", "2024-01-02", "other", False))
    assert run() == {"a": "01-11", "b": "01-12", "c": None}
    # a row judged anew, an older judgement that comes late, a row that another model judged, one taken away
    put(("a", "1", "2024-01-04", "m", False), ("c", "1", "2024-01-04", "m", False), ("c", "1", "2024-01-03", "other", False))
    assert run() == {"a": "01-13", "b": "01-12", "c": "01-14"}
    put(("a", "2", "2024-01-05", "other", False), ("c", "2", "2024-01-05", "x", False))
    assert run() == {"a": None, "b": "01-12", "c": None}
    put(("a", "2", "2024-01-06", "m", True), ("c", "1", "2024-01-06", "m", False))
    assert run() == {"a": "01-14", "b": "01-12", "c": None}
    # time passes, for keys too of which nothing is heard
    put(("d", "1", "2024-01-13 12:00:00", "m", False))
    assert run() == {"a": "01-14", "b": None, "c": None, "d": "01-23"}


def test_a_batch_reads_and_writes_a_keys_state_once():
    """However many rows it brings and the key has; the last judgement of each counts, unknown times first."""
    from types import SimpleNamespace as N

    calls, kept = [], [None]
    value = N(get=lambda: calls.append("get") or kept[0], update=lambda v: calls.append("update") or kept.__setitem__(0, v))
    handle = N(getValueState=lambda *_: value, registerTimer=lambda t: calls.append(t), deleteTimer=lambda t: calls.append(-t))
    judge = cooldown.Cooldown("m", 1)
    judge.init(handle)
    said = lambda *rows: [r.until for r in judge.handleInputRows(("k",), iter([N(row=r, micros=t, model=m, gone=False) for r, t, m in rows]), N(getCurrentWatermarkInMs=lambda: 0))]
    day = 86_400_000_000
    assert said(*((str(i), 5000 + i, "m") for i in range(50)), ("0", None, "x"), ("1", 4000, "x")) == [day + 5000]
    assert calls == ["get", day // 1000 + 6, "update"]
    calls.clear()
    assert said(("7", 9000, "x")) == [None] and calls == ["get", -(day // 1000 + 6), "update"] and len(kept[0][0]) == 50


def test_enrichment_by_batches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    kind = "person_id long, field string, source string, confidence double, pos long, entry string"
    put = lambda epoch, *rows: incremental.apply_batch(store, spark.createDataFrame(rows, kind), epoch)
    entries = lambda: {r.person_id: [(e.field, e.entry, e.sources) for e in r.entries] for r in incremental.profiles(store).collect()}

    put(0, (1, "awards", "b", 0.8, 0, '"Prize X"'), (2, "expertise_keywords", "b", 0.8, 0, '"sea"'))
    put(1, (1, "awards", "a", 0.9, 0, '{"name": "Prize X"}'), (1, "awards", "a", 0.9, 1, '{"name": "Prize X", "year": 2001}'))
    want = {1: [("awards", '{"name":"Prize X"}', ["a", "b"]), ("awards", '{"name":"Prize X","year":2001}', ["a"])], 2: [("expertise_keywords", '"sea"', ["b"])]}
    assert entries() == want
    version = store.current()
    put(1, (1, "awards", "a", 0.9, 0, '"never"'))
    assert entries() == want and store.current() == version
    # what says the same again leaves the profile, what a source says replaces what it said
    put(2, (2, "expertise_keywords", "b", 0.8, 0, '"sea"'))
    assert store.manifest()["tables"]["profiles-3"]["rows"] == 0
    put(3, (1, "awards", "b", 0.8, 0, '"Prize Y"'))
    assert entries()[1] == [("awards", '{"name":"Prize X"}', ["a"]), ("awards", '{"name":"Prize X","year":2001}', ["a"]), ("awards", '"Prize Y"', ["b"])]
    before = entries()
    incremental.compact(store)
    assert entries() == before and sum(n.startswith("profiles-") for n in store.manifest()["tables"]) == 1
    put(4, (2, "expertise_keywords", "c", 0.9, 0, '"Sea!"'))
    assert entries()[2] == [("expertise_keywords", '"Sea!"', ["b", "c"])]


def test_contributions_move_once(spark):
    rows = spark.createDataFrame([(1, "awards", "b", 0.8, 0, '"Prize X"', 1), (1, "awards", "b", 0.8, 0, '"Prize Y"', 2)], "person_id long, field string, source string, confidence double, pos long, entry string, _segment int")
    new = incremental._profiled(rows)
    assert new._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [e.entry for e in new.first().entries] == ['"Prize Y"']


def test_entries_are_parsed_once(spark, tmp_path):
    """When a batch is written; merging and profiles have the keys. A segment of before may lack them."""
    kind = "person_id long, field string, source string, confidence double, pos long, entry string"
    first = spark.createDataFrame([(1, "awards", "b", 0.8, 0, '{"year": 2001, "name": "Prize X"}'), (1, "awards", "b", 0.8, 1, "{cut"), (2, "expertise_keywords", "b", 0.8, 0, '"Sea!"')], kind)
    second = spark.createDataFrame([(1, "awards", "a", 0.9, 0, '"prize x 2001"'), (3, "patents", "a", 0.9, 0, '{"patent_number": 7}')], kind)
    old, new = Store(spark, f"file://{tmp_path}/old"), Store(spark, f"file://{tmp_path}/new")
    entry = "struct<field:string,place:bigint,entry:string,sources:array<string>>"
    profile = [(1, [("awards", 1, '{"name":"Prize X","year":2001}', ["b"])], "x"), (2, [("expertise_keywords", 1, '"Sea!"', ["b"])], "y")]
    old.publish({"contributions-1": first, "profiles-1": spark.createDataFrame(profile, f"person_id long, entries array<{entry}>, raw_hash string")}, 0, {"epoch": 0})
    incremental.apply_batch(new, first, 0)
    want = {1: [("awards", 1, '"prize x 2001"', ["a", "b"], "prizex2001")], 2: [("expertise_keywords", 1, '"Sea!"', ["b"], "sea")], 3: [("patents", 1, '{"patent_number":7}', ["a"], "7")]}
    for store in (old, new):
        incremental.apply_batch(store, second, 1)
        assert store.manifest()["tables"]["profiles-2"]["rows"] == 2
        assert {r.person_id: [tuple(e) for e in r.entries] for r in incremental.profiles(store).collect()} == want
    kept = new.read("contributions-1")
    assert {r.entry: r.key for r in kept.collect()} == {'{"name":"Prize X","year":2001}': "prizex2001", None: "", '"Sea!"': "sea"}
    plans = [df._jdf.queryExecution().executedPlan().toString().lower() for df in (incremental._merged(kept), incremental.profiles(new))]
    assert not any("variant" in p or "parsejson" in p for p in plans)


def test_entries_of_all_shapes(spark):
    rows = [("recent_publications", '{"title": "On Seas", "year": 2001}'), ("recent_publications", '"on SEAS!"'), ("recent_publications", '{"title": "x", "doi": "10.1/A", "year": 2005}'), ("recent_publications", '{"doi": "10.1/a"}'), ("patents", '{"title": "P", "patent_number": 7}'), ("patents", '{"title": "p"}'), ("patents", '"P"'), ("funded_grants", '{"title": null, "agency": "N I H"}'), ("funded_grants", '"nih"'), ("awards", '{"name": "A", "year": 2001}'), ("awards", '"a2001"'), ("expertise_keywords", '{"k": 1}'), ("recent_publications", "null"), ("awards", "{}")]
    df = spark.createDataFrame([(1, f, "s", 0.5, i, e) for i, (f, e) in enumerate(rows)], "id long, field string, source string, confidence double, pos long, entry string").withColumn("entry", F.try_parse_json("entry"))
    got = [(r.field, r.entry) for r in merge.merge_entries(df, ["id"]).orderBy("field", "place").select("field", F.to_json("entry").alias("entry")).collect()]
    assert got == [("awards", '{"name":"A","year":2001}'), ("expertise_keywords", '{"k":1}'), ("funded_grants", '{"agency":"N I H","title":null}'), ("patents", '{"patent_number":7,"title":"P"}'), ("patents", '{"title":"p"}'), ("recent_publications", '{"doi":"10.1/A","title":"x","year":2005}'), ("recent_publications", '{"title":"On Seas","year":2001}')]


def test_budgets(spark):
    draw = random.Random(5)
    rows = [(i, draw.random() < 0.4, draw.randrange(9), draw.random() < 0.45) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, needs boolean, cost long, failed boolean").repartition(7)
    lined = {r.id: (r.place, r.used, r.spent) for r in budget.in_line(df, ["id"], used=F.col("needs").cast("long"), spent=F.col("cost")).collect()}
    assert lined == {i: (i + 1, sum(r[1] for r in rows[:i]), sum(r[2] for r in rows[:i])) for i in range(300)}
    granted = [r.id for r in budget.with_lookups(df, ["id"], F.col("needs"), 20).where("granted").collect()]
    assert sorted(granted) == [r[0] for r in rows if r[1]][:20]
    assert budget.with_lookups(df, ["id"], F.col("needs"), None).where("granted").count() == sum(r[1] for r in rows)
    assert budget.with_lookups(df, ["id"], F.col("needs"), 0).where("granted").count() == 0
    in_time = sorted(r.id for r in budget.within_time(df, ["id"], F.col("cost"), 500, 30).collect())
    assert in_time == [i for i in range(300) if sum(r[2] for r in rows[:i]) <= 470]
    for most in (1, 3, 6, 400):
        end = next((i for i in range(most - 1, 300) if all(r[3] for r in rows[i - most + 1 : i + 1])), 299)
        assert sorted(r.id for r in budget.until_failures(df, ["id"], F.col("failed"), most).collect()) == list(range(end + 1))
    assert budget.until_failures(df, ["id"], F.lit(False), 3, F.col("id") == 17).count() == 18
    assert budget.in_line(df.limit(0), ["id"], spent=F.col("cost")).count() == 0


@pytest.mark.parametrize("width", ["64k", "1g"])
def test_a_large_extract_equals_the_csv_module(spark, tmp_path, width):
    """100,000 rows with quotes, commas and line ends within fields, in many splits and in one."""
    draw = random.Random(1)
    cells = ["x", "", "a,b", 'say "hi"', "two\nlines", "cr\r\nlf", 'Zoë "q"\n\n', "  pad "]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    rows = [[str(i), draw.choice(cells), draw.choice(cells), draw.choice(cells)] for i in range(100_000)]
    writer.writerows(rows)
    (tmp_path / "r.csv").write_bytes(('odd " line\nx\ny\nid,"Full, Name",b,c\r\n' + out.getvalue()).encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    try:
        got = files.roster_csv(spark, str(tmp_path / "r.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got.columns == ["pos", "id", "Full, Name", "b", "c"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == [(i, *r) for i, r in enumerate(rows)]


def test_extracts_whose_columns_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n\n\nName,Mail\nAnn,a@x\n,\n\nBo\n")
    (tmp_path / "b.csv").write_text("\n\n\nMail,Other,Name\nc@x,o,Cy\n")
    got = sorted((r.pos, r.Name, r.Mail) for r in files.roster_csv(spark, str(tmp_path)).collect())
    assert got == [(0, "Ann", "a@x"), (0, "Cy", "c@x"), (3, "Bo", "")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("only\n")
    assert files.roster_csv(spark, str(tmp_path / "none")).count() == 0
