"""Publication by manifest, and the index of segments that rests on it."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tarnwick import versions
from tarnwick.operators import search


@pytest.fixture
def store(spark, tmp_path):
    return versions.Store(spark, f"file://{tmp_path}/store")


def frame(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_are_whole_and_stay(spark, store):
    assert store.current() == 0 and store.versions() == []
    assert store.publish({"people": frame(spark, 1, 2), "log": frame(spark)}, 0, {"by": "a"}) == 1
    held = store.read("people", 1)
    assert store.publish({"people": frame(spark, 3)}, 1) == 2
    assert ids(held) == [1, 2] and ids(store.read("people")) == [3] and store.read("log").count() == 0
    assert store.manifest(2)["notes"] == {"by": "a"} and store.manifest(2)["tables"]["log"] == store.manifest(1)["tables"]["log"]
    assert store.publish({}, 2, drop=["log"]) == 3 and set(store.manifest()["tables"]) == {"people"}
    store.keep(1)
    assert store.versions() == [3] and ids(store.read("people")) == [3]


def test_a_writer_behind_another_is_refused(spark, store, tmp_path):
    store.publish({"people": frame(spark, 1)}, 0)
    store.publish({"people": frame(spark, 2)}, 1)
    folders = set((tmp_path / "store" / "data").iterdir())
    with pytest.raises(versions.Conflict):
        store.publish({"people": frame(spark, 9)}, 1)
    # it has left nothing, and the other's version stands
    assert set((tmp_path / "store" / "data").iterdir()) == folders and ids(store.read("people")) == [2] and store.current() == 2


def test_of_concurrent_writers_one_wins(spark, store):
    store.publish({"people": frame(spark, 0)}, 0)
    won, lost = [], []

    def write(i):
        try:
            won.append((i, store.publish({"people": frame(spark, i)}, 1)))
        except versions.Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in (1, 2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3 and won[0][1] == 2 and ids(store.read("people", 2)) == [won[0][0]]


def test_a_writer_that_fails_leaves_the_version(spark, store, tmp_path):
    store.publish({"people": frame(spark, 1)}, 0)
    broken = frame(spark, 2).withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.publish({"log": frame(spark, 5), "people": broken}, 1)
    assert store.current() == 1 and ids(store.read("people")) == [1] and len(list((tmp_path / "store" / "data").iterdir())) == 1
    # one that died left a folder without a manifest
    (tmp_path / "store" / "data" / "dead").mkdir()
    store.keep(5)
    assert not (tmp_path / "store" / "data" / "dead").exists() and ids(store.read("people")) == [1]


def test_checks_before_publication(spark, store):
    checks = [versions.same_rows("people", "indexed"), versions.unique("people", "id")]
    assert store.publish({"people": frame(spark, 1, 2), "indexed": frame(spark, 1, 2)}, 0, checks=checks) == 1
    with pytest.raises(versions.Refused, match="people has 3 rows, indexed 2"):
        store.publish({"people": frame(spark, 1, 2, 3)}, 1, checks=checks)
    with pytest.raises(versions.Refused, match="people has 2 twice"):
        store.publish({"people": frame(spark, 2, 2)}, 1, checks=checks)
    assert store.current() == 1


def answers(index, query):
    return [(r.doc_id, round(r.score, 9)) for r in search.search(index, query, limit=50, every=False).collect()]


def test_an_index_that_changes_equals_a_new_one(spark, tmp_path):
    draw = random.Random(3)
    words = ["sea", "seas", "life", "lives", "garcía", "garcia", "connected", "connection", "deep"]
    index = search.SegmentedIndex(spark, f"file://{tmp_path}/index")
    assert answers(index.index(), "sea") == []
    now = {}
    for step in range(5):
        changed = {draw.randrange(30): " ".join(draw.choices(words, k=draw.randrange(12))) for _ in range((20, 4, 3, 9, 1)[step])}
        gone = draw.sample(sorted(now.keys() - changed.keys()), 2) if step else []
        version = index.apply(spark.createDataFrame(list(changed.items()), "doc_id long, text string"), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        now = {i: t for i, t in (now | changed).items() if i not in gone}
        fresh = search.build_index(spark.createDataFrame(list(now.items()), "doc_id long, text string"))
        for query in ("sea", "connecting garcia", "li deep"):
            assert answers(index.index(), query) == answers(fresh, query)
        assert tuple(index.index().stats.first()) == tuple(fresh.stats.first())
    # there are few segments, and a reader of an older version isn't disturbed
    assert len(index._segments(index.store.manifest())) < 5
    assert json.loads(json.dumps(index.store.manifest()))["version"] == version


def test_what_doesnt_fit_together_isnt_published(spark, tmp_path):
    from tarnwick.plans import publication

    store = versions.Store(spark, f"file://{tmp_path}/people")
    people = spark.createDataFrame([(1, "a", "x", "Ann", ["PhD", None]), (2, "b", "x", None, None)], "id long, stable_key string, department string, first_name string, degrees array<string>")
    assert publication.publish(store, people, 0, F.lit("now")) == 1
    with pytest.raises(versions.Refused, match="twice"):
        publication.publish(store, people.withColumn("stable_key", F.lit("a")), 1, F.lit("now"))
    row = store.read("people").where("id = 1").first()
    assert (row.degrees, row.identity_status, row.has_profile, row.updated_at, store.current()) == ('["PhD",null]', "unresolved", 0, "now", 1)
    publication.export(store.read("people"), f"{tmp_path}/export")
    assert publication.rebuild(spark, f"file://{tmp_path}/export", versions.Store(spark, f"file://{tmp_path}/again"), F.lit("now")) == 1
