from pyspark.sql import functions as F

from tarnwick.functions import jsonx, names, stem, text
from tarnwick.operators import rules


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_names(spark):
    rows = spark.createDataFrame([("Okafor, Ngozi B.", "Ngozi", "Okafor"), ("Ulla af Ek", "Ulla", "af Ek"), ("Teller", "Teller", ""), (", Ivo", "Ivo", ""), (None, "", "")], "raw string, f string, l string")
    for r in rows.select(names.parse_name(F.col("raw")).alias("n"), "f", "l").collect():
        assert (r.n["first"], r.n["last"]) == (r.f, r.l)
    # six tenths for the last name, four for the first, graded
    scores = [("Ulla", "Ek", "ulla", "EK", 1.0), ("Ulla", "Ek", "Ullabritt", "Ek", 0.94), ("Stefan", "Ek", "Stelios", "Ek", 0.84), ("Stefan", "Ek", "Sven", "Ek", 0.72), ("Stefan", "Ek", "Bo", "Ek", 0.0), ("Ulla", "Ek", "Ulla", "Ekman", 0.88), ("Ulla", "Ek", "Ulla", "Roy", 0.0), ("Ulla", "", "Ulla", "Ek", 0.0)]
    df = spark.createDataFrame(scores, "a string, b string, c string, d string, want double")
    assert [r.got for r in df.select(names.similarity(*(F.col(k) for k in "abcd")).alias("got")).collect()] == [x[4] for x in scores]
    pairs = spark.createDataFrame([("ulla", "ek", "ullabritt", "ekman", True), ("ulla", "ek", "ull", "ek", True), ("ulla", "ek", "uno", "ek", False), ("ulla", "ek", "ulla", "roy", False), ("", "ek", "ulla", "ek", False)], "a string, b string, c string, d string, want boolean")
    assert all(r.want == r.got for r in pairs.select("want", names.compatible(*(F.col(k) for k in "abcd")).alias("got")).collect())
    got = one(spark, names.variants(F.col("a"), F.col("b")), a="Ulla-Britt", b="af Ek")
    assert [(v["first"], v["last"]) for v in got] == [("Ulla", "af Ek"), ("U", "af Ek"), ("Ulla-Britt", "afEk"), ("Ulla-Britt", "Ek"), ("Ulla-Britt", "af")]
    mine = lambda a: one(spark, names.plausible_email(F.col("a"), F.col("b"), F.col("c")), a=a, b="Ngozi", c="Okafor")
    assert mine("n.okafor@x.org") and mine("ngo12@x.org") and mine("no77@x.org") and not mine("office@x.org") and not mine("zz77@x.org")


def test_text(spark):
    assert one(spark, text.slug(F.col("a")), a="  Arts & Humanities ") == "arts-humanities"
    assert one(spark, text.query_tokens(F.col("a")), a="García a GARCÍA x2") == ["garcía", "x2"]
    assert one(spark, text.email_local(F.col("a")), a=" Ab@X.org") == "ab"
    assert one(spark, text.split_list(F.col("a")), a="a, b,, c ") == ["a", "b", "c"]
    assert one(spark, text.url_decoded(F.col("a")), a="a%40b+c%zz") == "a%40b+c%zz"
    assert one(spark, text.url_decoded(F.col("a")), a="a%40b+c") == "a@b+c"
    assert one(spark, text.percent(F.col("a"), F.col("b")), a=49, b=400) == 12.2


def test_stems():
    for word, want in {"caresses": "caress", "ponies": "poni", "relational": "relat", "connecting": "connect", "connection": "connect", "genomics": "genom", "happy": "happi", "agreed": "agre", "hopping": "hop", "falling": "fall", "controlling": "control", "adjustable": "adjust", "sky": "sky"}.items():
        assert stem.porter(word) == want, word
    assert stem.unaccented("García") == "Garcia"


def test_stems_in_the_plan(spark):
    """The expression, the SQL and the function for single words agree, on odd words too."""
    import itertools

    import duckdb

    words = {a + b + c for a, b, c in itertools.product(["", "y", "by", "oat", "syll", "Ñandú", "troubl", "fizz", "hopp", "agr", "x1"], ["", "i", "at", "iv", "e", "ee", "al", "yy"], ["", "s", "ies", "sses", "ed", "ing", "eed", "y", "ation", "ization", "fulness", "ical", "ement", "ion", "sion", "ll", "e", "ize"])} - {""}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stem.stem(F.col("w")).alias("s")).collect()}
    assert got == {w: stem.porter(stem.unaccented(w.lower())) for w in words}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE words (raw VARCHAR)")
    duck.executemany("INSERT INTO words VALUES (?)", [[w] for w in words])
    assert dict(duck.execute(stem.stem_sql("raw")).fetchall()) == got


def test_json_recovery():
    assert jsonx.recover('{"a": 1}') == '{"a": 1}'
    assert jsonx.recover('x\n```json\n[1]\n```') == "[1]"
    assert jsonx.recover('say {"a": 2} ok') == '{"a": 2}'
    assert jsonx.recover("no") is None and jsonx.recover(None) is None and jsonx.recover("") is None


def test_first_match_and_division(spark):
    registry = [{"slug": "a", "label": "A", "equals": ["Alpha"]}, {"slug": "b", "label": "B", "contains": ["beta"], "bundle": "x"}, {"slug": "c", "label": "C", "exact": ["SEA"]}]
    rows = spark.createDataFrame([("alpha ", "a"), ("The Beta School", "b"), ("SEA Biology", "c"), ("sea biology", "sea-biology"), ("", "other"), (None, "other")], "x string, want string")
    assert all(r.slug == r.want for r in rows.select("want", rules.division(F.col("x"), registry)["slug"].alias("slug")).collect())
