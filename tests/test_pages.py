"""Pages as trees: the parse against a walk by hand, and the questions' awkward cases."""

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import prompts
from tarnwick.sources import dom

PAGE = """<!DOCTYPE html><html><head><meta name="description" content="About &amp; more"><title>T</title></head>
<body><!-- no --><nav><a name="x">anchor</a><a href="/profile/1"> Ann <b>Lee</b></a></nav>
<div id="main-col"><h2>Research</h2><p>one<p>two<br>three</p></div><script>"<p>no</p>"</script></body></html>"""


@pytest.fixture(scope="module")
def ask(spark):
    def run(html, *questions):
        rows = spark.createDataFrame([(html,)], "html string").select(dom.parsed("html").alias("tree"))
        got = rows.select(*(q(F.col("tree")).alias(f"q{i}") for i, q in enumerate(questions))).first()
        return got[0] if len(questions) == 1 else tuple(got)

    return run


def test_parse(ask, spark):
    tree = ask(PAGE, lambda t: t)
    assert [n.at for n in tree] == list(range(len(tree)))
    for n in tree[1:]:
        assert tree[n.parent].at < n.at < n.end <= tree[n.parent].end
    assert [n.tag for n in tree if n.tag not in ("", "#text")] == ["html", "head", "meta", "title", "body", "nav", "a", "a", "b", "div", "h2", "p", "p", "br", "script"]
    # the second p lies in the first, which the tag after it closes
    first, second = [n for n in tree if n.tag == "p"]
    assert second.parent == first.at and all("no" not in (n.text or "") for n in tree)
    assert ask("", lambda t: F.size(t)) == 1 and ask(None, lambda t: t) is None
    assert ask("</p></div>a<b>", lambda t: F.transform(t, lambda n: n["tag"])) == ["", "#text", "b"]
    deep = ask("<div>" * 3000 + "x", lambda t: F.size(t))
    assert deep == 3002


def test_texts_and_links(ask):
    assert ask(PAGE, lambda t: F.transform(dom.tagged(t, ["div"]), lambda n: dom.clean_text(t, n))) == ["Researchonetwothree"]
    assert ask(PAGE, lambda t: F.transform(dom.links(t), lambda x: F.concat_ws("|", x["href"], x["text"]))) == ["/profile/1|AnnLee"]
    assert ask(PAGE, lambda t: dom.link_to(t, F.lit("annlee"), "/profile/")) == "/profile/1"
    assert ask(PAGE, lambda t: dom.link_to(t, F.lit("annlee"), "/people/")) is None
    one = "<p><i><b> x </b></i></p><p>a<b></b></p><p></p>"
    assert ask(one, lambda t: F.transform(dom.tagged(t, ["p"]), lambda n: dom.own_text(t, n))) == [" x ", None, None]


def test_sections(ask):
    words = ["research", "interests"]
    assert ask(PAGE, lambda t: dom.sections(t, words)) == "onetwothree About & more"
    page = "<h2>Research</h2><p> a  b </p><div><h3>Deeper</h3><p>c</p></div><h4>Other</h4><p>no</p><h3>INTERESTS</h3><ul><li>x</li><li>y</li></ul>"
    # what is deeper than the heading doesn't end its section
    assert ask(page, lambda t: dom.sections(t, words)) == "a b Deeperc xy"
    assert ask("<h1>Research</h1><p>a</p>", lambda t: dom.sections(t, words)) is None
    assert len(ask("<h2>Research</h2><p>" + "ab " * 3000 + "</p>", lambda t: dom.sections(t, words))) == 2000


def test_addresses(ask):
    mail = lambda html, **k: ask(html, lambda t: dom.address(t, "x.edu", ["info@x.edu"]))
    assert mail('<a href="mailto:info@x.edu">i</a><a href="mailto:A.B@X.edu?subject=x">a</a>') == "a.b@x.edu"
    assert mail('<a href="mailto:one@x.edu">i</a><main><a href="mailto:two@x.edu">a</a></main>') == "two@x.edu"
    assert mail('<div class="a profile-box"><p>x</p></div><a href="mailto:one@x.edu">i</a>') == "one@x.edu"
    assert mail("<footer>some one@x.edu</footer>") is None
    assert mail("<dl><dt>E-mail contact</dt><dd>me@sub.x.edu</dd></dl>") == "me@sub.x.edu"
    assert mail("<h3>Contact</h3><p>info@x.edu</p><p>you@x.edu</p><h3>x</h3><p>no@x.edu</p>") == "you@x.edu"
    assert mail("<p>Email: me@x.edu</p>") == "me@x.edu" and mail("<p>Email: <b>me@x.edu</b></p>") is None
    assert mail("") is None and mail('<a href="mailto:me@y.org">x</a>') is None
    any_ = lambda html: ask(html, lambda t: dom.any_address(t, "x.edu", ["info@x.edu"], ["office"]))
    assert any_("<p>office@x.edu</p><p> b+c@x.edu </p>") == "b+c@x.edu"
    assert any_('<p>first@x.edu</p><a href="mailto:J%2Eo+x%40x.edu">m</a>') == "j.o+x@x.edu"


def test_directory_entries_and_cards(ask):
    table = "<table><tr><td>Ann Roy</td><td>ann@x.edu</td></tr><tr><td>Ann Lee</td></tr><tr><td>Lee, Ann</td><td><a href='mailto:al@x.edu'>m</a></td></tr></table>"
    assert ask(table, lambda t: dom.entry_address(t, F.lit("Ann"), F.lit("LEE"), "x.edu")) == "al@x.edu"
    assert ask(table, lambda t: dom.entry_address(t, F.lit("Bo"), F.lit("Lee"), "x.edu")) is None
    cards = "<div class='c'><a href='/profile/9'>Lee, Ann</a><span class='job TITLE'> Prof </span></div><div><a href='/profile/8'>x</a></div><li class='c'><a href='/no'>y</a></li>"
    assert [tuple(c) for c in ask(cards, lambda t: dom.cards(t, "/profile/"))] == [("Lee, Ann", "Prof", "/profile/9")]


def test_one_hop(spark):
    searches = spark.createDataFrame([(1, "Ann Lee", "<a href='/profile/1'>Ann Lee</a>"), (2, "Bo Wu", "<a href='https://x.edu/profile/2'>Prof Bo Wu</a>"), (3, "Cy Li", "<a href='/profile/3'>Cy</a>")], "person long, name string, html string").withColumn("tree", dom.parsed("html"))
    pages = spark.createDataFrame([("https://x.edu/profile/1", "<h2>Overview</h2><p>r</p>"), ("https://x.edu/profile/2", "<p>none</p>"), ("https://x.edu/profile/3", "")], "url string, html string").withColumn("tree", dom.parsed("html"))
    led = dom.followed(searches, pages, "/profile/", "https://x.edu").select("person", dom.profile(F.col("tree"), ["overview"], "x.edu").alias("p"))
    assert sorted((r.person, r.p and r.p.research) for r in led.collect()) == [(1, "r"), (2, None)]


def test_listing_entries(spark):
    lines = {
        "Adams, Peter B., B.S., Ph.D., Professor": ("Peter", "Adams", "Professor", ["BS", "PHD"]),
        "Baker, Jane, PhD, Dr.P.H., Research Scientist of X": ("Jane", "Baker", "Research Scientist", ["PHD", "DRPH"]),
        "Room 12, Main, Lecturer": None, "No comma Professor": None, "Li, Cy, Clerk": None, "x,": None, ", Bo, Professor": None, "Wu, , Professor": None, "a, b Professor" + "x" * 500: None,
    }
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", prompts.listing_entry(F.col("line")).alias("e")).collect()
    assert {r.line: r.e and (r.e["first"], r.e["last"], r.e["title"], r.e["degrees"]) for r in rows} == lines


def _parts_of(tree, tags):
    return [(n.at, [(m.at - n.at, None if m.at == n.at else m.parent - n.at, m.end - n.at, m.tag, m.text, m.attrs) for m in tree[n.at : n.end]]) for n in tree if n.tag in tags]


def test_parts_are_slices_of_the_tree(spark):
    import random

    draw = random.Random(3)
    bits = ["<div class='c'>", "</div>", "<li>", "</li>", "<p>", "</p>", "<a href='/profile/1&amp;x'>", "</a>", "a b", "&amp;", "<br>", "<script>", "</script>", "x<y", "<!-- <li> -->"]
    pages = ["", PAGE, None, *("".join(draw.choice(bits) for _ in range(draw.randrange(60))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(pages)), "page long, html string")
    whole = {r.page: r.tree for r in rows.select("page", dom.parsed("html").alias("tree")).collect() if r.tree}
    for piece in (1 << 18, 40):
        got = {}
        for r in dom.parts(rows, ["li", "div"], piece=piece).collect():
            got.setdefault(r.page, []).append((r.at, [tuple(n) for n in r.tree]))
        for page, tree in whole.items():
            want = [(at, [(a, p, e, t, x, m) for a, p, e, t, x, m in part]) for at, part in _parts_of(tree, ["li", "div"])]
            assert sorted(got.get(page, []), key=lambda x: x[0]) == want


def test_large_directories_are_asked_by_a_join(spark):
    """A directory of 3,000 entries, the same questions as of one tree; each page is asked for all of its people."""
    entry = lambda i: f"<tr><td>Ann No{i:05d}</td><td> " + ("" if i % 3 == 2 else f"p{i}@x.edu") + "</td></tr>"
    pages = spark.createDataFrame([("a", "<table>" + "".join(map(entry, range(3000))) + "</table>"), ("b", "<li>Bo Wu <a href='mailto:info@x.edu'>i</a></li><li>Wu, BO bo@x.edu</li><li>Bo Wu late@x.edu</li>")], "page string, html string")
    people = [(i, "a", "ann", f"no{i:05d}") for i in range(3000)] + [(5000, "b", "Bo", "Wu"), (5001, "b", "", "wu"), (5002, "b", None, "Wu"), (5003, "b", "Cy", "Wu"), (5004, "a", "Bo", "Wu"), (5005, "c", "Bo", "Wu"), (5006, "b", "", "")]
    asked = spark.createDataFrame(people, "id long, page string, first string, last string")
    got = {r.id: r.email for r in dom.entry_addresses(asked, pages, ["page"], "x.edu", ["info@x.edu"]).collect()}
    want = {i: None if i % 3 == 2 else f"p{i}@x.edu" for i in range(3000)}
    assert got == want | {5000: "bo@x.edu", 5001: "bo@x.edu", 5002: None, 5003: None, 5004: None, 5005: None, 5006: "bo@x.edu"}


def test_many_people_of_one_search(spark):
    card = lambda i: f"<li class='c'><a href='/{'profile' if i % 2 else 'people'}/{i}'>Prof NO{i:05d}</a><a href='/profile/x{i}'>no{i:05d} again</a></li>"
    searches = spark.createDataFrame([("a", "<ul>" + "".join(map(card, range(2000))) + "</ul>")], "page string, html string")
    people = spark.createDataFrame([(i, "a", f"No{i:05d}") for i in range(2000)] + [(9000, "a", "missing"), (9001, "b", "No00001")], "person long, page string, name string")
    captured = spark.createDataFrame([(f"https://x.edu/profile/{x}{i}", f"{x}{i}") for i in range(2000) for x in ("", "x")], "url string, html string")
    led = dom.followed_from(people, searches, captured, ["page"], "/profile/", "https://x.edu")
    assert {r.person: r.html for r in led.collect()} == {i: str(i) if i % 2 else f"x{i}" for i in range(2000)}
    cards = dom.card_rows(searches, "/profile/").select("c.href").collect()
    assert sorted(r.href for r in cards) == sorted(f"/profile/{i}" for i in range(2000) if i % 2)
