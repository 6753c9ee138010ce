"""Pages as trees, and questions to them.

A page is parsed once, in Arrow batches, into the array of its nodes in document order. A node has its
place ``at``, its parent's, the place ``end`` behind its last descendant, its tag, attributes and, if it
is a text (tag ``#text``), the text. Descendants are a slice of the array, siblings are a filter by
parent, so every question is an expression of Spark over that array; :func:`nodes` gives it as rows, to
be joined. Tags that are never closed hold what follows up to the end of what they are in, as in the
parser that pages were written for; scripts and styles have no text.

A page with thousands of entries isn't asked as a whole: :func:`parts` gives each entry as a row with the
tree of its own nodes, and :func:`showing` finds the entries that show a name by an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A node, as a type that needs no session, for the workers import this module too.
NODE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("at", "parent", "end")] + [T.StructField(c, T.StringType()) for c in ("tag", "text")] + [T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))])

#: Elements without content, and those whose content is no text of the page.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
SILENT = ("script", "style", "template")
#: Headings that begin a section, and what an address may be announced in.
HEADINGS = ("h2", "h3", "h4")
CONTACT_TAGS, CONTACT_HEADINGS = ("span", "p", "div", "li"), ("h2", "h3", "h4", "dt", "label")
ENTRY_TAGS, CARD_TAGS = ("tr", "div", "li", "article"), ("div", "li", "article")


class _Tree(HTMLParser):
    """The nodes of a page; the first is the page itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self._begin("", {})

    def _begin(self, tag: str, attrs: dict, text: str | None = None) -> int:
        at = len(self.nodes)
        self.nodes.append({"at": at, "parent": self.open[-1] if self.open else None, "end": at + 1, "tag": tag, "text": text, "attrs": attrs})
        if text is None:
            self.open.append(at)
        return at

    def _end(self) -> None:
        self.nodes[self.open.pop()]["end"] = len(self.nodes)

    def handle_starttag(self, tag, attrs):
        self._begin(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, {k: v or "" for k, v in attrs})
        self._end()

    def handle_endtag(self, tag):
        if any(self.nodes[at]["tag"] == tag for at in self.open):
            while self.nodes[self.open[-1]]["tag"] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        inside = self.nodes[self.open[-1]]
        if any(self.nodes[at]["tag"] in SILENT for at in self.open):
            return
        last = self.nodes[-1]
        if last["tag"] == "#text" and last["parent"] == inside["at"]:
            last["text"] += data
        else:
            self._begin("#text", {}, data)

    def tree(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        while self.open:
            self._end()
        return self.nodes


@F.pandas_udf(T.ArrayType(NODE))
def parsed(pages: pd.Series) -> pd.Series:
    """The nodes of each page; null for null."""
    return pages.map(lambda html: None if html is None else _Tree().tree(html))


class _Parts(_Tree):
    """The elements of some tags, each as a tree of its own, of a page that is read in pieces; nodes are kept
    no longer than an element that needs them."""

    def __init__(self, tags: Sequence[str]) -> None:
        self.tags, self.ended, self.free = tags, [], 0
        super().__init__()

    def _end(self) -> None:
        at = self.open[-1]
        super()._end()
        if self.nodes[at]["tag"] in self.tags:
            self.ended.append(at)

    def _taken(self) -> Iterator[tuple[int, list[dict]]]:
        for at in sorted(self.ended):
            top = self.nodes[at]
            yield at, [n | {"at": n["at"] - at, "parent": None if n["at"] == at else n["parent"] - at, "end": n["end"] - at} for n in self.nodes[at : top["end"]]]
        self.ended = []
        # the last node may be a text that goes on
        first = next((at for at in self.open if self.nodes[at]["tag"] in self.tags), len(self.nodes) - 1)
        held = set(self.open)
        self.nodes[self.free : first] = [n if i in held else None for i, n in enumerate(self.nodes[self.free : first], self.free)]
        self.free = first

    def parts(self, html: str, piece: int) -> Iterator[tuple[int, list[dict]]]:
        for i in range(0, len(html), piece):
            self.feed(html[i : i + piece])
            yield from self._taken()
        self.close()
        while self.open:
            self._end()
        yield from self._taken()


def nodes(pages: DataFrame, tree: str = "tree") -> DataFrame:
    """Every node of every page as a row, with the page's other columns."""
    return pages.select(*(c for c in pages.columns if c != tree), F.explode(tree).alias("node")).select("*", "node.*").drop("node")


#: A node's type in Arrow, characters that are parsed and nodes that are handed over at once.
_NODES = pa.list_(pa.struct([("at", pa.int32()), ("parent", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]))
PIECE, BATCH = 1 << 18, 1 << 15


def parts(pages: DataFrame, tags: Sequence[str], html: str = "html", piece: int = PIECE) -> DataFrame:
    """A row for each element of ``tags`` in ``pages``, with the page's other columns: its place ``at`` among
    the page's nodes, and ``tree``, which is the element alone. Memory follows the largest element that is
    asked for, not the page."""
    rest = [f for f in pages.schema.fields if f.name != html]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, trees, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                own = [batch.column(j).take(pa.array(rows, pa.int64())) for j in range(1, batch.num_columns)]
                return pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int32()), pa.array(trees, _NODES)], names=[*batch.schema.names[1:], "at", "tree"])

            for i in range(batch.num_rows):
                page = batch.column(0)[i].as_py()
                for at, tree in _Parts(tags).parts(page, piece) if page is not None else ():
                    rows.append(i), places.append(at), trees.append([n | {"attrs": list(n["attrs"].items())} for n in tree])
                    held += len(tree)
                    if held >= BATCH:
                        yield made()
                        rows, places, trees, held = [], [], [], 0
            if rows:
                yield made()

    out = T.StructType([*rest, T.StructField("at", T.IntegerType()), T.StructField("tree", T.ArrayType(NODE))])
    return pages.select(html, *(f.name for f in rest)).mapInArrow(cut, out)


def showing(shown: DataFrame, named: DataFrame, page: Sequence[str]) -> DataFrame:
    """``shown(*page, at, text, ..)`` with the ``named(*page, wanted)`` whose ``wanted``, an array of names, all
    stand in the text, in any case. The longest name is looked up among the pieces of the text that have the
    length of any of the page's names, so a page's names are never tried one by one."""
    low = named.withColumn("_names", F.transform("wanted", lambda n: F.lower(n)))
    low = low.withColumn("_key", F.element_at(F.array_sort(F.transform("_names", lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))), -1)["n"]).where("_key IS NOT NULL")
    sizes = low.select(*page, F.length("_key").alias("_size")).distinct()
    text = shown.withColumn("_text", F.lower("text"))
    spots = lambda size: F.sequence(F.lit(1), F.greatest(F.length("_text") - size + 1, F.lit(1)))
    pieces = text.join(sizes, [*page]).where(F.length("_text") >= F.col("_size"))
    pieces = pieces.withColumn("_key", F.explode(F.array_distinct(F.transform(spots(F.col("_size")), lambda i: F.substring(F.col("_text"), i, F.col("_size"))))))
    found = pieces.join(low.hint("merge"), [*page, "_key"]).where(F.forall("_names", lambda n: F.contains(F.col("_text"), n)))
    return found.drop("_key", "_size", "_text", "_names")


# Text


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def below(tree: Column, node: Column) -> Column:
    """A node's descendants."""
    return F.slice(tree, node["at"] + 2, node["end"] - node["at"] - 1)


def text(tree: Column, node: Column) -> Column:
    """All texts in a node, joined as they are."""
    return F.array_join(F.transform(F.filter(below(tree, node), lambda n: n["tag"] == "#text"), lambda n: n["text"]), "")


def clean_text(tree: Column, node: Column) -> Column:
    """All texts in a node, each without blanks at its ends, joined without any between them."""
    return F.array_join(F.transform(F.filter(below(tree, node), lambda n: n["tag"] == "#text"), lambda n: stripped(n["text"])), "")


def own_text(tree: Column, node: Column) -> Column:
    """The text that is a node's only descendant, however deep; null if there are others."""
    chain = below(tree, node)
    single = F.forall(chain, lambda n: n["parent"] == n["at"] - 1) & (F.size(chain) > 0)
    last = F.try_element_at(chain, F.lit(-1))
    return F.when(single & (last["tag"] == "#text"), last["text"])


def tagged(tree: Column, tags: Sequence[str]) -> Column:
    return F.filter(tree, lambda n: n["tag"].isin(*tags))


def following(tree: Column, node: Column, until: Sequence[str] = HEADINGS) -> Column:
    """The elements behind a node with the same parent, up to the next one that is ``until``."""
    after = F.filter(F.slice(tree, node["end"] + 1, F.greatest(F.size(tree) - node["end"], F.lit(0))), lambda n: n["parent"].eqNullSafe(node["parent"]) & (n["tag"] != "#text"))
    stop = F.array_min(F.transform(F.filter(after, lambda n: n["tag"].isin(*until)), lambda n: n["at"]))
    return F.filter(after, lambda n: stop.isNull() | (n["at"] < stop))


# Questions


def links(tree: Column) -> Column:
    """array of struct(at, href, text) of the links that lead somewhere."""
    anchors = F.filter(tree, lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull())
    return F.transform(anchors, lambda n: F.struct(n["at"].alias("at"), n["attrs"]["href"].alias("href"), clean_text(tree, n).alias("text")))


def link_to(tree: Column, name: Column, path: str) -> Column:
    """Where the first link leads whose text contains a name, in any case, and whose target a path."""
    fits = F.filter(links(tree), lambda x: F.contains(F.lower(x["text"]), F.lower(name)) & F.contains(x["href"], F.lit(path)))
    return F.get(fits, F.lit(0))["href"]


def absolute(href: Column, base: str) -> Column:
    """A target as an address: relative ones are joined to the site's."""
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(base), href))


def sections(tree: Column, keywords: Sequence[str], most: int = 2000) -> Column:
    """What follows the headings that contain one of ``keywords``, each up to the next heading, then the
    page's description; blanks collapsed, at most ``most`` characters, null for nothing."""
    headings = F.filter(tagged(tree, HEADINGS), lambda n: clean_text(tree, n).rlike("(?i)" + "|".join(keywords)))
    parts = F.flatten(F.transform(headings, lambda h: F.transform(following(tree, h), lambda n: clean_text(tree, n))))
    meta = F.get(F.filter(tree, lambda n: (n["tag"] == "meta") & (n["attrs"]["name"] == "description")), F.lit(0))["attrs"]["content"]
    every = F.filter(F.concat(parts, F.array(F.coalesce(meta, F.lit("")))), lambda t: t != "")
    return F.nullif(F.left(stripped(F.regexp_replace(F.array_join(every, " "), r"(?U)\s+", " ")), F.lit(most)), F.lit(""))


def _mailto(tree: Column, domain: str, blocked: Sequence[str]) -> Column:
    """The addresses that links write to, in order."""
    targets = F.filter(F.transform(F.filter(tree, lambda n: n["tag"] == "a"), lambda n: n["attrs"]["href"]), lambda h: F.startswith(h, F.lit("mailto:")))
    mails = F.transform(targets, lambda h: F.lower(stripped(F.substring_index(F.replace(h, F.lit("mailto:"), F.lit("")), "?", 1))))
    return F.filter(mails, lambda m: F.contains(m, F.lit(domain)) & ~_is(m, blocked))


def _is(x: Column, values: Sequence[str]) -> Column:
    return x.isin(*values) if values else F.lit(False)


def _pattern(domain: str) -> str:
    return r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]*" + domain.replace(".", r"\.")


def _shown(tree: Column, elements: Column, domain: str, blocked: Sequence[str]) -> Column:
    """The first address in the text of each of some elements."""
    found = F.transform(elements, lambda n: F.lower(F.regexp_extract(text(tree, n), _pattern(domain), 0)))
    return F.filter(found, lambda m: (m != "") & ~_is(m, blocked))


def content(tree: Column) -> Column:
    """The nodes of a page's main part, with its own first: ``main``, else what is called content, main or
    profile by id, else by class, else the whole page."""
    called = lambda a: F.get(F.filter(tree, lambda n: F.coalesce(n["attrs"][a].rlike("(?i)content|main|profile"), F.lit(False))), F.lit(0))
    top = F.coalesce(F.get(tagged(tree, ["main"]), F.lit(0)), called("id"), called("class"), F.get(tree, F.lit(0)))
    return F.slice(tree, top["at"] + 1, top["end"] - top["at"])


def address(tree: Column, domain: str, blocked: Sequence[str] = ()) -> Column:
    """A person's address on their page: one that a link in the main part writes to, else one that any
    link does, else one that is shown where contact or e-mail is said; never from anywhere else, as
    footers hold other people's."""
    main = content(tree)
    inner = F.slice(main, 2, F.greatest(F.size(main) - 1, F.lit(0)))
    said = F.filter(tagged(inner, CONTACT_TAGS), lambda n: F.coalesce(own_text(tree, n).rlike("(?i)email|contact|e-mail"), F.lit(False)))
    headings = F.filter(tagged(inner, CONTACT_HEADINGS), lambda n: clean_text(tree, n).rlike("(?i)contact|email"))
    beside = F.flatten(F.transform(headings, lambda h: following(tree, h)))
    every = F.concat(_mailto(main, domain, blocked), _mailto(tree, domain, blocked), _shown(tree, F.concat(said, beside), domain, blocked))
    return F.get(every, F.lit(0))


def any_address(tree: Column, domain: str, blocked: Sequence[str] = (), generic: Sequence[str] = ()) -> Column:
    """The first address that a link writes to (percent-decoded), else that the text shows, of those that
    aren't a department's."""
    targets = F.filter(F.transform(F.filter(tree, lambda n: n["tag"] == "a"), lambda n: n["attrs"]["href"]), lambda h: F.startswith(h, F.lit("mailto:")))
    plain = lambda h: F.coalesce(F.try_url_decode(F.replace(F.replace(h, F.lit("mailto:"), F.lit("")), F.lit("+"), F.lit("%2B"))), h)
    mails = F.filter(F.transform(targets, lambda h: F.lower(stripped(F.substring_index(plain(h), "?", 1)))), lambda m: F.contains(m, F.lit(domain)))
    shown = F.transform(F.regexp_extract_all(text(tree, F.get(tree, F.lit(0))), F.lit(f"({_pattern(domain)})"), F.lit(1)), lambda m: F.lower(m))
    return F.get(F.filter(F.concat(mails, shown), lambda m: ~_is(m, blocked) & ~_is(F.substring_index(m, "@", 1), generic)), F.lit(0))


def _entry_mail(tree: Column, n: Column, domain: str, blocked: Sequence[str]) -> Column:
    return F.get(F.concat(_mailto(below(tree, n), domain, blocked), _shown(tree, F.array(n), domain, blocked)), F.lit(0))


def entry_address(tree: Column, first: Column, last: Column, domain: str, blocked: Sequence[str] = ()) -> Column:
    """A person's address in a directory: of the first entry that shows both names and has one, by a link
    or in its text."""
    of = lambda n: _entry_mail(tree, n, domain, blocked)
    named = F.filter(tagged(tree, ENTRY_TAGS), lambda n: F.contains(F.lower(clean_text(tree, n)), F.lower(first)) & F.contains(F.lower(clean_text(tree, n)), F.lower(last)))
    return F.get(F.filter(F.transform(named, of), lambda m: m.isNotNull()), F.lit(0))


def entry_addresses(people: DataFrame, pages: DataFrame, page: Sequence[str], domain: str, blocked: Sequence[str] = ()) -> DataFrame:
    """:func:`entry_address` of all ``people(*page, first, last, ..)`` in the directories ``pages(*page, html)``
    that they are looked up in: ``people`` with ``email``, null where there is none."""
    tree = F.col("tree")
    entries = parts(pages, ENTRY_TAGS).select(*page, "at", clean_text(tree, F.get(tree, F.lit(0))).alias("text"), _entry_mail(tree, F.get(tree, F.lit(0)), domain, blocked).alias("email"))
    wanted = F.array("first", "last")
    named = people.select(*page, wanted.alias("wanted")).where("first IS NOT NULL AND last IS NOT NULL").distinct()
    found = showing(entries.where("email IS NOT NULL"), named, page).groupBy(*page, "wanted").agg(F.min_by("email", "at").alias("email"))
    return people.withColumn("wanted", wanted).join(found.hint("merge"), [*page, "wanted"], "left").drop("wanted")


def profile(tree: Column, keywords: Sequence[str], domain: str, blocked: Sequence[str] = ()) -> Column:
    """struct(research, email) of a profile page, null if it has neither."""
    research, email = sections(tree, keywords), address(tree, domain, blocked)
    return F.when(research.isNotNull() | email.isNotNull(), F.struct(research.alias("research"), email.alias("email")))


def followed(searches: DataFrame, pages: DataFrame, path: str, base: str) -> DataFrame:
    """``searches(person, name, tree)`` with the page that the first fitting link of each leads to, of the
    captured ``pages(url, tree)``: person, url and that page's tree. One hop, as an equi-join."""
    leads = searches.select("person", absolute(link_to(F.col("tree"), F.col("name"), path), base).alias("url")).where("url IS NOT NULL")
    return leads.join(pages.select("url", "tree"), "url")


def followed_from(people: DataFrame, searches: DataFrame, pages: DataFrame, page: Sequence[str], path: str, base: str) -> DataFrame:
    """:func:`followed` where many people are found by one search: ``people(*page, person, name)``,
    ``searches(*page, html)`` and the captured ``pages(url, html)``, to be parsed once they are found."""
    tree = F.col("tree")
    top = F.get(tree, F.lit(0))
    links = parts(searches, ["a"]).select(*page, "at", top["attrs"]["href"].alias("href"), clean_text(tree, top).alias("text")).where(F.contains("href", F.lit(path)))
    named = people.select(*page, F.array("name").alias("wanted")).where("name IS NOT NULL").distinct()
    first = showing(links, named, page).groupBy(*page, "wanted").agg(F.min_by("href", "at").alias("href"))
    leads = people.withColumn("wanted", F.array("name")).join(first.hint("merge"), [*page, "wanted"]).select("person", absolute(F.col("href"), base).alias("url"))
    return leads.join(pages.hint("merge"), "url")


def cards(tree: Column, path: str) -> Column:
    """array of struct(name, title, href) of a search's result cards: elements with a class whose first link
    leads to ``path``, the title being what is called one by its class."""
    boxes = F.filter(tagged(tree, CARD_TAGS), lambda n: n["attrs"]["class"].isNotNull())
    return F.filter(F.transform(boxes, lambda n: _card(tree, n, path)), lambda c: c.isNotNull())


def _card(tree: Column, n: Column, path: str) -> Column:
    inside = below(tree, n)
    link = F.get(F.filter(inside, lambda x: x["tag"].isin("a", "h3", "h4") & x["attrs"]["href"].isNotNull()), F.lit(0))
    title = F.get(F.filter(inside, lambda x: x["tag"].isin("span", "p") & F.coalesce(x["attrs"]["class"].rlike("(?i)title"), F.lit(False))), F.lit(0))
    return F.when(F.contains(link["attrs"]["href"], F.lit(path)), F.struct(clean_text(tree, link).alias("name"), F.coalesce(clean_text(tree, title), F.lit("")).alias("title"), link["attrs"]["href"].alias("href")))


def card_rows(pages: DataFrame, path: str) -> DataFrame:
    """:func:`cards` of ``pages(html, ..)`` as rows: the page's other columns, ``at`` and the card ``c``."""
    tree = F.col("tree")
    boxes = parts(pages, CARD_TAGS).where(F.get(tree, F.lit(0))["attrs"]["class"].isNotNull())
    return boxes.withColumn("c", _card(tree, F.get(tree, F.lit(0)), path)).drop("tree").where("c IS NOT NULL")


def listed_texts(tree: Column, tags: Sequence[str] = ("p", "li", "div")) -> Column:
    """The texts of the elements that may each be an entry of a listing."""
    return F.filter(F.transform(tagged(tree, tags), lambda n: clean_text(tree, n)), lambda t: t != "")
