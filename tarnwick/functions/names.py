"""Names of people: parsing, spelling variants, compatibility and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import email_local, letters_only


def parse_name(x: Column) -> Column:
    """struct(first, last): "Last, First Middle" gives First and Last; without a comma the first word
    and the rest."""
    t = F.trim(F.coalesce(x, F.lit("")))
    halves = F.split(t, ",", 2)
    words = F.split(t, r"\s+")
    word = lambda s: F.coalesce(F.get(F.split(F.trim(s), r"\s+"), F.lit(0)), F.lit(""))
    comma = F.contains(t, F.lit(","))
    first = F.when(comma, word(F.get(halves, F.lit(1)))).otherwise(F.get(words, F.lit(0)))
    last = F.when(comma, F.trim(F.get(halves, F.lit(0)))).otherwise(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " "))
    return F.struct(first.alias("first"), last.alias("last"))


def author_key(first: Column, last: Column) -> Column:
    return F.concat(letters_only(last), F.lit("|"), letters_only(first))


def compatible(of: Column, ol: Column, tf: Column, tl: Column) -> Column:
    """Whether two names given as letters only may be one person's: last names equal or one within
    the other, first names with a common beginning of three letters; never with a part empty."""
    some = (of != "") & (ol != "") & (tf != "") & (tl != "")
    last = (ol == tl) | F.contains(tl, ol) | F.contains(ol, tl)
    first = F.startswith(tf, F.left(of, F.lit(3))) | F.startswith(of, F.left(tf, F.lit(3)))
    return F.coalesce(some & last & first, F.lit(False))


def whole_compatible(of: Column, ol: Column, tf: Column, tl: Column) -> Column:
    """As :func:`compatible`, but one whole first name begins the other."""
    some = (of != "") & (ol != "") & (tf != "") & (tl != "")
    last = F.contains(tl, ol) | F.contains(ol, tl)
    return F.coalesce(some & last & (F.startswith(tf, of) | F.startswith(of, tf)), F.lit(False))


def similarity(first: Column, last: Column, their_first: Column, their_last: Column) -> Column:
    """Between 0 and 1: six tenths for the last name (0.8 of it where one contains the other), four
    tenths for the first (graded by how much of the beginning agrees)."""
    return letters_similarity(*(letters_only(x) for x in (first, last, their_first, their_last)))


def letters_similarity(of: Column, ol: Column, tf: Column, tl: Column) -> Column:
    """:func:`similarity` of names given as letters only. Every grade is a constant, so a pair costs comparisons."""
    some = (of != "") & (ol != "") & (tf != "") & (tl != "")

    def graded(by_last: float) -> Column:
        grade = lambda by_first: F.round(F.lit(by_last) * 0.6 + F.lit(by_first) * 0.4, 3)
        return F.when(of == tf, grade(1.0)).when(F.startswith(tf, of) | F.startswith(of, tf), grade(0.85)).when(F.left(tf, F.lit(3)) == F.left(of, F.lit(3)), grade(0.6)).when(F.left(tf, F.lit(1)) == F.left(of, F.lit(1)), grade(0.3)).otherwise(F.lit(0.0))

    return F.when(some & (ol == tl), graded(1.0)).when(some & (F.contains(tl, ol) | F.contains(ol, tl)), graded(0.8)).otherwise(F.lit(0.0))


def variants(first: Column, last: Column) -> Column:
    """Other spellings to query an index with, in order and each once, as structs: the first given
    name, its initial, and compound last names joined, their last and their first part."""
    f, n = F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))
    given = F.get(F.split(f, r"[-\s]+"), F.lit(0))
    parts = F.filter(F.split(n, r"[-\s]+"), lambda p: p != "")
    pair = lambda a, b: F.struct(F.trim(a).alias("first"), F.trim(b).alias("last"))
    many = F.size(parts) > 1
    nothing = pair(F.lit(""), F.lit(""))
    when = lambda c, p: F.when(c, p).otherwise(nothing)
    every = F.array(
        when(F.size(F.split(f, r"[-\s]+")) > 1, pair(given, n)),
        pair(F.left(given, F.lit(1)), n),
        when(many, pair(f, F.array_join(parts, ""))),
        when(many, pair(f, F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))),
        when(many, pair(f, F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))),
    )
    return F.array_distinct(F.filter(every, lambda v: (v["first"] != "") & (v["last"] != "") & ~((v["first"] == f) & (v["last"] == n))))


def stable_key(department: Column, orcid: Column, email: Column, first: Column, last: Column, default: str = "general") -> Column:
    """A person's key: by ORCID, else by address, else by name."""
    from .text import slug

    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    rest = F.coalesce(F.concat(F.lit("orcid:"), some(orcid)), F.concat(F.lit("email:"), F.lower(some(email))), F.concat(F.lit("name:"), slug(last), F.lit("|"), slug(first)))
    return F.concat(F.coalesce(some(department), F.lit(default)), F.lit(":"), rest)


def email_candidates(first: Column, last: Column, domain: str) -> Column:
    """Likely addresses, in order and each once; none where a name has no letters."""
    f, n = letters_only(first), letters_only(last)
    i = F.left(f, F.lit(1))
    local = F.array(F.concat(i, n), F.concat(f, F.lit("."), n), F.concat(f, n), F.concat(f, F.left(n, F.lit(1))), F.concat(n, i), n)
    made = F.array_distinct(F.transform(local, lambda x: F.concat(x, F.lit("@" + domain))))
    return F.when((f != "") & (n != ""), made).otherwise(F.array().cast("array<string>"))


#: Local parts of addresses that many people share.
GENERIC = ("info", "support", "admin", "admissions", "help", "contact", "office", "dept", "department", "registrar", "webmaster", "grants", "communications", "events")


def plausible_email(address: Column, first: Column, last: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Whether an address may be a person's own: no generic one, and its local part (without dots and
    hyphens) has the first three letters of either name in it, or is up to three letters before digits
    with the first name's initial anywhere in it."""
    raw = email_local(address)
    local = F.regexp_replace(raw, "[.-]", "")
    f, n = (F.lower(F.coalesce(x, F.lit(""))) for x in (first, last))
    has = lambda x: (F.length(x) >= 3) & F.contains(local, F.left(x, F.lit(3)))
    initial = (f != "") & F.contains(local, F.left(f, F.lit(1)))
    return ~raw.isin(*generic) & (has(f) | has(n) | (initial & local.rlike(r"^[a-z]{1,3}\d")))
