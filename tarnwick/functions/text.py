"""Column functions over strings. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as an address in a text.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+"


def blank(x: Column) -> Column:
    """Null and the empty string both mean that a value is missing; blanks count as a value."""
    return x.isNull() | (x == "")


def slug(x: Column) -> Column:
    """Lower case with one hyphen for every run of other characters than a-z and 0-9, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def letters_only(x: Column) -> Column:
    """Lower case without all but a-z; null becomes the empty string."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z]", "")


def title_key(x: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]", "")


def email_local(x: Column) -> Column:
    """What stands before the first @, or everything without one."""
    return F.lower(F.trim(F.substring_index(F.coalesce(x, F.lit("")), "@", 1)))


def emails(x: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Distinct addresses in order of appearance, without those whose local part is ``blocked``."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(EMAIL), F.lit(0)))
    return F.filter(found, lambda e: ~email_local(e).isin(*blocked)) if blocked else found


def shortened(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def query_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two letters and digits or more, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: F.length(t) >= 2))


def expand_keywords(terms: Column) -> Column:
    """The terms (trimmed, lower case) and their words of over three characters, each once."""
    clean = F.transform(terms, lambda t: F.lower(F.trim(t)))
    words = F.filter(F.flatten(F.transform(clean, lambda t: F.split(t, r"\s+"))), lambda w: F.length(w) > 3)
    return F.array_distinct(F.concat(clean, words))


def requirement_keywords(themes: Column, expertise: Column, qualifications: Column) -> Column:
    """What a call is searched by: its themes and areas of expertise whole and by their words, of its
    qualifications the words alone; words have more than three characters, all are lower case, each once."""
    none = F.array().cast("array<string>")
    some = lambda x: F.transform(F.coalesce(x, none), lambda t: F.lower(t))
    words = lambda xs: F.filter(F.flatten(F.transform(xs, lambda t: F.split(t, r"(?U)\s+"))), lambda w: F.length(w) > 3)
    whole = F.transform(F.concat(some(themes), some(expertise)), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    return F.array_distinct(F.concat(whole, words(whole), words(some(qualifications))))


def last_path_part(x: Column) -> Column:
    """An identifier without the address before it, in upper case."""
    return F.upper(F.element_at(F.split(F.trim(x), "/"), -1))


def fingerprint(x: Column) -> Column:
    """SHA-256 in hex of the UTF-8 bytes."""
    return F.sha2(x, 256)


def bar(share: Column, width: int = 20) -> Column:
    """A bar of ``width`` characters filled to ``share``."""
    full = F.least(F.lit(width), F.greatest(F.lit(0), F.round(share * width).cast("int")))
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one digit, ties to even, 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part * 100 / whole, 1)).otherwise(F.lit(0.0))


def split_list(x: Column) -> Column:
    """The trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.trim(t)), lambda t: F.length(t) > 0)


def url_decoded(x: Column) -> Column:
    """Percent-decoding that leaves + alone; text that can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")), x)


def titled(x: Column) -> Column:
    """Every run of letters with a capital first and the others small: what follows any other
    character, be it a hyphen, a slash or an apostrophe, begins anew."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")
