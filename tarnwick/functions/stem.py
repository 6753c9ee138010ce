"""Index terms as full-text engines make them: diacritics off, then Porter's stem.

Both are expressions of Spark, so they stay in generated code; callers apply them to the distinct
vocabulary and join it back, which costs one evaluation per word rather than per occurrence. What Porter
calls the measure of a stem, its number of turns from vowels to consonants, is tested by patterns.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Porter's (1980) suffix rules of steps 2, 3 and 4.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Runs of consonants and of vowels: y is a consonant at the begin (where it is written Y) and behind a vowel.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^({_C})?[aeiouy]"
ABOVE_0 = f"^({_C})?{_V}{_C}"
IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
ABOVE_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"


def split_suffix(ends: list[str]) -> str:
    """A pattern for a word's stem and the longest of ``ends`` behind it."""
    return f"^(.*?)({'|'.join(ends)})$"


def _steps(word: str):
    """Porter's steps for one word, for the few words of a query: a stem after each."""
    w = "Y" + word[1:] if word.startswith("y") else word
    has = lambda pattern, x: re.match(pattern, x) is not None

    w = re.sub("^(.*)(ss|i)es$", r"\1\2", w) if w.endswith(("sses", "ies")) else re.sub("^(.*[^s])s$", r"\1", w)
    yield w
    if w.endswith("eed"):
        w = w[:-1] if has(ABOVE_0, w[:-3]) else w
    elif m := re.match("^(.*)(ed|ing)$", w):
        if has(HAS_VOWEL, m[1]):
            w = m[1]
            if w.endswith(("at", "bl", "iz")) or (has(IS_1, w) and has(SHORT_END, w)):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
                w = w[:-1]
    if w.endswith("y") and has(HAS_VOWEL, w[:-1]):
        w = w[:-1] + "i"
    yield w
    for rules in (STEP_2, STEP_3):
        if (m := re.match(split_suffix([end for end, _ in rules]), w)) and has(ABOVE_0, m[1]):
            w = m[1] + dict(rules)[m[2]]
        yield w
    if (m := re.match(split_suffix(STEP_4), w)) and has(ABOVE_1, m[1]) and (m[2] != "ion" or m[1].endswith(("s", "t"))):
        w = m[1]
    yield w
    if w.endswith("e") and (has(ABOVE_1, w[:-1]) or (has(IS_1, w[:-1]) and not has(SHORT_END, w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and has(ABOVE_1, w[:-1]):
        w = w[:-1]
    yield w.lower()


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    return word if len(word) < 3 else list(_steps(word))[-1]


def unaccented(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """The letters that decompose into another one and marks, and those others."""
    marked = {chr(c): unaccented(chr(c)) for c in range(0xC0, 0x2000)}
    pairs = {a: b for a, b in marked.items() if len(b) == 1 and a != b}
    return "".join(pairs), "".join(pairs.values())


def plain(x: Column) -> Column:
    """Text without diacritics."""
    return F.regexp_replace(F.translate(x, *_plain_letters()), r"\p{Mn}", "")


def stem(word: Column) -> Column:
    """Porter's stem of a word, in lower case and without diacritics."""
    word = plain(F.lower(word))
    w = F.when(F.startswith(word, F.lit("y")), F.concat(F.lit("Y"), F.substring(word, 2, 1 << 30))).otherwise(word)
    cut = lambda x, n: F.left(x, F.length(x) - n)

    def ends(x: Column, *last: str) -> Column:
        out = F.endswith(x, F.lit(last[0]))
        for end in last[1:]:
            out = out | F.endswith(x, F.lit(end))
        return out

    def then(x: Column, step) -> Column:
        """``step`` of a value that is evaluated once."""
        return F.get(F.transform(F.array(x), step), F.lit(0))

    def suffix(x: Column, of: list[str]) -> Column:
        """The longest of some suffixes that a word has, or null: comparing ends is much cheaper than a pattern."""
        out = None
        for end in sorted(of, key=len, reverse=True):
            out = F.when(F.endswith(x, F.lit(end)), end) if out is None else out.when(F.endswith(x, F.lit(end)), end)
        return out

    def plural(x: Column) -> Column:
        return F.when(ends(x, "sses", "ies"), cut(x, 2)).when(ends(x, "s") & ~ends(x, "ss") & (F.length(x) > 1), cut(x, 1)).otherwise(x)

    def mended(x: Column) -> Column:
        last = F.right(x, F.lit(1))
        twice = (F.length(x) > 1) & (last == F.substring(x, -2, 1)) & ~last.isin(*"aeiouylsz")
        return F.when(ends(x, "at", "bl", "iz"), F.concat(x, F.lit("e"))).when(twice, cut(x, 1)).when(x.rlike(SHORT_END) & x.rlike(IS_1), F.concat(x, F.lit("e"))).otherwise(x)

    def past(x: Column) -> Column:
        tried = lambda n: F.when(cut(x, n).rlike(HAS_VOWEL), then(cut(x, n), mended)).otherwise(x)
        return F.when(ends(x, "eed"), F.when(cut(x, 3).rlike(ABOVE_0), cut(x, 1)).otherwise(x)).when(ends(x, "ed"), tried(2)).when(ends(x, "ing"), tried(3)).otherwise(x)

    def last_y(x: Column) -> Column:
        return F.when(ends(x, "y") & cut(x, 1).rlike(HAS_VOWEL), F.concat(cut(x, 1), F.lit("i"))).otherwise(x)

    def turned(rules: list[tuple[str, str]]):
        new = F.create_map(*(F.lit(v) for rule in rules for v in rule))

        def step(x: Column) -> Column:
            by = lambda end: F.when(end.isNotNull() & cut(x, F.length(end)).rlike(ABOVE_0), F.concat(cut(x, F.length(end)), F.element_at(new, end))).otherwise(x)
            return then(suffix(x, [end for end, _ in rules]), by)

        return step

    def shortened(x: Column) -> Column:
        def by(end: Column) -> Column:
            rest = cut(x, F.length(end))
            return F.when(end.isNotNull() & ((end != "ion") | ends(rest, "s", "t")) & rest.rlike(ABOVE_1), rest).otherwise(x)

        return then(suffix(x, STEP_4), by)

    def last_e(x: Column) -> Column:
        before = cut(x, 1)
        return F.when(ends(x, "e") & (before.rlike(ABOVE_1) | (before.rlike(IS_1) & ~before.rlike(SHORT_END))), before).otherwise(x)

    def last_l(x: Column) -> Column:
        return F.when(ends(x, "ll") & cut(x, 1).rlike(ABOVE_1), cut(x, 1)).otherwise(x)

    for step in (plural, past, last_y, turned(STEP_2), turned(STEP_3), shortened, last_e, last_l):
        w = then(w, step)
    return F.when(F.length(word) < 3, word).otherwise(F.lower(w))


def stem_sql(word: str) -> str:
    """The same for DuckDB, as a select of raw and term from ``words(raw)``; each step is a query."""
    cut = lambda n: f"left(w, length(w) - {n})"
    has = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
    part = lambda ends, k: f"regexp_extract(w, '{split_suffix(ends)}', {k})"
    cases = lambda rules: " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules)
    suffixes = lambda rules, pattern, new, more="": f"CASE WHEN {part([a for a, _ in rules], 2)} <> '' AND {has(part([a for a, _ in rules], 1), pattern)}{more} THEN {part([a for a, _ in rules], 1)} || {new} ELSE w END"
    step_4 = [(a, "") for a in STEP_4]
    steps = [
        f"CASE WHEN {has('w', '(sses|ies)$')} THEN {cut(2)} WHEN {has('w', '[^s]s$')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {has(cut(3), ABOVE_0)} THEN {cut(1)} ELSE w END WHEN w LIKE '%ed' AND {has(cut(2), HAS_VOWEL)} THEN '+' || {cut(2)} WHEN w LIKE '%ing' AND {has(cut(3), HAS_VOWEL)} THEN '+' || {cut(3)} ELSE w END",
        f"CASE WHEN w NOT LIKE '+%' THEN w WHEN {has('w', '(at|bl|iz)$')} OR ({has('w[2:]', IS_1)} AND {has('w[2:]', SHORT_END)}) THEN w[2:] || 'e' WHEN length(w) > 2 AND w[-1] = w[-2] AND {has('w', '[^aeiouylsz]$')} THEN w[2:-2] ELSE w[2:] END",
        f"CASE WHEN w LIKE '%y' AND {has(cut(1), HAS_VOWEL)} THEN {cut(1)} || 'i' ELSE w END",
        suffixes(STEP_2, ABOVE_0, f"CASE {part([a for a, _ in STEP_2], 2)} {cases(STEP_2)} END"),
        suffixes(STEP_3, ABOVE_0, f"CASE {part([a for a, _ in STEP_3], 2)} {cases(STEP_3)} END"),
        suffixes(step_4, ABOVE_1, "''", f" AND ({part(STEP_4, 2)} <> 'ion' OR {has(part(STEP_4, 1), '(s|t)$')})"),
        f"CASE WHEN w LIKE '%e' AND ({has(cut(1), ABOVE_1)} OR ({has(cut(1), IS_1)} AND NOT {has(cut(1), SHORT_END)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {has(cut(1), ABOVE_1)} THEN {cut(1)} ELSE w END",
    ]
    inner = f"SELECT {word} AS raw, strip_accents(lower({word})) AS plain, regexp_replace(strip_accents(lower({word})), '^y', 'Y') AS w FROM words"
    for step in steps:
        inner = f"SELECT raw, plain, {step} AS w FROM ({inner})"
    return f"SELECT raw, CASE WHEN length(plain) < 3 THEN plain ELSE lower(w) END AS term FROM ({inner})"
