"""Secret scanning with DataFrame functions only.

Three plain kinds (assign, access, hex) are found by their patterns, leftmost and without overlap;
as Spark's regular expression functions return matches but no places, the text is also split at the
matches, and the lengths of both give every place in code points. A fourth kind is found by entropy:
over each run of key characters a window slides whose character counts are kept up to date by one
entering and one leaving character, and the run is a secret if the Shannon entropy of some window
reaches the threshold of the run's character class. Plain spans and the parts of known samples that
are on the allow list are blanked first, so what is left on either side of them is judged by itself.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows are scanned
alike; a very long text takes time in proportion to its length; an empty table gives an empty result.
Columns other than doc_id and text are ignored, or carried through by :func:`redact`. A run of one kind
of character alone (letters of one case, or digits) has no entropy span unless it could be base32: words
are such runs, so a key of, say, 40 random small letters is left to the base kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, placed, replaced

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20

#: Bits per character that a window must reach, by character class. Each is just below
#: the 1 % quantile of 400,000 random strings of 20 characters of the class (2.902, 3.346, 3.409,
#: 3.646 and 3.646), so about one in a hundred of the shortest keys is missed, and fewer longer ones.
LIMITS = {"hex": 2.9, "base32": 3.34, "base36": 3.4, "alphanumeric": 3.64, "base64": 3.64}
#: The classes but the last, in the order in which they are tried.
CLASSES = {"hex": r"^[0-9A-Fa-f]+$", "base32": r"^[A-Z2-7]+=*$", "base36": r"^(?:[A-Z0-9]+|[a-z0-9]+)$", "alphanumeric": r"^[A-Za-z0-9]+$"}

#: Parts of well-known samples and placeholders, and how many characters each has.
ALLOWED = {
    "(?i)example": 7,
    "(?i)sample": 6,
    "(?i)placeholder": 11,
    "(?i)x{8}": 8,
    "0123456789": 10,
    "(?i)abcdefghij": 10,
    "(?i)(?<![A-Za-z0-9+/_=-])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![A-Za-z0-9+/_=-])": 36,
}
_ANY_ALLOWED = "|".join(f"(?:{p})" for p in ALLOWED)

_SPAN = "struct<start:int,kind:int,end:int>"


def _spans(text: Column, pattern: str, kind: int, passes) -> Column:
    """Spans of the matches of ``pattern`` that ``passes(match)`` accepts."""
    # behind the last match there is one more piece, without a match
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("skip"), F.coalesce(F.length(m), F.lit(0)).alias("size"), (m.isNotNull() & passes(m)).alias("ok")))
    found = placed(steps, _SPAN, lambda start, end: F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def window_entropy(run: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits per character) of a window of ``width`` characters, whose
    counts, and the sum of c*log2(c) over them, change by one entering and one leaving character.
    The counts are the characters of a short string, so that changing one copies a few bytes."""
    weight = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    first, last, zero = 43, 122, 64  # the codes of + and z, which bound the alphabet, and of @

    def slide(codes: Column):
        def change(acc: Column, code: Column, by: int) -> Column:
            put = lambda had: F.struct((acc["sum"] + weight(had + by) - weight(had)).alias("sum"), F.overlay(acc["counts"], F.char(had + (by + zero)), code, 1).alias("counts"))
            return let(F.ascii(F.substring(acc["counts"], code, F.lit(1))) - zero, put)

        def step(acc: Column, at: Column) -> Column:
            entered = let(F.get(codes, at - 1), lambda code: change(acc, code, 1))
            moved = F.when(at > width, let(entered, lambda now: let(F.get(codes, at - (width + 1)), lambda code: change(now, code, -1)))).otherwise(entered)
            best = lambda now: F.when(at >= width, F.greatest(acc["best"], F.lit(math.log2(width)) - now["sum"] / width)).otherwise(acc["best"])
            return let(moved, lambda now: F.struct(now["sum"].alias("sum"), now["counts"].alias("counts"), best(now).alias("best")))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(chr(zero) * (last - first + 1)).alias("counts"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda acc: acc["best"])

    characters = F.filter(F.split(run, ""), lambda c: c != "")
    return let(F.transform(characters, lambda c: F.ascii(c) - (first - 1)), slide)


def _is_random(run: Column) -> Column:
    kinds = sum(run.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]"))
    limit = F.lit(LIMITS["base64"])
    for name, pattern in reversed(CLASSES.items()):
        limit = F.when(run.rlike(pattern), LIMITS[name]).otherwise(limit)
    # a base32 key of 20 characters has no digit once in sixty times
    plain = (kinds < 2) & ~run.rlike(CLASSES["base32"])
    return ~plain & (window_entropy(run) >= limit)


def _without_allowed(text: Column) -> Column:
    blank = text
    for pattern, n in ALLOWED.items():
        blank = F.regexp_replace(blank, pattern, " " * n)
    return F.when(text.rlike(_ANY_ALLOWED), blank).otherwise(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the array columns base_spans and all_spans (start, kind, end; sorted)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
            _spans(text, ACCESS, 1, lambda m: F.length(m) >= 20),
            _spans(text, HEX, 2, lambda m: F.lit(True)),
        )
    )
    found = docs.withColumn("base_spans", base)
    blank = replaced(text, F.col("base_spans"), lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], at))))
    rest = F.when(text.rlike(RUN), let(blank, _without_allowed)).otherwise("")
    found = found.withColumn("open_text", rest).withColumn("entropy_spans", _spans(F.col("open_text"), RUN, 3, _is_random))
    return found.withColumn("all_spans", F.array_sort(F.concat("base_spans", "entropy_spans"))).drop("open_text", "entropy_spans")


def _text_of(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy for every row."""
    found = find_secrets(docs.select("doc_id", "text")).select("doc_id", "base_spans", "all_spans")
    count = lambda k, spans: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k, "base_spans").alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_text_of(F.col("base_spans")), 256).alias("base_sha256"), _text_of(F.col("all_spans")).alias("spans"), count(3, "all_spans").alias("n_entropy"))


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret in text replaced by ``mark`` (overlapping ones by one) and
    n_chars, where there is such a column, set anew for the changed texts."""
    found = find_secrets(docs.select(F.struct("*").alias("row"), "text"))
    cut = replaced(F.col("text"), F.col("all_spans"), lambda s, at: F.when(s["start"] >= at, F.lit(mark)).otherwise(""))
    hit = F.size("all_spans") > 0
    found = found.withColumn("text", F.when(hit, cut).otherwise(F.col("text")))
    fresh = {"text": F.col("text"), "n_chars": F.when(hit, F.length("text")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select(*(fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col("row")[c].alias(c) for c in docs.columns))
