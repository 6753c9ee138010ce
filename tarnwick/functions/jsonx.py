"""JSON out of replies that are not quite JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DECODER = json.JSONDecoder()

#: Keys under which a reply's list may stand, in the order in which they are tried.
LIST_KEYS = ("matches", "results", "faculty_matches", "ranked_matches")


def _decoded(text: str, at: int = 0) -> tuple[bool, object, int]:
    """Whether a value begins at ``at`` (behind blanks), the value, and where it ends."""
    while at < len(text) and text[at] in " \t\r\n":
        at += 1
    try:
        value, end = _DECODER.raw_decode(text, at)
    except (ValueError, RecursionError):
        return False, None, at
    return True, value, end


def _elements(text: str, at: int) -> list:
    """The elements of an array that begins at ``at``, as far as they are whole."""
    found = []
    going, value, at = _decoded(text, at + 1)
    while going:
        found.append(value)
        rest = text[at:].lstrip()[:1]
        if rest != ",":
            break
        going, value, at = _decoded(text, text.index(",", at) + 1)
    return found


def _embedded(text: str) -> tuple[bool, object]:
    """The first value in brackets within other text. Of an array that is cut off the whole elements
    count; a lone object in an array stands for itself."""
    for bracket in re.finditer(r"[\[{]", text):
        at = bracket.start()
        if text[at] == "{":
            whole, value, _ = _decoded(text, at)
            if whole:
                return True, value
            continue
        items = _elements(text, at)
        if len(items) == 1 and isinstance(items[0], dict):
            return True, items[0]
        if items or _decoded(text, at)[0]:
            return True, items
    return False, None


def recover(text: str | None) -> str | None:
    """The JSON in a reply, written anew: all of it, a fenced block of it, or a value within it; None if
    there is none."""
    text = text or ""
    for part in (text, *(block.removeprefix("json") for block in text.split("```")[1::2])):
        whole, value, end = _decoded(part)
        if whole and not part[end:].strip():
            return json.dumps(value, ensure_ascii=False)
    whole, value = _embedded(text)
    return json.dumps(value, ensure_ascii=False) if whole else None


@F.pandas_udf(StringType())
def recovered(texts: pd.Series) -> pd.Series:
    return texts.map(recover)


def list_of(reply: Column, keys: tuple[str, ...] = LIST_KEYS) -> Column:
    """The JSON array in a reply that is one, or that is an object with one under one of ``keys``, or
    else under any key (the first in the object's order)."""
    whole = F.startswith(F.ltrim(reply), F.lit("["))
    under = F.from_json(reply, "map<string,string>")
    # a text that looks like a list is none
    lists = F.map_filter(F.from_json(reply, "map<string,variant>"), lambda _, v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY")))
    first = F.get(F.filter(F.array(*(F.lit(k) for k in keys)), lambda k: F.map_contains_key(lists, k)), F.lit(0))
    return F.when(whole, F.trim(reply)).otherwise(F.try_element_at(under, F.coalesce(first, F.get(F.map_keys(lists), F.lit(0)))))
