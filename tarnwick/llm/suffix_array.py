"""Ranks of suffixes by a difference cover, to a bounded depth."""

from __future__ import annotations

import numpy as np


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Numbers from 1 in the order of the tuples that ``columns`` hold, equal for equal tuples."""
    bits = [max(1, int(c.max()).bit_length()) if len(c) else 1 for c in columns]
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:], strict=True):
            key = (key << b) | c
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.ones(len(order), bool)
        new[1:] = False
        for c in columns:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def ranks(text: np.ndarray, depth: int, span: int = 1) -> np.ndarray:
    """For each position of ``text`` (positive numbers, each standing for ``span`` characters) a
    number that orders the suffixes by their first ``depth`` characters at least. Equal numbers have
    equal prefixes of that length; different numbers may too.

    Positions i with i mod 3 in (1, 2) are the sample. Its triples are sorted and named; where names
    repeat and don't reach the depth yet, the string of names is ranked in turn. The remaining
    suffixes are a character before a ranked one and are merged by that.
    """
    n = len(text)
    t = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    one, two, zero = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names, distinct = _names([t[sample], t[sample + 1], t[sample + 2]])
    if distinct < len(sample) and 3 * span < depth:
        inner = ranks(np.concatenate([names[: len(one)], [0], names[len(one) :]]) + 1, depth, 3 * span)
        names = np.concatenate([inner[: len(one)], inner[len(one) + 1 :]]) + 1
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    top = int(names.max(initial=0)) + 1

    after_one = lambda i: t[i] * top + rank[i + 1]
    zeros_by_one = after_one(zero)
    pairs = lambda i: t[i] * (int(t.max(initial=0)) + 1) + t[i + 1]
    pair_names, _ = _names([np.concatenate([pairs(zero), pairs(two)])])
    zeros_by_two = pair_names[: len(zero)] * top + rank[zero + 2]
    by_two = pair_names[len(zero) :] * top + rank[two + 2]

    less = lambda among, x: np.searchsorted(np.sort(among), x, "left")
    out = np.zeros(n + 4, np.int64)
    out[zero] = less(zeros_by_one, zeros_by_one) + less(after_one(one), zeros_by_one) + less(by_two, zeros_by_two)
    out[one] = less(names, rank[one]) + less(zeros_by_one, after_one(one))
    out[two] = less(names, rank[two]) + less(zeros_by_two, by_two)
    return out[:n]


def repeated_prefixes(text: np.ndarray, candidates: np.ndarray, order: np.ndarray, length: int, block: int = 1 << 13) -> np.ndarray:
    """Of the positions ``candidates`` (each with ``length`` characters left) those whose next
    ``length`` characters also follow a candidate of a lower ``order``."""
    if not len(candidates):
        return candidates
    rank = ranks(text, length)[candidates]
    by = np.lexsort((order, rank))
    at = candidates[by]
    same = np.zeros(len(at), bool)
    step = np.arange(length)
    for a in range(1, len(at), block):
        b = min(a + block, len(at))
        same[a:b] = (text[at[a:b, None] + step] == text[at[a - 1 : b - 1, None] + step]).all(axis=1)
    group = np.cumsum(~same)
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, order[by])
    return at[order[by] > least[group]]
