"""Ranked search, source divergence and source mixing against brute force, with the awkward rows."""

import bisect
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import curriculum, divergence, lexical, queries, terms

SCHEMA = "doc_id long, text string, lang string, source string"
ITEMS = "item_id long, text string"


def prose(n, seed, vocabulary=40):
    draw = random.Random(seed)
    words = ["".join(random.Random(k).choice("abcdeéñß1") for _ in range(1 + k % 5)) for k in range(vocabulary)]
    return draw.choice([" ", ", ", "_"]).join(draw.choice([w, w.title(), w.upper()]) if draw.random() < 0.3 else w for w in (words[min(int(draw.expovariate(0.15)), vocabulary - 1)] for _ in range(n)))


ROWS = [(i, prose(random.Random(i).randint(1, 60), i), ["en", "de", None, ""][i % 4], [None, "", "s1", "S2", "é", "s10"][i % 6]) for i in range(90)]
ROWS += [(200, None, "en", "only null"), (201, "", "fr", "a"), (202, "...  42", "fr", "b"), (203, "x y", "zz", "alone"), (5, ROWS[5][1], "en", "s1"), (5, "other text é", "en", None), (None, ROWS[7][1], None, None), (None, "é é é", None, None)]
ROWS += [(300, prose(20_000, 300, 400), "en", "long")] + [(400 + i, ROWS[3][1], "en", "copies") for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    # names that the operators use inside
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("tier", "shard", "term", "item", "rank", "block", "size", "digest", "key", "slice", "number", "level", "value")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Terms


def test_terms_are_those_of_the_pattern():
    texts = [t for _, t, _, _ in ROWS] + ["a", "", "é", "aé1-Z", "\x7f\x80 x", "A" * 70_000]
    for member, pattern in ((terms.LETTERS_AND_DIGITS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (terms.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        column = pa.array(texts, pa.string()).slice(1)
        got = terms.terms_of(column, member)
        names = terms.strings(got.names).to_pylist()
        assert names == sorted(set(names), key=str.encode)
        want = [(i, t, n) for i, text in enumerate(texts[1:]) for t, n in sorted(Counter(re.findall(pattern, fold(text))).items(), key=lambda x: x[0].encode())]
        assert [(i, names[t], n) for i, t, n in zip(got.text.tolist(), got.term.tolist(), got.count.tolist(), strict=True)] == want
        assert terms.count_terms(column, member).tolist() == [len(re.findall(pattern, t or "")) for t in texts[1:]]


# Search


def ranked(rows, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
    counts = [(i, Counter(split(t))) for i, t, *_ in rows]
    n_docs, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(split(text)), []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // length if length else 25
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, prose(6 + i, 1000 + i)) for i in range(25)] + [(None, "é ñ"), (3, "aa aa bb"), (50, None), (51, ""), (52, "nowhere-to-be-found"), (53, prose(400, 5000, 400))]
    return rows, spark.createDataFrame(rows, ITEMS).withColumns({"term": F.lit(0), "rank": F.lit(0)})


@pytest.mark.parametrize(("cuts", "rows", "block", "sent"), [((16, 256), 8192, 256, 1 << 25), ((1, 2), 7, 12, 0), ((2, 4, 8), 40, 9, 1 << 25)])
def test_search_is_exact(docs, items, monkeypatch, cuts, rows, block, sent):
    """With tiers so short that most items fall through, shards of a few rows, several blocks, no broadcast."""
    for name, value in (("CUTS", cuts), ("SHARD_ROWS", rows), ("ITEMS", block), ("BROADCAST_BYTES", sent)):
        monkeypatch.setattr(lexical, name, value)
    got = lexical.search(lexical.build(docs), items[1])
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(ranked(ROWS, items[0]), key=order)


def test_search_of_nothing(spark, docs, empty, items):
    assert lexical.search(lexical.build(empty), items[1]).count() == 0
    assert lexical.search(lexical.build(docs), spark.createDataFrame([], ITEMS)).count() == 0
    assert lexical.search(lexical.build(docs.where("text IS NULL")), items[1]).count() == 0
    few = lexical.search(lexical.build(docs), items[1], k=3)
    assert few.agg(F.max("rank")).first()[0] == 3


def test_an_index_serves_several_searches(docs, items):
    index = lexical.build(docs)
    one, two = lexical.search(index, items[1]), lexical.search(index, items[1].where("item_id = 3"))
    assert one.where("item_id = 3").exceptAll(two).count() == 0 and two.count() == 20


def test_postings_hold_every_term_and_its_bounds(docs, monkeypatch):
    monkeypatch.setattr(lexical, "CUTS", (1, 3))
    rows = lexical.build(docs).postings.where(F.col("term") != lexical.IDS).collect()
    lists = defaultdict(dict)
    for r in rows:
        lists[r.shard, r.term][r.tier] = (np.frombuffer(r.impacts, np.int32), r.rest, r.df)
    for tiers in lists.values():
        assert sum(len(x) for x, _, _ in tiers.values()) == next(iter(tiers.values()))[2]
        for t, (x, rest, _) in tiers.items():
            after = tiers[t + 1][0] if t + 1 in tiers else [0]
            assert len(x) == (1, 2, None)[t] or t + 1 not in tiers
            assert rest == max(after) <= min(x) and list(x) == sorted(x, reverse=True)


# Divergence


def diverging(rows):
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
    out = []
    for lang in {r[2] or "" for r in rows}:
        mine = [(r[3] or "", Counter(split(r[1]))) for r in rows if (r[2] or "") == lang]
        df = Counter(t for _, c in mine for t in c)
        kept = [t for t, n in df.items() if n >= 3]
        count = {s: Counter() for s, _ in mine}
        for s, c in mine:
            count[s].update(c)
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + (10**9 * (c[t] + 1)) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s]
            listed = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, values in (("pair", sorted(pairs)), ("term", sorted(listed)[:200])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(values, 1)]
    return sorted(out)


@pytest.mark.parametrize(("blocks", "cells", "gathered"), [(1 << 23, 1 << 21, 1 << 24), (300, 20, 500)])
def test_divergence(docs, monkeypatch, blocks, cells, gathered):
    """Whole blocks, and small ones whose matrices are made piece by piece."""
    for name, value in (("BLOCK_BYTES", blocks), ("CELLS", cells), ("GATHERED", gathered)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == diverging(ROWS)


def test_divergence_lists_200_terms(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    all_ = [a + b for a in letters for b in letters]
    rows = [(i, " ".join(random.Random(i).choices(all_, k=900)), "en", f"s{i % 2}") for i in range(8)]
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == diverging(rows)
    assert got.where("part = 'term'").groupBy("source").count().collect()[0]["count"] == 200


def test_divergence_of_nothing(spark, empty):
    assert divergence.divergence(empty).count() == 0
    bare = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", "b"), (3, "x", "en", None)], SCHEMA)
    assert sorted(map(tuple, divergence.divergence(bare).collect())) == diverging([tuple(r) for r in bare.collect()])


def test_shares_are_exact_beyond_64_bits():
    draw = np.random.default_rng(1)
    count = draw.integers(0, 1 << 52, 5000)
    total = count + 1 + draw.integers(0, 1 << 40, 5000)
    want = [1 + (10**9 * (int(c) + 1)) // int(t) for c, t in zip(count, total, strict=True)]
    assert divergence.shares(count, total).tolist() == want


# The mix


def levels(sizes):
    """Shares by weight of 1.5 times everything, the excess over twice a source's size shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("slices", [None, 1, 60])
def test_mix(docs, monkeypatch, slices):
    if slices:
        monkeypatch.setattr(curriculum, "slice_count", lambda rows: slices)
    got = curriculum.mix(docs).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in ROWS:
        sizes[s] += n(t)
    target = levels(sizes)
    assert Counter((r.doc_id, r.source, r.size, r.source_size) for r in got) == Counter((i, s, n(t), sizes[s]) for i, t, _, s in ROWS)
    for s in sizes:
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r.digest, r.doc_id or 0))
        assert all(r.target == pytest.approx(target[s]) for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(target[s], abs=1)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        left, want = math.floor(mine[0].target), Counter()
        for k in range(2):
            for i, r in enumerate(mine):
                got_now = min(r.size, left)
                want[i] += got_now
                left -= got_now
        assert [r.taken for r in mine] == [want[i] for i in range(len(mine))]
    assert sorted(map(str, got)) == sorted(map(str, curriculum.mix(docs.repartition(3)).collect()))


def test_positions_invert_the_integrated_schedule(docs):
    """A copy lies where the integral of its source's weight, summed in small steps, reaches its first word."""
    got = curriculum.mix(docs).collect()
    names = sorted({r.source for r in got}, key=lambda s: (s is None, (s or "").encode()))
    steps = 20_000
    for s in names:
        knots = curriculum.SCHEDULES[names.index(s) % 3]
        weight = np.interp((np.arange(steps) + 0.5) / steps, np.linspace(0, 1, len(knots)), knots)
        demand = np.concatenate([[0], np.cumsum(weight)]) / weight.sum()
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r.digest, r.doc_id or 0))
        total, at = math.floor(mine[0].target), 0
        for k in range(2):
            for r in mine:
                if k < len(r.copies):
                    assert r.copies[k].position == pytest.approx(bisect.bisect_left(demand, at / total) / steps, abs=2e-4)
                at += r.size
    order = curriculum.training_order(curriculum.mix(docs)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert sum(r.words for r in order) == sum(r.taken for r in got)


@pytest.mark.parametrize("knots", [(1.0, 1.0), (0.5, 1.5), (0.0, 2.0), (2.0, 0.0), (1.0, 0.0, 3.0, 0.0, 1.0)])
def test_inverse_of_odd_schedules(spark, knots):
    done = [0.0, 1e-9, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    rows = spark.createDataFrame([(x, list(knots)) for x in done], "done double, knots array<double>")
    times = [r[0] for r in rows.select(curriculum.inverse(F.col("done"), F.col("knots"))).collect()]
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
    demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    demand /= demand[-1]
    assert times == sorted(times)
    assert np.interp(times, grid, demand) == pytest.approx(done, abs=1e-6)


def test_mix_of_nothing(spark, empty):
    assert curriculum.mixed_by_position(empty).count() == 0
    rows = curriculum.mixed_by_position(spark.createDataFrame([(1, None, "en", "a"), (None, "", "en", None)], SCHEMA)).collect()
    assert [(r.size, r.source_size, r.target, r.taken, r.position) for r in rows] == [(0, 0, 0.0, 0, None)] * 2


def test_mix_plan_is_native(spark, docs):
    text = curriculum.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)


def test_the_queries_are_registered():
    assert {"op11_lexical_search", "op12_source_divergence", "op13_source_mix"} <= set(queries.queries())
