"""Operators on whole texts against brute force, with the awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import fingerprint, langid, license_scan, lm_score, near_dup, packing, pieces, quality, secrets, suffix_array, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("aeioundrst") for _ in range(draw.randint(2, 8))) for _ in range(n))


BASE = words(120, 1)
TEXTS = {
    1: BASE,
    2: BASE,
    3: BASE.replace(" ", "  ", 1) + " tail",
    4: None,
    5: "",
    6: "x",
    7: words(60, 2) + "\n" + BASE[100:400] + "\n" + words(30, 3),
    8: "Ünïcödé — " + words(50, 4) + "\nsame line\nsame line\n",
    9: "Password = 'hunter2/abc' and AKIA" + "A1B2" * 5 + " hex " + "0a1b" * 8 + " token: abc key aB3$" + "Zx9Qw8Er7Ty6Ui5Op4As3Df2",
    10: "word " * 80,
    11: "a" * 500,
    12: words(3000, 5),
    13: "Copyright 2020 X\nReleased under the MIT Licence!",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in TEXTS.items()]
    rows += [(1, BASE, "en", "s", len(BASE)), (None, BASE, None, None, None)]
    # names that operators use inside
    return spark.createDataFrame(rows, SCHEMA).withColumns({"range": F.lit(1), "route": F.lit("x"), "score": F.lit(0), "kept": F.lit(False), "salt": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_suffix_ranks_order_suffixes():
    for seed in range(60):
        draw = np.random.default_rng(seed)
        text = draw.integers(1, 3 if seed % 2 else 200, int(draw.integers(1, 90)))
        rank = suffix_array.ranks(text, 1000)
        order = sorted(range(len(text)), key=lambda i: tuple(text[i:]))
        assert list(np.argsort(rank, kind="stable")) == order


@pytest.mark.parametrize(("hot", "each"), [(64, 1 << 20), (1, 300)])
def test_suffix_dedup(spark, docs, empty, monkeypatch, hot, each):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = by_id(suffix_dedup.dedup(docs, bytes_per_route=each))
    seen = set()
    for i, text in sorted(TEXTS.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()), i
    assert suffix_dedup.dedup(empty).count() == 0
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert by_id(kept)[4].text is None and by_id(kept)[2].text == ""


def test_near_duplicates(spark, docs, empty):
    got = by_id(near_dup.near_duplicates(docs, 3, 85))
    sets = {}
    for i, text in TEXTS.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    for i in TEXTS:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), least[i], least[i] == i), i
    assert near_dup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("side", [1 << 16, 900])
def test_near_duplicate_chain_and_big_group(spark, monkeypatch, side):
    """A chain of which only neighbours are linked, and a group of many near copies; whole buckets and
    split ones."""
    monkeypatch.setattr(near_dup, "SIDE", side)
    base = words(400, 9).split()
    chain = []
    for i in range(8):
        w = list(base)
        for k in range(i * 12):
            w[k] = f"q{k}"
        chain.append((i, " ".join(w)))
    group = [(100 + i, words(200, 10) + f" end{i}") for i in range(400)]
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(chain + group, "doc_id long, text string"), 3, 85))
    assert {got[i].component_id for i in range(8)} == {0} and {got[100 + i].component_id for i in range(400)} == {100}


def test_near_duplicates_with_unlike_signatures(spark):
    """Pairs of similarity 35/41 whose signatures agree in less than 0.72 of their places (found by a
    search over seeds; other hash functions need other seeds)."""
    rows = []
    for k, seed in enumerate((9314, 20686, 45772)):
        w = words(40, seed).split()
        pair = [" ".join(w), " ".join([*w[:20], "zz", *w[21:]])]
        raw = [t.encode() for t in pair]
        sig = near_dup.signatures(*near_dup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 3))
        assert (sig[0] == sig[1]).mean() < 0.72
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert [got[i].component_id for i in range(6)] == [0, 0, 2, 2, 4, 4]


def test_set_index_counts_what_sets_share():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    for limit in (1, 50, 1 << 20):
        for own in sets:
            assert near_dup.SetIndex(sets).shared(own, limit).tolist() == [len(np.intersect1d(own, x)) for x in sets]


def test_packing(spark, docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    for i, text in TEXTS.items():
        n = len(lib.encode(text or "", add_special_tokens=False).ids) + 1
        mine = sorted(r.piece for r in rows if r.doc_id == i)
        assert sum(r.length for r in rows if r.doc_id == i) == n * (2 if i == 1 else 1) and set(mine) == set(range(len(packing.cut(n))))
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    special = "x <|endoftext|> y"
    assert np.frombuffer(packing.tokenizer(path).encode(special), "<u4").tolist() == lib.encode(special, add_special_tokens=False).ids
    assert packing.pack(empty, path).count() == 0


def test_packing_plans_are_gapless_and_reductions_optimal():
    for seed in range(200):
        draw = np.random.default_rng(seed)
        capacity = int(draw.integers(5, 60))
        counts = np.zeros(capacity + 1, np.int64)
        for x in draw.integers(1, capacity + 1, int(draw.integers(0, 12 if seed < 60 else 80))):
            counts[x] += 1
        slots = packing.plan(counts, capacity)
        left, bins = counts.copy(), {}
        for k, (key, first, offset) in enumerate(zip(slots["key"], slots["sequence"], slots["offset"], strict=True)):
            length = int(key >> 44)
            end = slots["key"][k + 1] if k + 1 < len(slots["key"]) and slots["key"][k + 1] >> 44 == length else (length << 44) + counts[length]
            left[length] -= end - key
            for m in range(end - key):
                bins.setdefault(first + m, []).append((offset, length))
        assert not left.any()
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_secrets(spark, docs, empty):
    got = by_id(secrets.secret_spans(docs))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, text in TEXTS.items():
        t = text or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), i
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    assert (got[9].n_assign, got[9].n_access, got[9].n_hex, got[9].n_entropy) == (1, 1, 1, 1)
    assert got[12].n_entropy == 0
    clean = by_id(secrets.redact(docs))[9]
    assert clean.text.count("[REDACTED]") == 4 and "hunter2" not in clean.text and clean.n_chars == len(clean.text)
    assert secrets.redact(docs).columns == docs.columns and secrets.secret_spans(empty).count() == 0


def test_window_entropy(spark):
    from math import log2

    for run in ("aB3xYz9QwErTyUiOp1234567", "aaaaaaaaaaaaaaaaaaaaaaaaab", "a1" * 15):
        best = max(-sum(c / 20 * log2(c / 20) for c in Counter(run[k : k + 20]).values()) for k in range(len(run) - 19))
        assert spark.range(1).select(secrets.window_entropy(F.lit(run)).alias("h")).first().h == pytest.approx(best)


@pytest.mark.parametrize(("unit", "each"), [(1 << 21, 4 << 20), (50, 300)])
def test_lm_scores(spark, docs, empty, monkeypatch, unit, each):
    from math import log

    monkeypatch.setattr(lm_score, "UNIT", unit)
    got = lm_score.lm_scores(docs, bytes_per_block=each).collect()
    texts = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()]
    grams = lambda w: Counter(tuple(w[j - k + 1 : j + 1]) for k in (1, 2, 3) for j in range(k - 1, len(w)))
    total = sum((grams(w) for _, w in texts), Counter())
    tokens = sum(len(w) for _, w in texts)
    want = []
    for i, w in texts:
        own = grams(w)
        count = lambda g: total[g] - own[g]  # noqa: B023, E731
        score = whole = 0.0
        for j in range(len(w)):
            s = log(max(count((w[j],)), 0.5) / max(tokens - len(w), 1))
            c = log(total[(w[j],)] / tokens)
            for k in (2, 3):
                if j >= k - 1:
                    g = tuple(w[j - k + 1 : j + 1])
                    s = log(count(g) / count(g[:-1])) if count(g) > 0 else s + log(0.4)
                    c = log(total[g] / total[g[:-1]])
            score += s
            whole += c
        want.append((i, len(w), score, whole) if w else (i, 0, None, None))
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, x in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (r.doc_id, r.n_words) == x[:2]
        assert (r.log_score, r.mean_log_score, r.corpus_log_score) == ((None, None, None) if x[2] is None else pytest.approx((x[2], x[2] / x[1], x[3]))), r.doc_id
    assert lm_score.lm_scores(empty).count() == 0


def test_fingerprints(spark, docs, empty):
    units = lambda t: Counter(x for x in re.split(r"\n|(?<=[.!?])\x20+", t) if x)
    likeness = lambda a, b: 1.0 if not a | b else (a & b).total() / (a | b).total()
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = by_id(fingerprint.fingerprints(some))
    order = sorted(TEXTS, reverse=True)
    for k, i in enumerate(order):
        text, nxt = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + nxt[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(units(text), units(edited))) and r.near_next == pytest.approx(likeness(units(text), units(nxt)))
    assert got[1].fingerprint == got[2].fingerprint and got[4].fingerprint == got[5].fingerprint == ""
    assert fingerprint.fingerprints(docs).count() == docs.count() and fingerprint.fingerprints(empty).count() == 0
    led = fingerprint.with_next_text(some, bytes_each=1).orderBy(F.col("doc_id").desc()).collect()
    assert [r.next_text for r in led] == [TEXTS[i] or "" for i in order[1:] + order[:1]]


def test_fingerprints_of_long_texts_and_many_repeats(spark):
    """A text above a megabyte, one paragraph a thousand times, repeated rows and rows without doc_id."""
    long = "\n".join(words(12, k) for k in range(20000))
    rows = [(3, long), (2, "same.\n" * 1000 + "other"), (1, "same.\n" * 500), (1, "same.\n" * 500), (None, "same."), (None, None)]
    assert len(long) > 1 << 20
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy(F.col("doc_id").desc_nulls_last(), "n_chars").collect()
    assert [r.doc_id for r in got] == [3, 2, 1, 1, None, None] and [r.n_chars for r in got] == [len(long), 6005, 3000, 3000, 0, 5]
    assert got[1].near_next == pytest.approx(500 / 1001) and got[2].fingerprint == got[3].fingerprint
    assert 0.6 < got[0].near_edited < 0.7 and got[0].near_next == 0


def test_larger_sketches_recover_what_small_ones_cannot(spark):
    text = "\n".join(words(3, 100 + k) for k in range(300))
    other = "\n".join(words(3, 500 + k) for k in range(300))
    rows = spark.createDataFrame([(2, text + "\n" + other), (1, text)], "doc_id long, text string")
    got = by_id(fingerprint.fingerprints(rows))
    assert got[2].near_next == pytest.approx(0.5)


def test_paragraphs_end_at_every_sentence_in_any_script(spark):
    texts = {
        "Zwei hier. Zum anderen! Und? Vier.": 4,
        "lower case. goes on. and on.": 3,
        'She said "no." Then left.\r\nNext (one.) Last': 4,
        "Это раз. Это два! Три?": 3,
        "Ένα εδώ. Δύο; Τρία.": 3,
        "第一句。第二句！「第三句？」第四句": 4,
        "पहला वाक्य। दूसरा वाक्य।": 2,
        "جملة أولى. هل ثانية؟ ثالثة": 3,
        "3.14 and a.b stay": 1,
    }
    rows = spark.createDataFrame(list(texts.items()), "text string, n int")
    got = {r.text: r.k for r in rows.select("text", F.size(fingerprint.digests(F.col("text"))).alias("k")).collect()}
    assert got == texts
    draw = random.Random(6)
    plain = ["".join(draw.choice("ab.!?;,\"')]} \t\n\r\x0b") for _ in range(60)) for _ in range(400)]
    ends = spark.createDataFrame([(t,) for t in plain], "t string").select(F.split("t", fingerprint.ASCII_END, -1).alias("a"), F.split("t", f"{fingerprint.SPACED_END}|{fingerprint.BARE_END}", -1).alias("b")).collect()
    assert all(r.a == r.b for r in ends)
    edited = spark.createDataFrame([(2, "Это раз. Это два. Это три. Это шесть."), (1, "Иное.")], "doc_id long, text string")
    assert by_id(fingerprint.fingerprints(edited))[2].near_edited > 0


def test_pieces(spark, docs, empty):
    import public_tokenizers as P
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(pieces.piece_digests(docs, path))
    for i, text in TEXTS.items():
        ids = lib.encode(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()
    own = pieces.encoder(path)
    for text in ("", " ", "a  b", "a▁b", "日本 語", "\x00a", "tail ", "🎉"):
        spans = own.encode(text)
        assert [(s[1], s[2]) for s in spans] == [(max(p.begin, 0), p.end) for p in lib.encode(text, return_type="proto").pieces]
        assert [s[0] for s in spans] == lib.encode(text)
        assert all(a[2] == b[1] for a, b in zip(spans, spans[1:], strict=False)) and (not spans or (spans[0][1], spans[-1][2]) == (0, len(text.encode())))
    assert pieces.encode_spans(docs, path).count() == docs.count() and pieces.piece_digests(empty, path).count() == 0


def test_character_map_takes_the_longest_key():
    """A trie with the keys "a" -> "x" and "ab" -> "y", built by hand."""
    units = [0] * 1024
    units[0] = 0 << 10
    step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    units[0] = 256 << 10
    a = 256 ^ 97
    units[a] = 97 | (512 << 10) | 256
    leaf = a ^ step(units[a])
    units[leaf] = 0x80000000
    b = leaf ^ 98
    units[b] = 98 | (64 << 10) | 256
    units[b ^ step(units[b])] = 0x80000000 | 2
    import struct

    table = pieces.CharacterMap(struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"x\0y\0")
    size, value = table.longest(np.frombuffer(b"abacazb", np.uint8), np.arange(7))
    assert size.tolist() == [2, 0, 1, 0, 1, 0, 0] and value[[0, 2, 4]].tolist() == [2, 0, 0] and table.lengths(value[[0, 2]]).tolist() == [1, 1]
    own = pieces.Normaliser(b"")
    own.map, own.squeeze = table, False
    normal, source = own.align("ab a é")
    assert normal.decode() == "▁y▁x▁é" and source.tolist() == [0, 0, 0, 0, 2, 2, 2, 3, 4, 4, 4, 5, 5, 7]
    own.squeeze = True
    normal, source = own.align("  ab  a ")
    assert normal.decode() == "▁y▁x" and source.tolist() == [2, 2, 2, 2, 4, 4, 4, 6, 7]
    assert own.align("  ")[0] == own.align("")[0] == b""


def test_language_id(spark, empty):
    de = ["der die das und nicht schön über straße", "ich gehe nach hause und schlafe", "wir sind heute sehr müde und zufrieden"]
    en = ["the quick brown fox and the lazy dog", "they went home and then they slept", "we are very tired but happy today"]
    rows = [(i, (de if i % 2 else en)[i % 3] + f" {'und' if i % 2 else 'and'} " + (de if i % 2 else en)[i % 2], "de" if i % 2 else "en") for i in range(200)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !!", None), (None, en[0], "en")]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    named = {r.doc_id: r for r in got}
    assert all(named[i].lang_pred == ("de" if i % 2 else "en") and 0 <= named[i].score <= 1 for i in range(200))
    assert all(named[i].lang_pred == "und" and named[i].score == 0 for i in (1000, 1001, 1002)) and named[None].lang_pred == "en"
    assert langid.language_id(empty).count() == 0
    unlabelled = langid.language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert unlabelled.lang_pred == "und"


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 1, 0), (10, 0, 0), (10, 1, 0), (99, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_rules(docs, labels))
    for i, text in TEXTS.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(windows)
        marked = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(3)}
        seen, repeated = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), repeated, len(marked))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r.base_failed and r.kept)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(docs, none).count() == docs.count() and quality.quality_rules(empty, none).count() == 0


def test_forest_finds_the_odd_one():
    x = np.concatenate([np.random.default_rng(1).normal(size=(500, 3)), [[9, 9, 9]]])
    assert quality.IsolationForest(x).score(x).argmax() == 500


def test_licenses(spark, docs, empty):
    got = by_id(license_scan.license_scan(docs))
    assert got[13].license == "MIT" and got[13].notices == "MIT" and got[1].license is None
    assert got[4].digest == hashlib.sha256(b"").hexdigest() == got[5].digest
    text = license_scan.KNOWN[0][1].upper().replace(" ", "\n  ").replace("SUBLICENSE", "sub-licence") + "\n(c) 2001 Someone"
    assert license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().license == "MIT"
    assert license_scan.license_scan(empty).count() == 0


def test_licenses_of_the_common_list(spark):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "Released under the Unlicense": "Unlicense",
        " ".join(license_scan.KNOWN[2][1].split()): "0BSD",
    }
    rows = [(i, f"some text\n{line}\nmore") for i, line in enumerate(lines)] + [(10, "BSD 3-Clause License\n\nCopyright (c) 2020, X\n" + license_scan._bsd(["1.", "2.", "3."]))]
    assert "licen" not in list(lines)[3].lower() and "rights" not in list(lines)[3].lower()
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].notices for i in range(4)] == list(lines.values()) and got[10].license == "BSD-3-Clause"
    names = {r.license for r in license_scan.known_digests(spark).collect()}
    assert {"Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "CC0-1.0"} <= names and len({d for _, d in license_scan.DIGESTS}) == len(license_scan.DIGESTS)


def test_few_random_keys_of_any_class_are_missed(spark):
    import string

    draw = random.Random(8)
    classes = {"hex": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits, "alphanumeric": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
    rows = [(name, "".join(draw.choice(letters) for _ in range(n))) for name, letters in classes.items() for n in (20, 24, 32) for _ in range(200)]
    found = spark.createDataFrame(rows, "name string, run string").groupBy("name", F.length("run").alias("n")).agg(F.avg(secrets._is_random(F.col("run")).cast("int")).alias("share")).collect()
    assert len(found) == 15 and all(r.share >= 0.96 for r in found), found


def thue_morse(n: int) -> tuple[str, str]:
    """A word of n letters and its complement: their polynomials are equal modulo 2**64 at any odd base."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_unequal_texts_with_equal_polynomials_stay_apart(spark):
    one, two = thue_morse(2048)
    rows = spark.createDataFrame([(1, one), (2, two), (3, f"{one}\n{two}\n{'x y ' * 60}")], "doc_id long, text string")
    linked = by_id(near_dup.near_duplicates(rows, 3, 85))
    assert (linked[1].component_id, linked[2].component_id) == (1, 2)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counted = {r.doc_id: r for r in quality.rule_statistics(rows).collect()}
    assert (counted[3].n_dup_lines, counted[3].n_distinct) == (0, 4) and quality.quality_rules(rows, none).count() == 3
    scored = by_id(lm_score.lm_scores(rows.where("doc_id < 3")))
    assert scored[1].log_score == pytest.approx(np.log(0.5)) == scored[2].log_score
    gone = by_id(suffix_dedup.dedup(rows))
    # brute force over the three texts
    seen, want = set(), {}
    for r in rows.orderBy("doc_id").collect():
        mask = [False] * len(r.text)
        for k in range(len(r.text) - 99):
            w = r.text[k : k + 100]
            if w in seen:
                mask[k : k + 100] = [True] * 100
            seen.add(w)
        want[r.doc_id] = sum(mask)
    assert {i: gone[i].n_removed for i in gone} == want


def test_packing_reduction_keeps_an_optimum(spark):
    """Some optimal packing has all sets that the reduction fixes."""

    def fewest(items: list[int], capacity: int) -> int:
        best = {0: (0, 0)}  # of each set of items: sequences and room in the last
        for chosen in range(1, 1 << len(items)):
            found = []
            for i, x in enumerate(items):
                if chosen >> i & 1:
                    n, room = best[chosen & ~(1 << i)]
                    found.append((n, room - x) if x <= room else (n + 1, capacity - x))
            best[chosen] = min(found, key=lambda f: (f[0], -f[1]))
        return best[(1 << len(items)) - 1][0]

    for seed in range(250):
        draw = np.random.default_rng(seed)
        capacity = int(draw.integers(5, 40))
        items = draw.integers(1, capacity + 1, int(draw.integers(1, 9)))
        counts = np.bincount(np.minimum(items, capacity // 2 + 2) if seed % 3 == 0 else items, minlength=capacity + 1)
        listed = lambda c: [k for k in range(len(c)) for _ in range(c[k])]
        left = counts.copy()
        fixed = packing.reduce_by_dominance(left, capacity)
        assert sum(n for n, _ in fixed) + fewest(listed(left), capacity) == fewest(listed(counts), capacity), (capacity, listed(counts), fixed)


def test_packed_tokens_and_offsets(spark, docs):
    """CRC, start and place of every piece against the library, and no fewer sequences than needed."""
    import zlib

    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for i, text in texts:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 2048 or 2048
        starts = [0, *range(head, len(ids), 2048)]
        for k, a in enumerate(starts):
            part = ids[a : head if k == 0 else a + 2048]
            want[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 2048)


def test_secret_entropy_by_brute_force(spark):
    """Entropy spans, with base spans and allow-listed parts inside runs, and ties of touching spans."""
    from math import log2

    draw = random.Random(12)
    key = lambda n: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    texts = [f"AKIA{'B3C4' * 4}/{key(40)}", f"path/example/{key(30)}", "sample0123456789" + key(22), f"é🎉 {key(24)}\n{key(19)} {key(20)}", "word " * 50 + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "password=" + key(30), "x" * 8 + key(25), "", None, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A2B3" * 10, "9" * 40]
    texts += [" ".join(draw.choice([key(draw.randint(10, 60)), "example", "token=abc123", "plain"]) + draw.choice(["", "/sample/", "-"]) for _ in range(30)) for _ in range(20)]
    got = by_id(secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    any_found = 0
    for i, text in enumerate(texts):
        t = text or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        blank = list(t)
        for a, _, b in base:
            blank[a:b] = " " * (b - a)
        blank = "".join(blank)
        for pattern, n in secrets.ALLOWED.items():
            blank = re.sub(pattern, " " * n, blank)
        spans = list(base)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", blank):
            run = m[0]
            name = next((name for name, p in secrets.CLASSES.items() if re.search(p, run)), "base64")
            kinds = sum(bool(re.search(p, run)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
            best = max(-sum(c / 20 * log2(c / 20) for c in Counter(run[k : k + 20]).values()) for k in range(len(run) - 19))
            if (kinds >= 2 or name == "base32") and best >= secrets.LIMITS[name]:
                spans.append((m.start(), 3, m.end()))
                any_found += 1
        assert got[i].spans == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), i
    assert any_found > 100 and got[0].spans == "access:0:20,entropy:20:61" and got[1].n_entropy == 1


def test_secrets_of_very_long_runs_and_many_spans(spark):
    import time

    draw = random.Random(3)
    run = "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    many = "password=secret12 " * 60000
    rows = spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string")
    began = time.time()
    got = by_id(secrets.secret_spans(rows))
    clean = by_id(secrets.redact(rows))
    assert got[1].spans == f"entropy:0:{1 << 20}" and got[2].n_assign == 60000 and time.time() - began < 120
    assert clean[1].text == "[REDACTED]" and clean[2].text == "[REDACTED] " * 60000


def test_redaction_across_chunks_and_overlaps(spark):
    from tarnwick.llm import native

    draw = random.Random(4)
    rows = []
    for i in range(40):
        n = draw.randint(0, 14000)
        text = "".join(draw.choice("abé🎉 \n") for _ in range(n))
        spans = sorted((a, 0, min(n, a + draw.randint(1, 5000 if i % 7 == 0 else 40))) for a in (draw.randrange(n) for _ in range(draw.randint(0, 200) if n else 0)))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,kind:int,end:int>>")
    got = {r.i: r.cut for r in df.select("i", native.replaced(F.col("text"), F.col("spans"), lambda s, at: F.when(s["start"] >= at, F.lit("#")).otherwise("")).alias("cut")).collect()}
    for i, text, spans in rows:
        at, out = 0, ""
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + "#"
            at = max(at, b)
        assert got[i] == out + text[at:], i


def test_repeats_keep_other_columns_as_they_are(spark):
    import datetime
    import decimal

    rows = [(i, words(40, 5 if i < 3 else 6), datetime.datetime(2024, 1, 2, 3, 4, 5, 123456), decimal.Decimal("1.23"), [1, None], {"a": None}, b"\0\xff", None) for i in range(4)] + [(None, None, None, None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at timestamp, d decimal(9,2), route array<int>, kind map<string,string>, body binary, head int")
    got = suffix_dedup.remove_repeats(df)
    assert got.schema == df.schema
    assert sorted(map(str, got.drop("text").collect())) == sorted(map(str, df.drop("text").collect()))
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[0] == rows[0][1] and kept[1] == "" and kept[3] == rows[3][1] and kept[None] is None


def test_language_codewords_stay_apart():
    for classes in (1, 2, 4, 65, 300):
        code = langid.codewords(classes)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 99 * np.eye(classes)
        assert code.shape[0] == classes and apart.min() >= (3 if classes > 64 else 6)


def test_every_document_shapes_the_forest(spark):
    """Of 20,000 documents that are alike but one, the one that comes last by its hash, and trees of as many rows as there are."""
    places = spark.range(20000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("place"))
    last = places.orderBy(F.col("place").desc(), F.col("id").desc()).first().id
    odd = F.when(F.col("id") == last, F.lit(" ".join(f"#{k}$ AB{k}" for k in range(30)))).otherwise("")
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit(words(60, 1)), odd).alias("text"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r.anomaly for r in quality.quality_rules(docs, labels).collect()}
    assert len({a for i, a in got.items() if i != last}) == 1 and got[last] > max(a for i, a in got.items() if i != last)

    counted = spark.range(700).select(F.col("id").alias("doc_id"), *((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(90)) + 60).alias(c) for k, c in enumerate(quality.COUNTS)))
    forest, again = quality.grown(counted), quality.grown(counted.repartition(7))
    assert np.array_equal(forest.column, again.column) and np.array_equal(forest.cut, again.cut) and np.array_equal(forest.path, again.path)
    rows = counted.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(64))).collect()
    x = quality.ratios({c: np.array([r[c] for r in rows]) for c in quality.COUNTS})
    assert forest.deal == 24
    for t in range(0, 64, 9):
        mine = x[[(t - r.place) % 64 < 24 for r in rows]]
        stack = [(0, 0, mine)]
        while stack:
            node, level, part = stack.pop()
            k, cut = forest.column[t, node], forest.cut[t, node]
            if k < 0:
                assert level == 8 or len(part) == 1
                assert forest.path[t, node] == level + quality.usual_path(len(part))
            else:
                assert part[:, k].min() <= cut < part[:, k].max()
                stack += [(2 * node + 1, level + 1, part[part[:, k] <= cut]), (2 * node + 2, level + 1, part[part[:, k] > cut])]


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_threshold_of_all_labelled_rows(spark, ranges):
    """25,000 scores, many of them equal, by all cuts; the last ones alone have the bad ones."""
    draw = np.random.default_rng(4)
    good = draw.random(25000) < 0.9
    score = np.round(np.where(good, 0.4, 0.5) + draw.normal(size=25000) / 20, 4)
    scored = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good, strict=True)], "anomaly double, good boolean")
    got = quality.calibrate(scored, 0.05, ranges=ranges)
    cuts = np.unique(score)
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1e-6)
    kept = [np.searchsorted(np.sort(s), cuts) / len(s) for s in (score[good], score[~good])]
    assert got == cuts[np.where(kept[0] >= 0.95, kept[0] - kept[1], -1).argmax()]
    assert quality.calibrate(scored.where("good")) == 0.6 and quality.calibrate(scored.where("false")) == 0.6


def test_letters_rows_and_samples_of_languages(spark):
    """Digits of other kinds are no letters; repeated rows and many languages leave the model whole."""
    rows = [(i, f"lang{i % 70} " + words(20, 1000 + i % 70), f"l{i % 70:02d}") for i in range(700)]
    rows += [(5, "lang5 " + words(20, 1005), "l05")] * 50 + [(9000 + i, t, None) for i, t in enumerate(["² ½ ① 12", "Ⅷ ㊿", "ß", "语"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in langid.language_id(df, sample_rows=60).collect()]
    named = {r.doc_id: r.lang_pred for r in got}
    assert named[9000] == named[9001] == "und" and named[9002] != "und" and named[9003] != "und"
    model = langid.fit(df, sample_rows=60)
    again = langid.fit(df.repartition(7), sample_rows=60)
    assert len(model.languages) == 70 and np.array_equal(model.weights, again.weights)
    known = [r for r in got if r.doc_id < 700]
    assert sum(r.lang_pred == f"l{r.doc_id % 70:02d}" for r in known) / len(known) > 0.9


def test_verdict_by_brute_force(spark):
    """The forest's and the threshold's verdict on every row, recomputed in plain loops."""
    rows = [(i, (words(80, i) if i % 9 else " ".join(f"#{k}$%" for k in range(60))) + "\n" + words(5, i)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    got = by_id(quality.quality_rules(df, labels))
    counted = {r.doc_id: r for r in quality.rule_statistics(df).collect()}
    order = sorted(counted)
    x = quality.ratios({c: np.array([counted[i][c] for i in order]) for c in quality.COUNTS})
    assert all(not got[i].base_failed for i in order)
    best = None
    anomaly = np.array([got[i].anomaly for i in order])
    marked = [(anomaly[k], i % 9 != 0) for k, i in enumerate(order) if i % 2 == 0]
    for cut in sorted({a for a, _ in marked}):
        lost = sum(a >= cut for a, good in marked if good) / sum(good for _, good in marked)
        caught = sum(a >= cut for a, good in marked if not good) / sum(not good for _, good in marked)
        if lost <= 0.05 and (best is None or caught - lost > best[0] + 1e-12):
            best = (caught - lost, cut)
    below = max((a for a, _ in marked if a < best[1]), default=best[1])
    for k, i in enumerate(order):
        if not below < anomaly[k] < best[1]:
            assert got[i].kept == (anomaly[k] < best[1]), i
    assert best[0] > 0.5 and x.shape == (120, 6)


def test_rows_without_doc_id(spark, docs):
    """Every operator returns them, with what its docstring says."""
    import public_tokenizers as P

    none = lambda df: [r for r in df.collect() if r.doc_id is None]
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    data = BASE.encode()
    (a,) = none(suffix_dedup.dedup(docs))
    assert (a.n_bytes, a.n_removed, a.kept_sha256) == (len(data), 0, hashlib.sha256(data).hexdigest())
    (b,) = none(near_dup.near_duplicates(docs, 3, 85))
    assert b.component_id is None and b.kept and b.n_shingles == 118
    assert [r.piece for r in none(packing.pack(docs, P.path("byte_bpe_50k.json")))] == [0]
    assert len(none(secrets.secret_spans(docs))) == len(none(lm_score.lm_scores(docs))) == len(none(license_scan.license_scan(docs))) == 1
    (c,) = none(fingerprint.fingerprints(docs))
    assert c.n_chars == len(BASE)
    (d,) = none(pieces.piece_digests(docs, P.path("piece_bpe_32k.model")))
    assert d.n_tokens > 100
    (e,) = none(quality.quality_rules(docs, marks))
    assert e.n_words == 120
    (f,) = none(langid.language_id(docs))
    assert not f.held_out


def test_texts_above_a_megabyte(spark):
    """Against brute force, with a second copy of a part far behind."""
    long = words(260_000, 77)
    other = words(50, 78) + " " + long[900_000:900_400] + " " + words(50, 79)
    rows = spark.createDataFrame([(1, long), (2, other), (3, long + " end")], "doc_id long, text string")
    assert len(long) > 1 << 20
    gone = by_id(suffix_dedup.dedup(rows))
    assert gone[1].n_removed == 0 and gone[2].n_removed >= 400 and gone[2].n_spans == 1 and gone[3].n_removed >= len(long)
    linked = by_id(near_dup.near_duplicates(rows, 3, 85))
    w = long.split()
    assert {i: linked[i].component_id for i in linked} == {1: 1, 2: 2, 3: 1} and linked[1].n_shingles == len({tuple(w[k : k + 3]) for k in range(len(w) - 2)})
    counted = {r.doc_id: r for r in quality.rule_statistics(rows).collect()}
    assert counted[1].n_words == 260_000 and counted[1].n_distinct == len(set(w))
    scored = by_id(lm_score.lm_scores(rows))
    assert scored[1].n_words == 260_000 and scored[1].log_score < 0
    assert by_id(secrets.secret_spans(rows))[1].spans == ""
    assert by_id(langid.language_id(rows.withColumn("lang", F.lit("x"))))[1].lang_pred == "x"


def test_ties_take_the_first(spark):
    """Equal texts of two languages, and components of equal size."""
    rows = [(i, "ab cd ef gh", "b" if i % 2 else "a") for i in range(40)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len({r.lang_pred for r in got}) == 1 and all(r.ambiguous for r in got)
    pairs = [(i, words(60, 900 + i // 2)) for i in range(12)]
    near = by_id(near_dup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 3, 85))
    assert [near[i].component_id for i in range(12)] == [i - i % 2 for i in range(12)]
