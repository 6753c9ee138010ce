"""The pipeline's stages on awkward rows, and all of it against brute force."""

import os
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnwick.llm import langid, secrets

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(letters: str, n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range(n))


def one(i: int) -> str:
    return words("aeioundrst" if i % 2 else "klmpqwxyzu", 60, i)


def table() -> list[tuple]:
    texts = {i: one(i) for i in range(40)}
    texts |= {100: texts[3], 101: texts[4] + " tail", 102: one(50) + "\n" + texts[5][50:250] + "\n" + one(52), 103: one(60) + " password = hunter2secret " + one(62), 104: "1234 !! ½", 105: "", 106: None, 107: words("aeioundrst", 5000, 70)}
    lang = lambda i: ("x" if i % 2 else "y") if i < 60 else None
    return [(i, t, lang(i), "s", None if t is None else len(t)) for i, t in texts.items()] + [(7, texts[7], "x", "s", len(texts[7])), (None, one(81), None, None, None)]


def stage(spark, docs, name):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, "")


def test_against_brute_force(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # language: the rows that the model can tell, one by one
    docs = spark.createDataFrame(rows, SCHEMA)
    told = langid.identify(docs, langid.fit(docs), keep=["doc_id", "text"]).collect()
    kept = [(r.doc_id, r.text) for r in told if r.lang_pred != "und" and not r.ambiguous]
    assert {i for i, _ in kept} >= set(range(40)) and not {i for i, _ in kept} & {104, 105, 106}
    # near duplicates: every pair on its full sets
    sets = {}
    for i, t in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    least = {i: i for i in sets if i is not None}
    for _ in range(3):
        for a in least:
            for b in least:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    kept = [(i, t) for i, t in kept if i is None or least[i] == i]
    assert not {100, 101} & {i for i, _ in kept}
    # repeated passages, in the order of doc_id; a row read twice isn't earlier than itself
    seen, texts = {}, []
    for i, t in sorted((x for x in kept if x[0] is not None), key=lambda x: x[0]):
        data, gone = t.encode(), [False] * len(t.encode())
        for k in range(len(data) - 99):
            if seen.setdefault(data[k : k + 100], (i, k)) != (i, k):
                gone[k : k + 100] = [True] * 100
        texts.append((i, bytes(c for c, g in zip(data, gone, strict=True) if not g).decode()))
    texts += [(i, t) for i, t in kept if i is None]
    # secrets
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.I)
    texts = [(i, assign.sub("[REDACTED]", t)) for i, t in texts]
    # packing: each row's tokens, and one sequence more than their sum needs at most
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(i), len(lib.encode(t, add_special_tokens=False).ids) + 1) for i, t in texts)
    total: dict = {}
    for r in got:
        total.setdefault((str(r.doc_id), r.piece), []).append(r.length)
    copies = {d: len(v) for (d, p), v in total.items() if p == 0}
    sums = {d: sum(sum(v) for (e, _), v in total.items() if e == d) for d in copies}
    assert sorted((d, sums[d] // copies[d]) for d in copies for _ in range(copies[d])) == want
    assert len({r.sequence_id for r in got}) <= 1 - (-sum(r.length for r in got) // 2048)
    assert copies["7"] == 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_rows(spark, name):
    """Columns with the names that operators use inside, an empty table, null, empty and long texts."""
    clashing = {c: F.lit(3) for c in ("row", "route", "kind", "salt", "score", "gone", "lang_pred", "ambiguous", "carried", "all_spans", "component", "length", "number")}
    docs = spark.createDataFrame(table(), SCHEMA).withColumns(clashing)
    out = stage(spark, docs, name)
    rows = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or (out.columns == docs.columns and all(r.salt == 3 and r.row == 3 for r in rows))
    ids = [r.doc_id for r in rows]
    assert None in ids and ids.count(7) == 2
    empty = stage(spark, docs.limit(0), name)
    assert empty.count() == 0 and (last or empty.columns == docs.columns)
    if name != "language_id":
        assert {104, 105, 106} <= set(ids)
    if not last and name != "language_id":
        assert {r.doc_id: r.text for r in rows}[106] is None
    if name == "secret_scan":
        assert {r.doc_id: r.text for r in rows}[103] == secrets_cut()


def secrets_cut() -> str:
    return one(60) + " [REDACTED] " + one(62)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables here")
def test_stages_on_generated_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = corpus_pipeline.run(spark, DATA).collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 150
    assert secrets.redact(docs).count() == docs.count()
