"""Very long texts, ties, repeated rows, and a tokenizer whose character map has entries."""

import random
import re
import struct

import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tarnwick.llm import langid, license_scan, packing, pieces, queries

SCHEMA = "doc_id long, text string"


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def fields(pairs):
    """A protocol buffer of numbers and byte strings."""
    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v) for k, v in pairs)


def char_map(entries):
    """A compiled map: a double-array trie of the keys, then the replacements."""
    replacements, places = b"", {}
    for key, new in entries.items():
        places[key.encode()] = len(replacements)
        replacements += new.encode() + b"\0"
    units, taken, bases = [0] * 4096, {0}, set()

    def place(node, keys, depth):
        labels = sorted({k[depth] if len(k) > depth else 0 for k in keys})
        base = next(b for b in range(1, 2048) if b not in bases and all((b ^ x) not in taken for x in labels))
        bases.add(base)
        taken.update(base ^ x for x in labels)
        units[node] |= (node ^ base) << 10 | (256 if 0 in labels else 0)
        for x in labels:
            if x == 0:
                units[base] = places[next(k for k in keys if len(k) == depth)] | 1 << 31
            else:
                units[base ^ x] = x
                place(base ^ x, [k for k in keys if len(k) > depth and k[depth] == x], depth + 1)

    place(0, list(places), 0)
    trie = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(trie)) + trie + replacements


@pytest.fixture(scope="module")
def mapped_model(tmp_path_factory):
    """The public model with a map of full-width letters, ligatures, marks and blanks."""
    model = open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read()
    entries = {"ﬁ": "fi", "Ａ": "A", "Ｂ": "B", "…": "...", "é": "é", "e": "e", "　": " ", "\t": " ", "​": "", "№": "No", "ab": "ba", "abc": "x"}
    changed = []
    for number, value in pieces._fields(model):
        if number == 3:
            value = fields([(k, v) for k, v in pieces._fields(value) if k != 2] + [(2, char_map(entries))])
        if isinstance(value, (int, bytes)):
            changed.append((number, value))
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(fields(changed))
    return str(path)


def test_pieces_over_a_character_map(spark, mapped_model):
    """The trie is walked, and every piece's span is the library's."""
    draw = random.Random(2)
    parts = ["ﬁ", "Ａ", "Ｂ", "…", "é", "e", "　", "\t", "​", "№", "ab", "abc", "a", "hello", " world", "  ", "日本", "é", "abcab", "x"]
    texts = ["ﬁrst …", "abcabab é", "　　a", "​", ""] + ["".join(draw.choices(parts, k=draw.randint(1, 30))) for _ in range(400)]
    library = sentencepiece.SentencePieceProcessor(model_file=mapped_model)
    assert library.encode("ﬁ Ａ", out_type=str) == library.encode("fi A", out_type=str) != library.encode("ﬁ", out_type=str)
    got = {r.doc_id: r.pieces for r in pieces.encode_spans(spark.createDataFrame(list(enumerate(texts)), SCHEMA), mapped_model).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text, return_type="proto").pieces
        assert [(p.id, p.start, p.end) for p in got[i]] == [(p.id, max(p.begin, 0), p.end) for p in want], text


def test_texts_above_a_megabyte(spark):
    draw = random.Random(4)
    long = " ".join("".join(draw.choice("aeioundrst") for _ in range(draw.randint(2, 8))) for _ in range(250_000))
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, long), (2, "Released under the MIT licence\n" + long), (3, long)], SCHEMA)
    found = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert found[1].digest == found[3].digest != found[2].digest and not found[1].notices and found[2].notices == "MIT"

    path = queries.tokenizer_path("byte_bpe_50k.json")
    ids = {i: len(tokenizers.Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for i, t in [(1, long), (2, "Released under the MIT licence\n" + long)]}
    packed = packing.pack(docs, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most"), F.count("*").alias("pieces")).collect()
    for r in packed:
        assert r.n == ids[min(r.doc_id, 2) if r.doc_id != 3 else 1] and r.most <= 2048 and r.pieces == -(-r.n // 2048)

    model = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r.doc_id: r.n_tokens for r in pieces.piece_digests(docs, model).collect()} == {i: len(library.encode(t)) for i, t in [(1, long), (3, long), (2, "Released under the MIT licence\n" + long)]}


def test_of_equal_canonical_texts_the_first_counts(spark):
    known = [("Zeta", "Do  what you WILL."), ("Beta", "do what you will"), ("Gamma", "else")]
    docs = spark.createDataFrame([(1, "DO WHAT YOU WILL"), (1, "do what; you will!"), (2, "else"), (3, None)], SCHEMA)
    rows = sorted((r.doc_id, r.license or "") for r in license_scan.license_scan(docs, known).collect())
    assert rows == [(1, "Zeta"), (1, "Zeta"), (2, "Gamma"), (3, "")]


def test_repeated_rows_have_one_language(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "le chat et la souris " * 3, "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows + [rows[3], rows[3], (3, rows[2][1], "fr")], SCHEMA + ", lang string")
    got = langid.language_id(docs).collect()
    assert len(got) == 63 and {(r.doc_id, r.lang_pred) for r in got} == {(i, lang) for i, _, lang in rows} | {(3, "fr")}
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_the_generated_documents(spark):
    """Every held-out row of the small tables is told right, whatever stands in lang, source and doc_id."""
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == truth.keys()
    right = held = 0
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", truth[i].text or ""))
        if r.held_out and r.lang_pred != "und":
            held += 1
            right += r.lang_pred == truth[i].lang
    assert held > 100 and right >= 0.99 * held
    hidden = docs.withColumns({"source": F.lit("x"), "lang": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.col("lang"))})
    assert {r.doc_id: r.lang_pred for r in langid.language_id(hidden).collect()} == {i: r.lang_pred for i, r in got.items()}
