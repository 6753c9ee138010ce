"""Document fingerprints by invertible Bloom lookup, with DataFrame functions only.

A text is cut into paragraphs (at line ends, and, so that short texts have several too, at sentence
ends of any script), each is hashed, and the n-th occurrence of a paragraph counts as a digest of its
own. A sketch adds each 64-bit digest to three cells, one in each third of the sketch; a cell holds the
number of digests, their exclusive or and that of their checksums. Sketches of two versions are
subtracted cell by cell, what both have cancels, and peeling recovers the digests of which they differ:
a cell with one digest reveals it, and it is taken out of its other cells, again and again. Where some
cells remain, or nearly all are in use, that is repeated with a sketch of many cells for each digest.

Sketches are kept sparse, as sorted arrays of their cells in use, so that their cost follows the text's
length, not the sketch's nor its square. A row is worked on by itself: nothing is
grouped, and memory doesn't depend on the size of partitions. (Cells as rows of hash aggregates took the
same CPU seconds, but 772 MB in a task for 7 MB of texts, and more than the disk budget in spills.)

Likeness is the number of shared digests over that of all, 1.0 for two texts without any.

The text that follows a document's, in descending order of doc_id, is found without sorting all rows
in one place: documents are dealt to ranges of doc_id, a window leads within each range, and the
first row of each range is also sent to the range before it.

Defined cases: a null text counts as empty and has no paragraphs; rows without doc_id come last;
repeated doc_ids are ordered by text; a single document follows itself; a very long text is one list of
paragraphs; an empty table gives an empty result. Columns other than doc_id and text are ignored,
however they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .native import let, scanned

CELLS = 96
#: Cells for each digest in the larger sketch.
EACH = 2048
#: With more than this many of the small sketch's cells in use the larger one is tried at once: peeling
#: what fills three quarters of them takes many rounds, if it ends at all.
FULL = CELLS * 3 // 4
_CELL = "struct<cell:bigint,n:int,key:bigint,chk:bigint>"

#: Fixed values, as ranges of regular expressions: line ends, blanks, what ends a sentence before a
#: blank (Unicode's Sentence_Terminal, the ellipsis and the Greek question mark), what ends one
#: without a blank, and quotes and brackets that may close behind it.
LINE_END = r"\n\x0B\x0C\r\x85\u2028\u2029"
BLANK = r"\t\x20\xA0\u1680\u2000-\u200A\u202F\u205F\u3000"
STOP = (
    r"!.?\u037E\u0589\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0837\u0839\u083D\u083E\u0964\u0965\u0F0D\u0F0E\u104A\u104B\u1362\u1367\u1368\u166E"
    r"\u1735\u1736\u17D4\u17D5\u1803\u1809\u1944\u1945\u1AA8-\u1AAB\u1B5A\u1B5B\u1B5E\u1B5F\u1B7D\u1B7E\u1C3B\u1C3C\u1C7E\u1C7F\u2024\u2026\u203C\u203D"
    r"\u2047-\u2049\u2E2E\u2E3C\u2E53\u2E54\u3002\uA4FF\uA60E\uA60F\uA6F3\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C8\uA9C9\uAA5D-\uAA5F\uAAF0\uAAF1\uABEB"
    r"\uFE52\uFE56\uFE57\uFF01\uFF0E\uFF1F\uFF61"
)
BARE_STOP = r"\u0964\u0965\u0F0D\u0F0E\u104A\u104B\u1362\u17D4\u17D5\u3002\uFF01\uFF1F\uFF61"
CLOSE = r"\x22')\]}\xBB\u2018\u2019\u201C\u201D\u203A\u3009\u300B\u300D\u300F\u3011\u3015\uFF09\uFF3D\uFF63"
# at most places a test of one small class fails first, as the longer ones are dear
SPACED_END = rf"(?=[^\x21-\x7E])(?:[{LINE_END}]|(?<![a-zA-Z0-9,])(?=[{BLANK}])(?<=[{STOP};{CLOSE}])(?<=(?:[{STOP}]|\p{{IsGreek}};)[{CLOSE}]{{0,4}})[{BLANK}]+)"
BARE_END = rf"(?<=[\x22')\]}}\xBB\u0964-\uFFFF])(?<=[{BARE_STOP}{CLOSE}])(?<=[{BARE_STOP}][{CLOSE}]{{0,4}})(?![{BARE_STOP}{CLOSE}{BLANK}])"


#: The first of these for texts of ASCII characters alone, where the classes are short.
ASCII_END = r"""(?=[\t-\r\x20])(?:[\n\x0B\x0C\r]|(?<![a-zA-Z0-9,])(?<=[!.?"')\]}])(?<=[!.?]["')\]}]{0,4})[\t\x20]+)"""


def digests(text: Column) -> Column:
    """The digests of the paragraphs: hashes of their hash and of how often it occurred so far."""
    cut = F.when(F.octet_length(text) == F.length(text), F.split(text, ASCII_END, -1)).otherwise(F.split(text, f"{SPACED_END}|{BARE_END}", -1))
    hashes = F.sort_array(F.transform(F.filter(cut, lambda p: F.length(p) > 0), lambda p: F.xxhash64(p)))

    def number(acc: Column, h: Column) -> Column:
        nth = F.when(h == acc["state"]["h"], acc["state"]["nth"] + 1).otherwise(F.lit(1))
        return let(nth, lambda k: F.struct(F.struct(h.alias("h"), k.alias("nth")).alias("state"), F.concat(acc["out"], F.array(F.xxhash64(h, k))).alias("out")))

    start = F.lit(None).cast("struct<h:bigint,nth:int>")
    repeated = lambda hs: scanned(hs, start, "bigint", number)["out"]
    return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.transform(hs, lambda h: F.xxhash64(h, F.lit(1)))).otherwise(repeated(hs)))


def cell_places(key: Column, third: Column) -> list[Column]:
    """The three cells of a digest in a sketch of three times ``third`` cells."""
    return [F.lit(j).cast("bigint") * third + F.pmod(F.xxhash64(key, F.lit(j)), third) for j in range(3)]


def _small_third() -> Column:
    return F.lit(CELLS // 3).cast("bigint")


def checksum(key: Column) -> Column:
    return F.xxhash64(key)


def _entries(key: Column, n: Column, third: Column) -> Column:
    """What a digest adds to its three cells."""
    return F.array(*(F.struct(c.alias("cell"), n.cast("int").alias("n"), key.alias("key"), checksum(key).alias("chk")) for c in cell_places(key, third)))


def _fold(entries: Column) -> Column:
    """One entry for each cell, in their order: sums and exclusive ors; cells without content go. The
    entries are sorted by cell, and each run of one cell is summed by itself, so that no array grows."""
    cell_of = lambda x: F.shiftright(x, 32)
    zero = F.struct(F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("chk"))

    def whole(all_: Column) -> Column:
        entry = lambda x: F.get(all_, x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))

        def add(acc: Column, x: Column) -> Column:
            return let(entry(x), lambda e: F.struct(e["cell"].alias("cell"), (acc["n"] + e["n"]).alias("n"), acc["key"].bitwiseXOR(e["key"]).alias("key"), acc["chk"].bitwiseXOR(e["chk"]).alias("chk")))

        def runs(order: Column) -> Column:
            begins = F.filter(F.transform(order, lambda x, i: F.when((i == 0) | (cell_of(x) != cell_of(F.get(order, i - 1))), i)), lambda i: i.isNotNull())

            def summed(starts: Column) -> Column:
                def run(i: Column, j: Column) -> Column:
                    size = F.coalesce(F.get(starts, j + 1), F.size(order)) - i
                    return let(size, lambda n: F.when(n == 1, entry(F.get(order, i))).otherwise(F.aggregate(F.slice(order, i + 1, n), zero, add)))

                return F.filter(F.transform(starts, run), lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0))

            return let(begins, summed)

        # cells and places as one number each, which sort faster than structs
        return let(F.sort_array(F.transform(all_, lambda e, i: F.shiftleft(e["cell"], 32) + i)), runs)

    return let(entries, whole)


def sketch(keys: Column, third: Column) -> Column:
    """The cells in use of the sketch with three times ``third`` cells of an array of digests."""
    return _fold(F.flatten(F.transform(keys, lambda k: _entries(k, F.lit(1), third))))


def subtract(a: Column, b: Column) -> Column:
    minus = F.transform(b, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["key"].alias("key"), c["chk"].alias("chk")))
    return _fold(F.concat(a, minus))


def peel(difference: Column, third: Column, rounds: int = 40) -> Column:
    """struct(left: how many cells remain, n: how many digests came out, keys: they, with n = 1 if
    the first version has them and -1 if the second has)."""
    found = "array<struct<key:bigint,n:int>>"

    pure = F.filter(difference, lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == checksum(c["key"])))
    signed = lambda p, n: F.transform(F.array_distinct(F.transform(F.filter(p, lambda c: c["n"] == n), lambda c: c["key"])), lambda k: F.struct(k.alias("key"), F.lit(n).alias("n")))

    def step(acc: Column, _: Column) -> Column:
        again = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == checksum(c["key"])))
        taken = let(again, lambda p: F.concat(signed(p, 1), signed(p, -1)))
        stuck = F.struct(F.array().cast(f"array<{_CELL}>").alias("cells"), acc["keys"].alias("keys"), acc["cells"].alias("stuck"))
        out = lambda p: _fold(F.concat(acc["cells"], F.flatten(F.transform(p, lambda z: _entries(z["key"], -z["n"], third)))))
        go = let(taken, lambda p: F.when(F.size(p) == 0, stuck).otherwise(F.struct(out(p).alias("cells"), F.concat(acc["keys"], p).alias("keys"), acc["stuck"].alias("stuck"))))
        return F.when(F.size(acc["cells"]) == 0, acc).otherwise(go)

    start = F.struct(difference.alias("cells"), F.array().cast(found).alias("keys"), F.array().cast(f"array<{_CELL}>").alias("stuck"))
    all_rounds = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: F.struct((F.size(acc["cells"]) + F.size(acc["stuck"])).alias("left"), F.size(acc["keys"]).alias("n"), acc["keys"].alias("keys")))

    def or_all(p: Column) -> Column:
        # every digest has three cells, so the exclusive or of all cells' checksums is that of all
        # digests', and one that is missing from keys leaves a difference
        total = lambda xs, get: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(get(x)))
        none_left = lambda keys: (F.size(p) == F.size(difference)) | (total(difference, lambda c: c["chk"]) == total(keys, lambda z: checksum(z["key"])))
        return let(F.concat(signed(p, 1), signed(p, -1)), lambda keys: F.when(none_left(keys), F.struct(F.lit(0).alias("left"), F.size(keys).alias("n"), keys.alias("keys"))).otherwise(all_rounds))

    return let(pure, or_all)


def _written(cells: Column) -> Column:
    """A sketch as text: base64 of place, number, digest and 32 bits of checksum of each cell."""
    hexed = lambda c, width: F.lpad(F.right(F.hex(c), F.lit(width)), width, "0")
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(cells, lambda c: F.concat(hexed(c["cell"], 2), hexed(c["n"].cast("long"), 4), hexed(c["key"], 16), hexed(c["chk"], 8))), ""))), r"\s", "")


def with_next_text(docs: DataFrame, bytes_each: int = 4 << 20) -> DataFrame:
    """doc_id, text and next_text: that of the next lower doc_id, of the highest for the lowest."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = max(1, min(1 << 16, -(-scratch.size_bytes(docs, "text") // bytes_each)))
    bounds = sorted({int(x) for x in source.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else []
    if bounds:
        table = F.array(*(F.lit(b).cast("long") for b in bounds)) if len(bounds) < 8 else F.from_json(F.lit(str(bounds)), "array<bigint>")
        steps = max(1, len(bounds).bit_length())
        halve = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(let(((acc["lo"] + acc["hi"]) / 2).cast("int"), lambda m: F.when(F.get(table, m) < F.col("doc_id"), F.struct((m + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), m.alias("hi")))))
        place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda acc: acc["lo"])
        place = F.coalesce(place, F.lit(0))
    else:
        place = F.lit(0)
    placed = source.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place))
    tops = placed.select("range", "doc_id").groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()  # one row a range
    known = [(r["range"], r["top"]) for r in tops]
    wraps = [(known[i - 1][1] if i else known[-1][1], known[i][0]) for i in range(len(known))]
    copies: dict[int, list[int]] = {}
    for doc, to in wraps:
        if doc is not None:
            copies.setdefault(doc, []).append(to)
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("also", T.ArrayType(T.IntegerType()))])
    heads = spark.createDataFrame(list(copies.items()), schema)
    # heads has a row for each range at most, so this broadcast is bounded
    dealt = placed.join(F.broadcast(heads), "doc_id", "left").withColumn(
        "to", F.explode(F.concat(F.array(F.struct("range", F.lit(False).alias("copy"))), F.transform(F.coalesce("also", F.array().cast("array<int>")), lambda r: F.struct(r.alias("range"), F.lit(True).alias("copy")))))
    )
    spread = dealt.select("doc_id", "text", "to.range", "to.copy").repartition("range").withColumn("own", digests(F.col("text")))
    spread = spread.withColumn("own_cells", sketch(F.col("own"), _small_third()))
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    led = spread.withColumns({"next_text": F.lead("text").over(order), "next": F.lead("own").over(order), "next_cells": F.lead("own_cells").over(order)})
    none = F.array().cast("array<bigint>")
    return led.where(~F.col("copy")).select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"), "own", F.coalesce("next", none).alias("next"), "own_cells", F.coalesce("next_cells", F.array().cast(f"array<{_CELL}>")).alias("next_cells"))


def differing(df: DataFrame, a: str, b: str, sketch_a: str, sketch_b: str, out: str) -> DataFrame:
    """``df`` with ``out``: how many digests of the arrays ``a`` and ``b`` differ, as peeling recovers
    them, from their small sketches or from larger ones. Should those leave cells too (digests that share
    all three, below one in 10**7), three of them count as one digest. (In steps, as Spark resolves
    expressions of a limited depth.)"""
    third = F.col("_third")
    signed = lambda keys, n: F.flatten(F.transform(keys, lambda k: _entries(k, F.lit(n), third)))
    whole = lambda p: F.when(p["left"] == 0, p["n"])
    at_last = lambda p: p["n"] + F.ceil(p["left"] / 3).cast("int")
    df = df.withColumn("_small", subtract(F.col(sketch_a), F.col(sketch_b))).withColumn("_third", (F.size(a) + F.size(b) + 1).cast("long") * (EACH // 3))
    df = df.withColumn("_first", F.when(F.size("_small") <= FULL, let(peel(F.col("_small"), _small_third()), whole)))
    df = df.withColumn("_large", F.when(F.col("_first").isNull(), _fold(F.concat(signed(a, 1), signed(b, -1)))))
    df = df.withColumn(out, F.when(F.col("_first").isNull(), let(peel(F.col("_large"), third), at_last)).otherwise(F.col("_first")))
    return df.drop("_small", "_third", "_first", "_large")


def likeness(a: Column, b: Column, apart: Column) -> Column:
    shared = (a + b - apart) / 2
    return F.when(a + b == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), shared / (shared + apart))).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: its fingerprint, that of its edited text (the last
    third replaced by the beginning of the next text), and the likeness of the first to the second
    and to the next document's."""
    df = with_next_text(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("new"), "next", "own_cells", "next_cells")
    df = df.withColumn("new_cells", sketch(F.col("new"), _small_third()))
    near = lambda name, d: likeness(F.size("own"), F.size(name), F.col(d))
    df = differing(df, "own", "new", "own_cells", "new_cells", "by_edit")
    df = differing(df, "own", "next", "own_cells", "next_cells", "to_next")
    return df.select("doc_id", "n_chars", "edited_sha256", _written(F.col("own_cells")).alias("fingerprint"), _written(F.col("new_cells")).alias("edited_fingerprint"), near("new", "by_edit").alias("near_edited"), near("next", "to_next").alias("near_next"))
