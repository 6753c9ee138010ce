"""Small tools for expressions over arrays, which Spark evaluates element by element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are gone through in one go where each adds to an array.
BLOCK = 128
#: Code points of a text that are cut in one go.
CHUNK = 4096


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def placed(steps: Column, kind: str, make) -> Column:
    """The spans of matches. ``steps`` is an array of struct(skip, size, ok): how many characters come
    before a match, how many it has, and whether it counts; ``make(start, end)`` gives what is returned
    for one, of the type ``kind``. In blocks, as an array that grows by one is copied each time."""
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["skip"]
        end = start + s["size"]
        return F.struct(end.alias("at"), F.when(s["ok"], F.concat(acc["out"], F.array(make(start, end)))).otherwise(acc["out"]).alias("out"))

    def in_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s["skip"] + s["size"]))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))
        own = F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(own)

    blocks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, BLOCK))
    return F.when(F.size(steps) > 0, let(steps, lambda all_: let(blocks(all_), in_blocks))).otherwise(none)


def replaced(text: Column, spans: Column, fill) -> Column:
    """``text`` with its ``spans`` (sorted structs of start and end, which may overlap) replaced by
    ``fill(span, at)``, where ``at`` is how far earlier spans reach. Chunk by chunk, as a place in a
    text is found by counting from its beginning."""

    def chunk(piece: Column, base: Column, own: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            here = s["start"] >= base
            kept = F.when(s["start"] > acc["at"], F.substring(piece, acc["at"] - base + 1, s["start"] - acc["at"])).otherwise("")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(here, F.concat(acc["out"], kept, fill(s, acc["at"]))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(own, F.struct(base.alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] - base + 1, F.lit(CHUNK))))

    def whole(all_: Column) -> Column:
        def one(piece: Column, k: Column) -> Column:
            base = k * CHUNK
            near = F.filter(all_, lambda s: (s["start"] < base + CHUNK) & (s["end"] > base))
            return let(near, lambda own: F.when(F.size(own) == 0, piece).otherwise(chunk(piece, base, own)))

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), one), "")

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, whole))


def scanned(items: Column, state: Column, kind: str, step) -> Column:
    """struct(state, out): ``items`` gone through in order by ``step(acc, item)``, which maps struct(state,
    out) to the next one, where out is an array of ``kind`` that may have grown. In blocks, so that an
    array that grows by one isn't copied whole each time."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def block(acc: Column, some: Column) -> Column:
        now = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("out")), step)
        return let(now, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    def in_blocks(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, BLOCK))
        return F.aggregate(blocks, F.struct(state.alias("state"), nothing.alias("outs")), block, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["outs"]).alias("out")))

    whole = lambda all_: F.aggregate(all_, F.struct(state.alias("state"), none.alias("out")), step)
    return let(items, lambda all_: F.when(F.size(all_) <= BLOCK, whole(all_)).otherwise(in_blocks(all_)))
