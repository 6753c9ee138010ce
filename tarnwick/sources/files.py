"""Files as sources: roster extracts, directory JSON, uploaded documents."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick import workspace

MOST_CHARACTERS = 60_000


def roster_csv(spark: SparkSession, path: str, preamble: int = 3) -> DataFrame:
    """A Latin-1 CSV whose header follows ``preamble`` lines, all columns as strings, and pos (the place
    in its file). Columns are those of the first file; others may order them otherwise.

    Files are read by lines, in splits, however large they are. A line begins a record if an even number
    of quotes stands before it, which the sums of the splits tell without reading one after the other;
    lines are put together to records, and each is parsed by itself. As the format asks, a quote within a
    field is doubled and the field quoted. A row that ends early has blank cells, a blank one is left out.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"),
    )
    in_block = Window.partitionBy("file", "block").orderBy("at")
    first = F.col("block") == 0
    lines = raw.withColumn("n", F.when(first, F.row_number().over(in_block))).where(F.col("n").isNull() | (F.col("n") > preamble))
    quotes = lambda x: F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))
    lines = workspace.save(lines.withColumn("quotes", quotes(F.col("line")).cast("long")).drop("n"))

    # a row for each split: does it begin within a quoted field
    over_blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("quotes").over(over_blocks), F.lit(0)) % 2).alias("open"))
    before = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("open")
    marked = workspace.save(lines.join(blocks, ["file", "block"]).withColumn("begins", (before % 2 == 0).cast("long")).drop("quotes", "open"))

    # and how many records begin before it
    begun = marked.groupBy("file", "block").agg(F.sum("begins").alias("begins"))
    begun = begun.select("file", "block", F.coalesce(F.sum("begins").over(over_blocks), F.lit(0)).alias("records"))
    numbered = marked.join(begun, ["file", "block"]).withColumn("pos", F.col("records") + F.sum("begins").over(in_block) - 2)
    whole = numbered.groupBy("file", "pos").agg(F.sort_array(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
    records = whole.select("file", "pos", F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), "\r$", "").alias("record"))
    records = workspace.save(records)
    workspace.drop(lines)
    workspace.drop(marked)

    # the record before the first is the header
    heads = {r.file: next(csv.reader([r.record]), []) for r in records.where("pos = -1").collect()}  # a row for each file
    if not heads or not heads[min(heads)]:
        return spark.createDataFrame([], "pos long")
    names = heads[min(heads)]
    widest = max(map(len, heads.values()))
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(widest)), {"escape": '"', "nullValue": "\x00", "emptyValue": "", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    # where each column stands in each file
    places = spark.createDataFrame([(f, [head.index(n) if n in head else None for n in names]) for f, head in heads.items()], "file string, places array<int>")
    rows = records.where("pos >= 0").withColumn("cells", F.array(*(cells[f"c{i}"] for i in range(widest)))).join(places, "file")
    rows = rows.where(F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    cell = lambda at: F.when(at.isNotNull(), F.coalesce(F.get("cells", at), F.lit("")))
    return rows.select("pos", *(cell(F.get("places", F.lit(i))).alias(n) for i, n in enumerate(names)))


def directory_json(spark: SparkSession, path: str, items: str = "faculty") -> tuple[DataFrame, DataFrame]:
    """The people that files of one object each list under ``items``, and the files' other fields."""
    files = spark.read.json(path, multiLine=True)
    people = files.select(*(F.col(c).alias(f"file_{c}") for c in files.columns if c in ("department", "university")), F.explode(items).alias("p")).select("*", "p.*").drop("p")
    return people, files.drop(items)


def _pdf_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs pypdf") from e
    return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def uploaded_documents(spark: SparkSession, path: str, most: int = MOST_CHARACTERS) -> DataFrame:
    """path, text and error of PDF and text files: UTF-8, else Latin-1, trimmed, the first ``most``
    characters; an empty file, another kind or one that can't be read has an error instead."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    plain = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))

    def text_of(data):
        try:
            return _pdf_text(bytes(data))
        except Exception:
            return None

    @F.pandas_udf("string")
    def pdf(contents: pd.Series) -> pd.Series:
        return contents.map(text_of, na_action="ignore")

    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    text = F.left(F.trim(F.when(kind == "txt", plain).when(kind == "pdf", pdf("content"))), F.lit(most))
    out = files.select("path", kind.alias("kind"), text.alias("text"))
    error = F.when(~F.col("kind").isin("txt", "pdf"), "unsupported file type").when(F.col("text").isNull(), "could not be read").when(F.col("text") == "", "no text")
    return out.select("path", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))
