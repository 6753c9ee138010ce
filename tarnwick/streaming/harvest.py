"""A harvest of records, page by page, as a streaming source.

A harvest is a chain: each page names the token of the next one. Pages are captured in a folder under
their tokens (the first as ``start``) by whatever fetches them. The source's offset is the token that is
to be read next, so a stream goes on where it ended, a page that isn't captured yet is waited for, and
an offset range is the same pages whenever it is read again. The driver follows the tokens, for which
it reads the ends of pages; tasks read and parse them, one page each.
"""

from __future__ import annotations

import re
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tarnwick.functions.names import author_key, parse_name
from tarnwick.versions import Store

SCHEMA = "page long, place long, creators array<string>, title string, year int, journal string, doi string, url string"
#: Fixed value: how many of a record's creators are kept.
MOST_CREATORS = 25
#: A page's end, in which its token stands.
_TAIL = 4096


def page_name(token: str) -> str:
    """The file that a token's page is captured in."""
    return urllib.parse.quote(token, safe="") + ".xml" if token else "start.xml"


def _open(folder: str, token: str):
    files, path = pafs.FileSystem.from_uri(folder)
    return files, f"{path}/{page_name(token)}"


def next_token(folder: str, token: str) -> str | None:
    """The token that a page names, "" if it is the last; None if the page isn't there, or is a refusal."""
    files, path = _open(folder, token)
    info = files.get_file_info(path)
    if info.type != pafs.FileType.File:
        return None
    with files.open_input_file(path) as f:
        f.seek(max(0, info.size - _TAIL))
        tail = f.read().decode("utf-8", "replace")
    if re.search(r"<(\w+:)?error\b", tail):
        return None
    found = re.search(r"<(?:\w+:)?resumptionToken\b[^>]*>([^<]*)</", tail)
    return ET.fromstring(f"<t>{found[1]}</t>").text.strip() if found and found[1].strip() else ""


def records(xml: str) -> Iterator[tuple]:
    """creators, title, year, journal, doi and url of the page's records that have a title and creators."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for record in ET.fromstring(xml).iter():
        if local(record) != "record":
            continue
        dc = next((e for e in record.iter() if local(e) == "dc"), None)
        texts: dict[str, list[str]] = {}
        for e in dc if dc is not None else ():
            texts.setdefault(local(e), []).append((e.text or "").strip())
        first = texts.get("title", [""])[0]
        creators = [c for c in texts.get("creator", []) if c]
        if not first or not creators:
            continue
        year = next((int(d[:4]) for d in texts.get("date", []) if re.match("[0-9]{4}", d)), None)
        journal = next((s for s in texts.get("source", []) if s), None)
        ids = texts.get("identifier", [])
        doi = next((i.split("doi.org/", 1)[1] for i in ids if "doi.org/" in i), None)
        url = next((i for i in ids if i.startswith("http") and "doi.org/" not in i), None)
        yield creators[:MOST_CREATORS], first, year, journal, doi, url


class _Page(InputPartition):
    def __init__(self, token: str, page: int):
        self.token, self.page = token, page


def _chain(folder: str, start: dict, end: dict | None = None) -> Iterator[tuple[dict, dict]]:
    """The pages from an offset on, each with the offset behind it, up to ``end`` or as far as they go."""
    at = start
    while not at["ended"] and (end is None or at["page"] < end["page"]):
        token = next_token(folder, at["token"])
        if token is None:
            return
        after = {"token": token, "page": at["page"] + 1, "ended": token == ""}
        yield at, after
        at = after


def _read(folder: str, page: _Page) -> Iterator[tuple]:
    files, path = _open(folder, page.token)
    with files.open_input_stream(path) as f:
        xml = f.read().decode()
    for place, record in enumerate(records(xml)):
        yield (page.page, place, *record)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.known = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"token": "", "page": 0, "ended": False}

    def latestOffset(self) -> dict:
        for _, after in _chain(self.folder, self.known):
            self.known = after
        return self.known

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return [_Page(at["token"], at["page"]) for at, _ in _chain(self.folder, start, end)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _read(self.folder, partition)

    def commit(self, end: dict) -> None:
        if end["page"] > self.known["page"]:
            self.known = end


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Page]:
        start = {"token": "", "page": 0, "ended": False}
        return [_Page(at["token"], at["page"]) for at, _ in _chain(self.folder, start)] or [_Page("", -1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _read(self.folder, partition) if partition.page >= 0 else iter(())


class HarvestSource(DataSource):
    """``spark.read`` or ``spark.readStream`` with format("harvest") and option("path", a folder's URI)."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def by_author(found: DataFrame) -> DataFrame:
    """A row for each record and creator with a name: author_norm and the record's columns. Of rows with
    one author_norm and title the first harvested counts."""
    rows = found.select("*", F.posexplode("creators").alias("nth", "creator"))
    name = parse_name(F.col("creator"))
    rows = rows.withColumn("author_norm", author_key(name["first"], name["last"])).where("author_norm <> '|'")
    first = Window.partitionBy("author_norm", "title").orderBy("page", "place", "nth")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("author_norm", "title", "year", "journal", "doi", "url", "page", "place")


def insert_batch(store: Store, found: DataFrame, epoch: int) -> None:
    """A micro-batch's rows that the table ``publications`` doesn't have, as a part of their own; an epoch
    that is in a published version already changes nothing, so a replay leaves the table as it is."""
    manifest = store.manifest()
    if manifest["notes"].get("epoch", -1) >= epoch:
        return
    rows = by_author(found)
    if (have := publications(store)) is not None:
        rows = rows.join(have.select("author_norm", "title"), ["author_norm", "title"], "left_anti")
    store.publish({f"publications-{epoch}": rows}, manifest["version"], {"epoch": epoch})


def publications(store: Store, version: int | None = None) -> DataFrame | None:
    """All harvested rows, None before the first."""
    out = None
    for name, entry in sorted(store.manifest(version)["tables"].items()):
        if name.startswith("publications-"):
            out = store._table(entry) if out is None else out.unionByName(store._table(entry))
    return out


def harvest(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> DataFrame | None:
    """Read all pages that are captured and not read yet, and return the table."""
    spark.dataSource.register(HarvestSource)
    stream = spark.readStream.format("harvest").option("path", folder).load()
    query = stream.writeStream.foreachBatch(lambda batch, epoch: insert_batch(store, batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return publications(store)


def look_up(people: DataFrame, table: DataFrame, most: int = 15) -> DataFrame:
    """``people(person_id, first, last)`` with what was harvested of each, newest first: a row for each of
    at most ``most`` publications, with its place."""
    keyed = people.select("person_id", author_key(F.col("first"), F.col("last")).alias("author_norm"))
    newest = Window.partitionBy("person_id").orderBy(F.col("year").desc_nulls_last(), "title")
    rows = keyed.join(table, "author_norm").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    return rows.select("person_id", "place", "title", "year", "journal", "doi", "url")


def page_xml(entries: Column, token: Column) -> Column:
    """A page as a harvested server writes it, of array<struct<creators,title,dates,sources,ids>>."""
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    each = lambda tag, xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit(f"<dc:{tag}>"), escaped(x), F.lit(f"</dc:{tag}>"))), "")
    one = lambda e: F.concat(F.lit("<record><header/><metadata><oai_dc:dc>"), each("title", F.array(e["title"])), each("creator", e["creators"]), each("date", e["dates"]), each("source", e["sources"]), each("identifier", e["ids"]), F.lit("</oai_dc:dc></metadata></record>"))
    head = '<?xml version="1.0" encoding="UTF-8"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/" xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/"><ListRecords>'
    return F.concat(F.lit(head), F.array_join(F.transform(entries, one), ""), F.lit("<resumptionToken>"), escaped(F.coalesce(token, F.lit(""))), F.lit("</resumptionToken></ListRecords></OAI-PMH>"))


def capture(pages: DataFrame, folder: str) -> int:
    """Write ``pages(token, xml)`` into the folder, as a fetcher does; how many there were."""

    def write(batches):
        import pyarrow as pa

        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_output_stream(f"{path}/{page_name(row['token'])}") as out:
                    out.write(row["xml"].encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return pages.select("token", "xml").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def bucketed(table: DataFrame, name: str, buckets: int) -> DataFrame:
    """The harvested table written in the warehouse by author, so that looking people up shuffles the people
    alone, never the table."""
    table.write.mode("overwrite").bucketBy(buckets, "author_norm").sortBy("author_norm").saveAsTable(name)
    return table.sparkSession.table(name)
