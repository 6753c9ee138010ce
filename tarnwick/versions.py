"""Tables that are published together, version by version.

A version is a manifest, one small JSON file that names the folder, schema and row count of each of its
tables. A writer puts its tables aside in folders of their own, checks them, and then renames the
manifest into place under the next number; that is the only step that readers can see, and it fails if
another writer has taken the number. A writer that dies before it leaves folders that no manifest names.
Readers stay on the version that they began with for as long as it is kept. Tables that a version doesn't
change are named by its manifest too, so nothing is copied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


class Refused(ValueError):
    """What was to be published doesn't hold together."""


class Store:
    """Versioned tables in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def versions(self) -> list[int]:
        """The numbers of all versions that are kept, rising."""
        at = self._path("manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "notes": {}}
        return json.loads(self.spark.read.text(str(self._path("manifests", f"{version}.json")), wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest one), which stays as it is while others write."""
        return self._table(self.manifest(version)["tables"][name])

    def _table(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.folder}/{entry['path']}")

    def publish(self, tables: dict[str, DataFrame | Callable[[DataFrame], DataFrame]], parent: int, notes: dict | None = None, drop: Iterable[str] = (), checks: Iterable[Callable[[dict[str, DataFrame]], str | None]] = ()) -> int:
        """The version after ``parent``: its tables with ``tables`` in place of those of equal name and
        without ``drop``. ``notes`` are small facts that belong to it, added to the parent's. A function
        in place of a table makes it of the one before it, as written. A check gets all of the version's
        tables, as written, and returns what is wrong with them, if anything is."""
        before = self.manifest(parent)
        folder = f"data/{uuid.uuid4().hex}"
        entries = {n: e for n, e in before["tables"].items() if n not in set(drop)}
        try:
            for name, df in tables.items():
                path = f"{folder}/{name}"
                df = df(written) if callable(df) else df
                df.write.parquet(f"{self.folder}/{path}")
                written = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{path}")
                entries[name] = {"path": path, "schema": json.loads(df.schema.json()), "rows": written.count()}
            whole = {n: self._table(e) for n, e in entries.items()}
            if wrong := [w for w in (check(whole) for check in checks) if w]:
                raise Refused("; ".join(wrong))
            self._put({"version": parent + 1, "tables": entries, "notes": before["notes"] | (notes or {})}, parent + 1)
        except BaseException:
            self._fs.delete(self._path(folder), True)
            raise
        return parent + 1

    def _put(self, manifest: dict, version: int) -> None:
        """The manifest under its number, whole or not at all, and never in place of another."""
        jvm = self.spark._jvm
        aside, target = self._path(f"manifest-{uuid.uuid4().hex}"), self._path("manifests", f"{version}.json")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(aside, target, kinds)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                raise Conflict(f"version {version} has been published by another writer") from e
            raise

    def keep(self, newest: int) -> None:
        """Forget all versions but the newest ones, and the folders that none of those names. Not to be
        called while a writer is at work, whose folders no manifest names yet."""
        every = self.versions()
        kept = every[-newest:] if newest else []
        used = {e["path"].split("/")[1] for v in kept for e in self.manifest(v)["tables"].values()}
        for v in set(every) - set(kept):
            self._fs.delete(self._path("manifests", f"{v}.json"), False)
        data = self._path("data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)


def same_rows(left: str, right: str) -> Callable[[dict[str, DataFrame]], str | None]:
    """A check that two tables have equally many rows, as records and what is indexed of them."""

    def check(tables: dict[str, DataFrame]) -> str | None:
        a, b = tables[left].count(), tables[right].count()
        return None if a == b else f"{left} has {a} rows, {right} {b}"

    return check


def unique(name: str, key: str) -> Callable[[dict[str, DataFrame]], str | None]:
    """A check that no key of a table occurs twice."""

    def check(tables: dict[str, DataFrame]) -> str | None:
        twice = tables[name].groupBy(key).count().where("count > 1").limit(1).collect()
        return f"{name} has {twice[0][key]!r} twice" if twice else None

    return check
