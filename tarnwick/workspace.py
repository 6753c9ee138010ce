"""Tables in the folder that driver and executors share.

The folder is the one that ``spark.checkpoint.dir`` names. Only where that is unset and everything
runs on one machine a temporary folder is made and set; a cluster without the setting is refused, as
its machines would not see each other's files. Written tables cut the lineage: an executor that is
lost costs a re-read, never a recomputation of the whole chain.
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What was written and not deleted: number, thread, session and path.
_written: list[tuple[int, int, SparkSession, str]] = []
_numbers = itertools.count(1)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif re.match(r"local($|\[)", spark.sparkContext.master):
            folder = "file://" + tempfile.mkdtemp(prefix="tarnwick-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def save(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by the columns ``by`` (its last ones),
    and return it reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarnwick-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _written.append((next(_numbers), threading.get_ident(), spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for what streams and stores write, deleted with the tables."""
    path = f"{shared_folder(spark)}/tarnwick-{name}-{uuid.uuid4().hex}"
    _written.append((next(_numbers), threading.get_ident(), spark, path))
    return path


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`save` returned and that no later plan reads."""
    _delete(df.sparkSession, df._scratch_path)


def mark() -> int:
    """A number before those of all tables that are written from now on, for :func:`drop_since`."""
    return next(_numbers)


def drop_since(begin: int, *kept: DataFrame) -> None:
    """Delete the tables that this thread has written since ``begin = mark()``, but those that are still
    read. What other threads write meanwhile is theirs."""
    stay, me = {df._scratch_path for df in kept}, threading.get_ident()
    gone = [w for w in _written if w[0] > begin and w[1] == me and w[3] not in stay]
    for w in gone:
        _delete(w[2], w[3])
        _written.remove(w)


def clear() -> None:
    """Delete every table of this process. Results that still read them can't be used afterwards."""
    while _written:
        _delete(*_written.pop()[2:])


atexit.register(clear)
