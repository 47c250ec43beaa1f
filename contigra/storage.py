"""Tables in the folder that driver and executors share, and the package on the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset (tests), a temporary one."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="contigra-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Folders that this process named, for clean().
_named: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _named.append(f"{shared_dir(spark)}/contigra/{name}-{uuid.uuid4().hex}")
    return _named[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: the lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a file or folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Removes the folders that this process has named, from the since-th on. Results that are still lazy read them: write
    these first."""
    while len(_named) > since:
        drop(spark, _named.pop())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was stored within: results must be written by then."""
    since = len(_named)
    try:
        yield
    finally:
        clean(spark, since)


@atexit.register
def _end() -> None:
    """What is left at the end of the process goes too: only its own lazy results could have read it."""
    from py4j.protocol import Py4JError, Py4JNetworkError

    if _named and (spark := SparkSession.getActiveSession()) is not None:
        with contextlib.suppress(Py4JError, Py4JNetworkError, OSError):
            clean(spark)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of the files at a path, folder or pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for top in fs.globStatus(at) or []:
        found = fs.listFiles(top.getPath(), True)
        while found.hasNext():
            f = found.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors, once a context, for sessions started without it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_contigra_shipped", False):
        return
    top = Path(__file__).resolve().parent
    at = os.path.join(sc._temp_dir, "contigra.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(at)
    sc._contigra_shipped = True
