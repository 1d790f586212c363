"""The folder that driver and executors share, and files in it.

Tables that cut lineage and binary files go below ``spark.checkpoint.dir``.  Without that
setting a temporary folder of this machine serves a local master (tests); on a cluster
its absence is an error, since every executor would write to a disk of its own.

Tables that ``saved`` writes are temporary: they go when the driver's JVM ends, or with
``discard`` before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[str, str]] = []  # (application, path) of tables not discarded yet


def shared_dir(spark: SparkSession) -> str:
    """URI of a fresh, empty folder that every executor can reach."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = own.get() if own.isDefined() else None
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='vecmill-')}")
        top = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if "://" not in top and top.startswith("/"):
        top = f"file://{top}"
    return f"{top.rstrip('/')}/vecmill-{uuid.uuid4().hex}"


def _at(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


#: For rows of up to megabytes: pages and row groups are measured every few rows, else a
#: page takes a hundred rows at least and a writer holds a row group of 128 MB.
_BIG_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8, "parquet.block.size": 16 << 20}


def saved(df: DataFrame, big_rows: bool = False) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back: later steps
    start from the files, so a lost executor costs no recomputation.  With ``big_rows``
    row groups have some 16 MB, so neither writers nor readers hold more at once."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    schema = df.schema
    df.write.options(**(_BIG_ROWS if big_rows else {})).parquet(path)
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    _written.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete the tables that ``saved`` has written in this application; how many.  Results
    that were not written elsewhere cannot be read afterwards."""
    mine = [p for app, p in _written if app == spark.sparkContext.applicationId]
    for p in mine:
        fs, at = _at(spark, p)
        fs.delete(at, True)
    _written[:] = [x for x in _written if x[0] != spark.sparkContext.applicationId]
    return len(mine)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def arrow_fs(uri: str):
    """(file system, path) for a URI, usable in Python workers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
