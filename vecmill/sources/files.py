"""Files that tasks read and write at given places.

``arrow_fs`` opens them in Python workers (local folders and the stores that pyarrow knows);
what the driver needs of a file it reads through Hadoop's file systems.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def arrow_fs(uri: str):
    """(file system, path) of an address, usable in Python workers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, path: str) -> tuple[str, int]:
    """Full address of a file and its size."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop).toString(), fs.getFileStatus(hadoop).getLen()


def folder(spark: SparkSession, path: str) -> str:
    """Full address of a folder, made if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    return fs.makeQualified(hadoop).toString()


def head_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first ``n`` bytes of a file (fewer, if it is shorter), on the driver."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:  # as text of a character a byte: arrays of bytes are turned one by one on their way
        return jvm.org.apache.commons.io.IOUtils.toString(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n), "ISO-8859-1").encode("latin-1")
    finally:
        stream.close()


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, or on a
    local master without it a temporary folder.  It goes with the driver."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        top = f"file://{tempfile.mkdtemp(prefix='vecmill-')}"
    path = folder(spark, f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
