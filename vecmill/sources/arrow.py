"""Arrow IPC files as a Spark data source: saved dataset folders, streams and files.

A partition is a range of record batches; batches go on to Spark as Arrow.  A stream has no
list of its batches, so their places are found from the message heads alone, without reading
the batches.  Of the columns only those of the requested schema are decoded.

    spark.dataSource.register(ArrowSource)
    spark.read.format("arrow_ipc").load("/data/saved_dataset")
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from .files import arrow_fs

MAGIC, MARK = b"ARROW1", b"\xff\xff\xff\xff"
DICTIONARY, BATCH = 2, 3  # kinds of messages (fixed values of the format)


def _message_head(meta: bytes) -> tuple[int, int]:
    """(kind, body length) of a message's flatbuffer: fields 1 and 3 of its root table."""
    table = struct.unpack_from("<I", meta, 0)[0]
    slots = table - struct.unpack_from("<i", meta, table)[0]
    size = struct.unpack_from("<H", meta, slots)[0]
    field = lambda k: struct.unpack_from("<H", meta, slots + 4 + 2 * k)[0] if 4 + 2 * k < size else 0
    kind = meta[table + field(1)] if field(1) else 0
    body = struct.unpack_from("<q", meta, table + field(3))[0] if field(3) else 0
    return kind, body


def stream_messages(file) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of each message of a stream; reads only the heads."""
    at, size = 0, file.size()
    while at + 4 <= size:
        mark = file.read_at(8, at)
        wide = 8 if mark[:4] == MARK else 4  # older writers leave the mark out
        n = struct.unpack("<I", mark[wide - 4 : wide])[0]
        if n == 0:
            return
        meta = file.read_at(n, at + wide)
        if len(meta) < n:
            raise OSError("the stream ends in a message head")
        kind, body = _message_head(meta)
        end = at + wide + n + body
        if end > size:
            raise OSError("the stream ends in a record batch")
        yield kind, at, end
        at = end


def files_below(path: str) -> list[str]:
    """The ``.arrow`` files of a folder in order, or the file itself."""
    from pyarrow import fs as pafs

    fs, root = arrow_fs(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [path]
    found = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.base_name.endswith(".arrow"))
    if not found:
        raise FileNotFoundError(f"no .arrow files in {path}")
    return [f"{path.rstrip('/')}/{n}" for n in found]


def _opened(path: str):
    fs, at = arrow_fs(path)
    return fs.open_input_file(at)


def arrow_schema(path: str) -> pa.Schema:
    with _opened(files_below(path)[0]) as f:
        if f.read_at(6, 0) == MAGIC:
            return pa.ipc.open_file(f).schema
        first = next(stream_messages(f), None)
        if first is None:
            raise OSError(f"no schema in {path}")
        return pa.ipc.read_schema(pa.BufferReader(f.read_at(first[2] - first[1], first[1])))


@dataclass
class Range(InputPartition):
    """Batches ``first`` to ``last`` of a file, or the byte spans of a stream's messages."""

    path: str
    first: int
    last: int
    spans: list[tuple[int, int]] | None  # null for a file with a footer


class ArrowReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.bytes = int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        for path in files_below(self.path):
            with _opened(path) as f:
                if f.read_at(6, 0) == MAGIC:
                    n = pa.ipc.open_file(f).num_record_batches
                    step = max(1, n // max(1, -(-f.size() // self.bytes)))
                    out += [Range(path, i, min(i + step, n), None) for i in range(0, n, step)]
                    continue
                heads, batches = [], []
                for kind, lo, hi in stream_messages(f):
                    (batches if kind == BATCH else heads).append((lo, hi))
                    if kind == DICTIONARY and batches:
                        raise OSError(f"{path}: dictionaries that change between batches cannot be read in parts")
                held: list[tuple[int, int]] = []
                for i, span in enumerate(batches):
                    held.append(span)
                    if i + 1 == len(batches) or sum(b - a for a, b in held) >= self.bytes:
                        out.append(Range(path, i + 1 - len(held), i + 1, heads + held))
                        held = []
        return out or [Range(self.path, 0, 0, [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        names = [f.name for f in self.schema.fields]
        target = to_arrow_schema(self.schema)
        with _opened(partition.path) as f:
            if partition.spans is None:
                every = pa.ipc.open_file(f).schema.names
                options = pa.ipc.IpcReadOptions(included_fields=[every.index(n) for n in names])
                reader = pa.ipc.open_file(f, options=options)
                batches = (reader.get_batch(i) for i in range(partition.first, partition.last))
            else:
                parts = [f.read_at(hi - lo, lo) for lo, hi in partition.spans]
                data = pa.BufferReader(b"".join(parts) + MARK + bytes(4))
                every = pa.ipc.read_schema(pa.BufferReader(parts[0])).names
                batches = iter(pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(included_fields=[every.index(n) for n in names])))
            for batch in batches:
                cols = [batch.column(n) for n in names]
                cols = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in cols]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, target, strict=True)], schema=target)


class ArrowSource(DataSource):
    """Options: ``path``, ``partitionBytes``.  A schema given to the reader chooses columns."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        found = arrow_schema(self.options["path"])
        plain = pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type, f.nullable) for f in found])
        return from_arrow_schema(plain)

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(schema, dict(self.options))


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, partition_bytes: int = 64 << 20) -> DataFrame:
    """Rows of a saved dataset folder or one Arrow file; of ``columns`` those that exist are
    decoded."""
    spark.dataSource.register(ArrowSource)
    reader = spark.read.format("arrow_ipc").option("partitionBytes", partition_bytes)
    if columns is not None:
        whole = ArrowSource({"path": path}).schema()
        reader = reader.schema(StructType([f for f in whole.fields if f.name in columns]))
    return reader.load(path)
