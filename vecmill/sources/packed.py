"""Token bags as ragged half-precision blocks with an index.

A task writes one file of blocks, each the vectors of some documents one after the other;
the index (Parquet) tells for each document its block and place in it.  A reader opens only
the files, and reads only the blocks, of the documents that are asked for, each block once.
No row holds more than a document.

    <path>/blocks/<name>.tok      <path>/index (doc_id, file, at, bytes, check, start, n_tokens, dim)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .files import arrow_fs, folder

_COLUMNS = "file string, at long, bytes long, check long, start long, n_tokens int, dim int"


def _flat(bag: pa.ListScalar) -> tuple[np.ndarray, int, int]:
    """Components, tokens and width of a bag; its vectors must be of one width."""
    vectors = bag.values
    if vectors is None or not len(vectors):
        return np.zeros(0, "<f2"), 0, 0
    width = np.asarray(vectors.value_lengths().fill_null(-1))
    if (width != width[0]).any() or width[0] < 0:
        raise ValueError("a bag with vectors of several widths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype("<f2"), len(vectors), int(width[0])


def write_packed(bags: DataFrame, path: str, block_bytes: int = 1 << 20) -> DataFrame:
    """Write ``doc_id, tokens`` below ``path`` and return the index.  Empty and null bags have
    no tokens; components beyond the range of half precision are an error."""
    spark = bags.sparkSession
    blocks = folder(spark, f"{path}/blocks")
    id_type = to_arrow_type(bags.schema["doc_id"].dataType)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = arrow_fs(blocks)
        name, at, out, draft = f"{uuid.uuid4().hex}.tok", 0, None, ""
        held: list[tuple] = []
        parts: list[bytes] = []
        size = 0
        done: list[pa.RecordBatch] = []

        def flush() -> None:
            nonlocal held, parts, size, at, out, draft
            if not held:
                return
            if out is None:
                draft = f"{base}/.{name}"
                out = fs.open_output_stream(draft)
            data = b"".join(parts)
            out.write(data)
            check, n = zlib.crc32(data), len(held)
            cols = list(zip(*held, strict=True))
            done.append(pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array([name] * n), pa.array([at] * n, pa.int64()), pa.array([len(data)] * n, pa.int64()), pa.array([check] * n, pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["doc_id", "file", "at", "bytes", "check", "start", "n_tokens", "dim"]))
            at, held, parts, size = at + len(data), [], [], 0

        for batch in batches:
            for doc, bag in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat, n, dim = _flat(bag)
                if not np.isfinite(flat).all():
                    raise ValueError(f"a component of {doc} is beyond half precision")
                held.append((doc, size, n, dim))
                parts.append(flat.tobytes())
                size += 2 * len(flat)
                if size >= block_bytes:
                    flush()
        flush()
        if out is not None:
            out.close()
            fs.move(draft, f"{base}/{name}")
        yield from done  # the index of a file follows when the file is whole

    kind = bags.schema["doc_id"].dataType.simpleString()
    bags.select("doc_id", "tokens").mapInArrow(write, f"doc_id {kind}, {_COLUMNS}").write.mode("errorifexists").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_packed(spark: SparkSession, path: str, docs: DataFrame | None = None, read_bytes=None) -> DataFrame:
    """``doc_id, tokens`` of all documents, or of those in ``docs`` (``doc_id``).

    Blocks are dealt by file and place, so a block is read by one task, once; a damaged
    block is an error.  ``read_bytes`` is an accumulator that counts what is read."""
    index = spark.read.parquet(f"{path}/index")
    if docs is not None:
        index = index.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    blocks = folder(spark, f"{path}/blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = index.repartition(parts, "file", "at").sortWithinPartitions("file", "at", "start")
    id_type = to_arrow_type(index.schema["doc_id"].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs(blocks)
        path_, file, block, data = None, None, None, b""
        for batch in batches:
            ids, rows, width = [], [], []
            col = [batch[n].to_pylist() for n in ("doc_id", "file", "at", "bytes", "check", "start", "n_tokens", "dim")]
            for doc, name, at, size, check, start, n, dim in zip(*col, strict=True):
                if name != path_:
                    path_, file, block = name, fs.open_input_file(f"{base}/{name}"), None
                if at != block:
                    block, data = at, file.read_at(size, at)
                    if read_bytes is not None:
                        read_bytes.add(len(data))
                    if len(data) != size or zlib.crc32(data) != check:
                        raise OSError(f"a damaged block in {name} at {at}")
                ids.append(doc)
                rows.append(np.frombuffer(data, "<f2", n * dim, start).astype(np.float32))
                width.append((n, dim))
            if not ids:
                continue
            flat = np.concatenate(rows)
            inner = np.concatenate(([0], np.cumsum(np.concatenate([np.full(n, d, np.int64) for n, d in width])))).astype(np.int32)
            outer = np.concatenate(([0], np.cumsum([n for n, _ in width]))).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), tokens], names=["doc_id", "tokens"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(read, f"doc_id {kind}, tokens array<array<float>>")
