"""Weights in the safetensors format: read as ranges of bytes, written in shards.

The driver reads heads only.  A row is a run of elements of one tensor (``param, start,
values``), so tensors are decoded, merged and written as arrays and no task holds a whole
model.  A file ends where its head says, else it is an error.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .files import arrow_fs, folder, head_bytes, qualified

#: Bytes of an element by type (fixed values of the format).
WIDTH = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1}
_NUMPY = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1"}
LONGEST_HEAD = 100_000_000
BATCH = 1 << 20  # elements that a reading task returns at a time, about


def decoded(raw: bytes, kind: str) -> np.ndarray:
    """Elements as doubles."""
    if kind == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    return np.frombuffer(raw, _NUMPY[kind]).astype(np.float64)


def encoded(values: np.ndarray, kind: str) -> bytes:
    """Doubles as elements, rounded to the nearest (ties to even)."""
    if kind == "BF16":
        bits = values.astype(np.float32).view(np.uint32).astype(np.uint64)
        nan = np.isnan(values)
        near = ((bits + 0x7FFF + ((bits >> np.uint64(16)) & np.uint64(1))) >> np.uint64(16)).astype("<u2")
        return np.where(nan, np.uint16(0x7FC0), near).astype("<u2").tobytes()
    whole = values if kind.startswith("F") else np.rint(values)
    return whole.astype(_NUMPY[kind]).tobytes()


def head(spark: SparkSession, path: str) -> tuple[str, int, dict]:
    """(address, where the data begins, tensors by name) of a file, checked against its size."""
    address, size = qualified(spark, path)
    first = head_bytes(spark, path, 8)
    n = struct.unpack("<Q", first)[0] if len(first) == 8 else -1
    if not 2 <= n <= min(LONGEST_HEAD, size - 8):
        raise ValueError(f"{path}: no head, or a truncated one")
    try:
        told = json.loads(head_bytes(spark, path, 8 + n)[8:])
    except ValueError:
        raise ValueError(f"{path}: the head is no JSON") from None
    told.pop("__metadata__", None)
    at = 0
    for name, t in sorted(told.items(), key=lambda x: x[1]["data_offsets"]):
        lo, hi = t["data_offsets"]
        if t["dtype"] not in WIDTH:
            raise ValueError(f"{path}: {name} is of type {t['dtype']}")
        if lo != at or hi - lo != math.prod(t["shape"]) * WIDTH[t["dtype"]]:
            raise ValueError(f"{path}: the bytes of {name} do not fit its shape")
        at = hi
    if 8 + n + at != size:
        raise ValueError(f"{path}: {size} bytes, {8 + n + at} expected (truncated?)")
    return address, 8 + n, told


_TENSORS = pa.schema([("arm", pa.string()), ("param", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("n", pa.int64()), ("file", pa.string()), ("at", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


def _listed(spark: SparkSession, arm: str, path: str) -> pa.Table:
    address, data, told = head(spark, path)
    return _table([(arm, name, t["dtype"], t["shape"], math.prod(t["shape"]), address, data + t["data_offsets"][0]) for name, t in told.items()], _TENSORS)


def tensors(spark: SparkSession, paths: dict[str, str | list[str]]) -> DataFrame:
    """``arm, param, dtype, shape, n, file, at`` of the tensors of several files, one or more
    (shards) an arm."""
    files = [(arm, path) for arm, own in paths.items() for path in ([own] if isinstance(own, str) else own)]
    return spark.createDataFrame(pa.concat_tables([_TENSORS.empty_table(), *(_listed(spark, arm, path) for arm, path in files)]))


def read_safetensors(spark: SparkSession, paths: dict[str, str | list[str]], run: int = 1 << 16) -> DataFrame:
    """``arm, param, start, values`` (doubles): runs of ``run`` elements, the last of a tensor
    may be shorter.  An empty tensor has no rows.  A task reads a file in the order of its
    bytes and returns many short runs at a time."""
    runs = tensors(spark, paths).where("n > 0").select("arm", "param", "dtype", "n", "file", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))).alias("start"))
    runs = runs.select("arm", "param", "start", "dtype", F.least(F.lit(run), F.col("n") - F.col("start")).cast("long").alias("count"), "file", "at")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            arms, params, starts, values = zip(*held, strict=True)
            ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
            return pa.RecordBatch.from_arrays([pa.array(arms), pa.array(params), pa.array(starts, pa.int64()), runs], names=["arm", "param", "start", "values"])

        for batch in batches:
            for arm, param, start, kind, n, where, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != path:
                    fs, name = arrow_fs(where)
                    path, file = where, fs.open_input_file(name)
                raw = file.read_at(n * WIDTH[kind], at + start * WIDTH[kind])
                if len(raw) != n * WIDTH[kind]:
                    raise OSError(f"{where} ends inside {param}")
                held.append((arm, param, start, decoded(raw, kind)))
                size += n
                if size >= BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return runs.repartition(parts, "file", "param", "start").sortWithinPartitions("file", "at", "start").mapInArrow(read, "arm string, param string, start long, values array<double>")


def elements(runs: DataFrame) -> DataFrame:
    """``param, idx, value`` (and ``arm``): a row an element, for what works on single ones."""
    arm = ["arm"] if "arm" in runs.columns else []
    return runs.select(*arm, "param", "start", F.posexplode("values").alias("pos", "value")).select(*arm, "param", (F.col("start") + F.col("pos")).alias("idx"), "value")


def cut(arrays: DataFrame, run: int = 1 << 16) -> DataFrame:
    """``param, start, values`` of whole tensors ``param, values``."""
    starts = F.sequence(F.lit(0).cast("long"), F.size("values").cast("long") - 1, F.lit(run).cast("long"))
    rows = arrays.where(F.size("values") > 0).select("param", F.explode(starts).alias("start"), "values")
    return rows.select("param", "start", F.slice("values", (F.col("start") + 1).cast("int"), F.lit(run)).alias("values"))


def runs_of(values: DataFrame, run: int = 1 << 16) -> DataFrame:
    """``param, start, values`` of single elements ``param, idx, value``."""
    start = (F.floor(F.col("idx") / run) * run).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value"))))
    return values.groupBy("param", start.alias("start")).agg(F.transform(rows, lambda r: r["value"]).alias("values"))


def merged_runs(runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``param, start, values``: the arms' weighted mean, run by run (a group is as many rows as
    there are arms).  Arms must have the same tensors, cut alike."""
    if not weights or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be positive in sum and not negative")
    total = sum(weights.values())
    share = F.create_map(*[x for arm, w in weights.items() for x in (F.lit(arm), F.lit(w / total))])
    group = runs.where(F.col("arm").isin(list(weights))).groupBy("param", "start").agg(F.sort_array(F.collect_list(F.struct("arm", "values"))).alias("arms"))
    same = (F.size("arms") == len(weights)) & (F.array_min(F.transform("arms", lambda a: F.size(a["values"]))) == F.array_max(F.transform("arms", lambda a: F.size(a["values"]))))
    checked = group.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("the arms differ in "), "param")).cast("boolean")))
    scaled = F.transform("arms", lambda a: F.transform(a["values"], lambda x: x * F.element_at(share, a["arm"])))
    return checked.select("param", "start", F.aggregate(F.slice(scaled, 2, len(weights)), F.element_at(scaled, 1), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y)).alias("values"))


def shards(sizes: dict[str, int], shard_bytes: int) -> list[list[str]]:
    """Tensors by name in groups of at most so many bytes (or one tensor); one pass."""
    groups: list[list[str]] = [[]]
    filled = 0
    for p, size in sorted(sizes.items()):
        if groups[-1] and filled + size > shard_bytes:
            groups.append([])
            filled = 0
        groups[-1].append(p)
        filled += size
    return groups


def write_safetensors(runs: DataFrame, shapes: dict[str, tuple[str, list[int]]], path: str, shard_bytes: int = 4 << 30) -> list[str]:
    """Write ``param, start, values`` as shards ``model-<i>-of-<n>.safetensors`` and their index
    below ``path``; the shards' names.  ``shapes`` gives type and shape of every tensor.

    A shard is one task's file, written in the order of its bytes, so memory is a run; it
    takes its name when it is whole, so a task may be repeated.  Missing, doubled or strange
    elements are an error."""
    spark = runs.sparkSession
    sizes = {p: math.prod(s) * WIDTH[k] for p, (k, s) in shapes.items()}
    groups = shards(sizes, shard_bytes)
    top = folder(spark, path)
    names = [f"model-{i + 1:05d}-of-{len(groups):05d}.safetensors" for i in range(len(groups))]
    heads = []
    for group in groups:
        told, at = ['"__metadata__":{"format":"pt"}'], 0
        for p in group:
            entry = {"dtype": shapes[p][0], "shape": list(shapes[p][1]), "data_offsets": [at, at + sizes[p]]}
            told.append(f"{json.dumps(p)}:{json.dumps(entry, separators=(',', ':'))}")
            at += sizes[p]
        text = f"{{{','.join(told)}}}".encode()
        heads.append(text + b" " * (-len(text) % 8))
    places = [(i, p, n, shapes[p][0], sizes[p]) for i, g in enumerate(groups) for n, p in enumerate(g)]
    listed = spark.createDataFrame(_table(places, pa.schema([("shard", pa.int32()), ("param", pa.string()), ("place", pa.int32()), ("dtype", pa.string()), ("bytes", pa.int64())])))
    # One row without values for each tensor, so that empty ones and their shards exist.
    marks = listed.select("param", F.lit(-1).cast("long").alias("start"), F.lit(None).cast("array<double>").alias("values"))
    every = runs.select("param", "start", F.col("values").cast("array<double>").alias("values")).unionByName(marks)
    rows = every.join(F.broadcast(listed), "param", "left")  # as many rows as tensors
    rows = rows.withColumn("shard", F.when(F.col("shard").isNull(), F.raise_error(F.concat(F.lit("a tensor without a shape: "), "param")).cast("int")).otherwise(F.col("shard")))
    dealt = rows.repartition(len(groups), "shard").sortWithinPartitions("shard", "place", "start")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = arrow_fs(top)
        now, out, draft, expect = None, None, "", []

        def close() -> pa.RecordBatch | None:
            if now is None:
                return None
            if expect[0][1]:
                raise ValueError(f"{expect[0][0]} lacks elements")
            out.close()
            fs.move(draft, f"{base}/{names[now]}")
            return pa.RecordBatch.from_arrays([pa.array([names[now]])], names=["name"])

        for batch in batches:
            col = {n: batch[n].to_pylist() for n in ("shard", "param", "start", "dtype", "bytes")}
            values = batch["values"]
            for k in range(batch.num_rows):
                if col["shard"][k] != now:
                    if (done := close()) is not None:
                        yield done
                    now = col["shard"][k]
                    draft = f"{base}/.{names[now]}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(draft, buffer_size=1 << 20)
                    out.write(struct.pack("<Q", len(heads[now])) + heads[now])
                    expect = [("", 0)]
                param, start = col["param"][k], col["start"][k]
                if start < 0:
                    if expect[0][1]:
                        raise ValueError(f"{expect[0][0]} lacks elements")
                    expect = [(param, col["bytes"][k])]
                    continue
                width = WIDTH[col["dtype"][k]]
                own = values[k].values.to_numpy(zero_copy_only=False)
                if expect[0] != (param, col["bytes"][k] - start * width) or len(own) * width > expect[0][1]:
                    raise ValueError(f"{param} has no or two elements at {start}")
                out.write(encoded(own, col["dtype"][k]))
                expect = [(param, expect[0][1] - len(own) * width)]
        if (done := close()) is not None:
            yield done

    written = sorted(r.name for r in dealt.select("shard", "param", "start", "dtype", "bytes", "values").mapInArrow(write, "name string").collect())  # a row a shard
    if written != names:
        raise OSError(f"shards {sorted(set(names) - set(written))} were not written")
    index = {"metadata": {"total_size": sum(sizes.values())}, "weight_map": {p: names[i] for i, g in enumerate(groups) for p in g}}
    sinks.write_json(spark, f"{path}/model.safetensors.index.json", index)
    return names
