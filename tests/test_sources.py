"""Arrow, safetensors and packed token files; batches by rank and epoch."""

import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecmill.operators import merge as G
from vecmill.operators import training as T
from vecmill.sources import arrow as A
from vecmill.sources import packed as K
from vecmill.sources import safetensors as N


def saved(folder, streams=True):
    """A saved dataset of two shards: streams, as datasets are saved, or files with a footer."""
    folder.mkdir()
    kind = pa.schema([("doc_id", pa.int64()), ("query", pa.string()), ("lang", pa.dictionary(pa.int32(), pa.string())), ("image", pa.struct([("bytes", pa.binary()), ("path", pa.string())])), ("negs", pa.list_(pa.int64())), ("score", pa.float32())])
    at = 0
    for shard in range(2):
        with (pa.OSFile(f"{folder}/data-0000{shard}-of-00002.arrow", "wb")) as sink, (pa.ipc.new_stream if streams else pa.ipc.new_file)(sink, kind) as w:
            for n in (3, 0, 5):
                i = range(at, at + n)
                lang = pa.DictionaryArray.from_arrays(pa.array([x % 2 for x in i], pa.int32()), ["de", "fr"])
                w.write_batch(pa.record_batch([pa.array(i, pa.int64()), pa.array([None if x == 1 else f"q{x}" for x in i], pa.string()), lang, pa.array([{"bytes": bytes([x]) * 50, "path": None} for x in i], kind.field("image").type), pa.array([[x, x + 1] for x in i], pa.list_(pa.int64())), pa.array([x / 2 for x in i], pa.float32())], schema=kind))
                at += n
    (folder / "state.json").write_text("{}")
    return f"{folder}"


@pytest.mark.parametrize("streams", [True, False])
def test_saved_dataset_equals_its_parquet_twin(spark, tmp_path, streams):
    path = saved(tmp_path / "data", streams)
    df = A.read_arrow(spark, path, partition_bytes=200)
    df.write.parquet(f"{tmp_path}/twin")
    told = lambda x: sorted((str(r) for r in x.collect()))
    assert df.count() == 16 and told(df) == told(spark.read.parquet(f"{tmp_path}/twin").select(df.columns))
    assert df.schema["image"].dataType.simpleString() == "struct<bytes:binary,path:string>" and df.schema["lang"].dataType.simpleString() == "string"
    few = A.read_arrow(spark, f"file://{path}", ["score", "doc_id"], 200)
    assert sorted(few.columns) == ["doc_id", "score"] and few.rdd.getNumPartitions() >= 4
    assert {r.doc_id: r.score for r in few.collect()} == {i: i / 2 for i in range(16)}
    assert A.read_arrow(spark, f"{path}/data-00001-of-00002.arrow").count() == 8


def test_damaged_arrow_files(spark, tmp_path):
    path = saved(tmp_path / "data")
    file = tmp_path / "data" / "data-00001-of-00002.arrow"
    file.write_bytes(file.read_bytes()[:-200])
    with pytest.raises(Exception, match="ends in"):
        A.read_arrow(spark, path).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no .arrow files"):
        A.read_arrow(spark, f"{tmp_path}/none").collect()


def tensor_file(path, tensors):
    told, data = {"__metadata__": {"format": "pt"}}, b""
    for name, (kind, shape, raw) in tensors.items():
        told[name] = {"dtype": kind, "shape": shape, "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    head = json.dumps(told).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + data)
    return f"{path}"


def test_arms_merge_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    a, b = ({"w": rng.normal(size=(7, 11)), "b": rng.normal(size=13), "scale": np.array(1.5 + k), "none": np.zeros((0, 4))} for k in range(2))
    kinds = {"w": "F32", "b": "BF16", "scale": "F16", "none": "F32"}
    paths = {arm: tensor_file(tmp_path / f"{arm}.safetensors", {n: (kinds[n], list(x.shape), N.encoded(x.ravel(), kinds[n])) for n, x in tensors.items()}) for arm, tensors in (("a", a), ("b", b))}
    runs = N.read_safetensors(spark, paths, run=10)
    stored = {(r.arm, r.param, r.start): r["values"] for r in runs.collect()}
    assert len(stored) == 2 * (8 + 2 + 1) and len(stored["a", "w", 70]) == 7
    want = np.float32(a["w"]).ravel().astype(float)
    assert sum((stored["a", "w", i] for i in range(0, 77, 10)), []) == want.tolist()
    weights = {"a": 1.0, "b": 3.0}
    single = {(r.param, r.idx): r.value for r in G.weighted_merge(N.elements(runs), weights).collect()}
    merged = N.merged_runs(runs, weights)
    assert {(r.param, r.idx): r.value for r in N.elements(merged).collect()} == pytest.approx(single) and len(single) == 77 + 13 + 1
    shapes = {n: ("F64", list(x.shape)) for n, x in a.items()}
    names = N.write_safetensors(merged, shapes, f"{tmp_path}/out", shard_bytes=300)
    assert len(names) == 2 and not [x for x in (tmp_path / "out").iterdir() if x.name.startswith(".model-")]
    back = {(r.param, r.idx): r.value for n in names for r in N.elements(N.read_safetensors(spark, {"m": f"{tmp_path}/out/{n}"}, 16)).collect()}
    assert back == pytest.approx(single)
    index = json.loads((tmp_path / "out" / "model.safetensors.index.json").read_text())
    assert set(index["weight_map"]) == set(shapes) and index["metadata"]["total_size"] == 8 * 91
    assert {r.param for n in names for r in N.tensors(spark, {"m": f"{tmp_path}/out/{n}"}).collect()} == set(shapes)


def test_broken_weights_are_errors(spark, tmp_path):
    good = tensor_file(tmp_path / "g", {"x": ("F32", [4], np.arange(4, dtype="<f4").tobytes())})
    data = (tmp_path / "g").read_bytes()
    for name, bad, what in (("t", data[:-1], "truncated"), ("h", data[:20], "head"), ("s", data[:5], "head"), ("j", struct.pack("<Q", 4) + b"nope", "JSON")):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(ValueError, match=what):
            N.read_safetensors(spark, {"a": f"{tmp_path}/{name}"})
    wide = tensor_file(tmp_path / "w", {"x": ("F32", [5], bytes(16))})
    with pytest.raises(ValueError, match="shape"):
        N.read_safetensors(spark, {"a": wide})
    runs = N.read_safetensors(spark, {"a": good}, 2).select("param", "start", "values")
    for rows in (runs.where("start = 0"), runs.unionByName(runs)):
        with pytest.raises(Exception, match="lacks elements|no or two elements"):
            N.write_safetensors(rows, {"x": ("F32", [4])}, f"{tmp_path}/o")
    with pytest.raises(Exception, match="without a shape"):
        N.write_safetensors(runs, {"y": ("F32", [4])}, f"{tmp_path}/p")
    other = tensor_file(tmp_path / "u", {"x": ("F32", [3], bytes(12))})
    with pytest.raises(Exception, match="arms differ"):
        N.merged_runs(N.read_safetensors(spark, {"a": good, "b": other}), {"a": 1.0, "b": 1.0}).collect()


@pytest.mark.parametrize("kind", ["BF16", "F16", "F32", "F64", "I8", "I64"])
def test_elements_survive(kind):
    x = np.array([0, 1, -2, 3, 100, -128, 127], float)
    assert N.decoded(N.encoded(x, kind), kind).tolist() == x.tolist()
    if kind == "BF16":  # halves go to the even neighbour, what is no number stays so
        assert N.decoded(N.encoded(np.array([1.00390625, 1.01171875, np.inf]), kind), kind).tolist() == [1.0, 1.015625, np.inf]
        assert np.isnan(N.decoded(N.encoded(np.array([np.nan]), kind), kind)[0])


def test_packed_tokens_read_only_their_blocks(spark, tmp_path):
    rng = random.Random(4)
    bags = [(f"d{i}", [[float(np.float16(rng.uniform(-1, 1))) for _ in range(8)] for _ in range(rng.randrange(0, 6))]) for i in range(300)] + [("null", None)]
    df = spark.createDataFrame(bags, "doc_id string, tokens array<array<double>>").repartition(3)
    index = K.write_packed(df, f"{tmp_path}/p", block_bytes=500)
    assert index.count() == 301 and index.select("file").distinct().count() == 3
    assert {r.doc_id: r.tokens for r in K.read_packed(spark, f"{tmp_path}/p").collect()} == {k: v or [] for k, v in bags}
    some = spark.createDataFrame([("d5",), ("d5",), ("d250",), ("gone",)], "doc_id string")
    counter = spark.sparkContext.accumulator(0)
    got = {r.doc_id: r.tokens for r in K.read_packed(spark, f"{tmp_path}/p", some, counter).collect()}
    assert got == {k: v for k, v in bags if k in ("d5", "d250")}
    blocks = index.where(F.col("doc_id").isin("d5", "d250")).select("file", "at", "bytes").distinct().collect()
    whole = sum(f.stat().st_size for f in (tmp_path / "p" / "blocks").iterdir() if f.name.endswith(".tok"))
    assert counter.value == sum(b.bytes for b in blocks) < whole / 10
    hit = index.where("doc_id = 'd5'").first()
    file = tmp_path / "p" / "blocks" / hit.file
    data = bytearray(file.read_bytes())
    data[hit.at] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged block"):
        K.read_packed(spark, f"{tmp_path}/p", some).collect()
    for bad, what in (([[1.0], [1.0, 2.0]], "several widths"), ([[1e6]], "half precision")):
        with pytest.raises(Exception, match=what):
            K.write_packed(spark.createDataFrame([("x", bad)], "doc_id string, tokens array<array<double>>"), f"{tmp_path}/bad{len(bad)}")


def test_ranks_read_their_slices_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([(i, "abc"[min(i % 5, 2)]) for i in range(200)], "doc_id long, task_id string")
    path = f"{tmp_path}/batches"
    for epoch in range(2):
        T.write_rank_batches(rows, path, 16, 4, 9, "doc_id", epoch, files_a_rank=2, shard_rows=3)
    table = spark.read.parquet(path)
    slices = [T.read_rank(table, r, 0).collect() for r in range(4)]
    plan = T.read_rank(table, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "rank" in plan[plan.index("PartitionFilters") : plan.index("PartitionFilters") + 200]
    n = sum(c // 16 for c in (40, 40, 120))
    seen = {}
    for r, own in enumerate(slices):
        assert [(x.epoch, x.batch_no, x.batch_slot) for x in own] == [(e, b, s) for e in range(2) for b in range(n) for s in range(4)]
        for x in own:
            seen.setdefault((x.epoch, x.batch_no), []).append((r, x.batch_slot, x.task_id, x.doc_id))
    whole = T.rank_batches(rows, 16, 4, 9, "doc_id", 0, shard_rows=3).collect()
    for e in range(2):
        ids = [x[3] for b in range(n) for x in seen[e, b]]
        assert len(set(ids)) == len(ids) == 16 * n and all(len({x[2] for x in seen[e, b]}) == 1 for b in range(n))
    assert sorted((x.batch_no, x.rank, x.batch_slot, x.doc_id) for x in whole) == sorted((b, r, s, i) for (e, b), v in seen.items() if e == 0 for r, s, _, i in v)
    assert [x[3] for b in range(n) for x in seen[0, b]] != [x[3] for b in range(n) for x in seen[1, b]]
    rest = T.read_rank(table, 2, 0, 5).collect()
    assert rest == slices[2][5 * 4 :]
    full = T.rank_batches(rows.where("doc_id < 3"), 16, 4, 9, "doc_id", drop_last=False).groupBy("batch_no", "rank").count().collect()
    assert sorted((r.batch_no, r.rank, r["count"]) for r in full) == [(b, r, 4) for b in range(3) for r in range(4)]
    with pytest.raises(ValueError, match="alike"):
        T.rank_batches(rows, 16, 3, 9, "doc_id")
