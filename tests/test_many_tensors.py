"""Weights of many small tensors, in several files."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vecmill.sources import files as X
from vecmill.sources import safetensors as N


class Counted(dict):
    reads = 0

    def __getitem__(self, key):
        self.reads += 1
        return super().__getitem__(key)


def test_sharding_is_one_pass():
    sizes = Counted({f"t{i:05d}": 8 + i % 3 for i in range(5000)})
    groups = N.shards(sizes, 40)
    assert sum(groups, []) == sorted(sizes) and sizes.reads <= len(sizes)
    for group, after in zip(groups, groups[1:], strict=False):
        assert (held := sum(dict(sizes)[p] for p in group)) <= 40 < held + dict(sizes)[after[0]]
    assert N.shards({"a": 50, "b": 1}, 40) == [["a"], ["b"]] and N.shards({}, 40) == [[]]


def test_whole_tensors_are_cut_and_read_back_from_all_shards(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    arrays = {f"{i % 7}.{i}": rng.normal(size=1 + i % 9).tolist() for i in range(300)} | {"none": []}
    rows = spark.createDataFrame(pa.table({"param": list(arrays), "values": pa.array(arrays.values(), pa.list_(pa.float64()))}))
    runs = N.cut(rows, 4)
    single = rows.select("param", F.posexplode("values").alias("idx", "value"))
    key = lambda df: sorted((r.param, r.start, r["values"]) for r in df.collect())
    assert key(runs) == key(N.runs_of(single, 4))
    names = N.write_safetensors(runs, {p: ("F64", [len(v)]) for p, v in arrays.items()}, f"{tmp_path}/w", shard_bytes=4000)
    assert len(names) > 2
    monkeypatch.setattr(N, "BATCH", 50)
    back = N.read_safetensors(spark, {"m": [f"{tmp_path}/w/{n}" for n in names]}, 3)
    assert {(r.param, r.idx): r.value for r in N.elements(back).collect()} == {(p, i): x for p, v in arrays.items() for i, x in enumerate(v)}


def test_head_bytes_are_those_of_the_file(spark, tmp_path):
    (tmp_path / "f").write_bytes(data := bytes(range(256)) * 3 + b"\r\n\\n\xff\x00")
    for n in (0, 8, 300, len(data), len(data) + 9):
        assert X.head_bytes(spark, f"{tmp_path}/f", n) == data[:n]
