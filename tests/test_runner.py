"""Task runs that survive failures, claims of several drivers, tiles, late reading."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F
from test_evaluation import encoders, put, root  # noqa: F401

from vecmill.operators import evaluate as E
from vecmill.operators import maxsim as M
from vecmill.operators import metrics as R
from vecmill.operators import runner as N
from vecmill.operators import summary as Y
from vecmill.operators import training as T
from vecmill.sources import tables as S


@pytest.fixture()
def broken(spark, root):  # noqa: F811
    """The catalogue with one corpus that is no Parquet."""
    from pathlib import Path

    bad = Path(root.removeprefix("file://")) / "eval/s0/data/test-0.parquet"
    bad.parent.mkdir(parents=True)
    bad.write_bytes(b"no parquet")
    return S.discover_tasks(spark, root)


def test_a_broken_task_costs_itself_only(spark, broken, tmp_path):
    pages, asked = encoders(spark)
    folder, seen = f"file://{tmp_path}/run", []
    got = N.run_tasks(spark, broken, pages, asked, folder, "p", "c", workers=3, on_done=lambda r: seen.append(r["task"])).collect()
    assert [r.task for r in got] == [N.tag_of(t) for t in broken] and len(seen) == 6
    by = {r.task: r for r in got}
    assert by["eval/s0"].error and by["eval/s0"].n_queries is None
    good = by["eval/s3"]
    assert good.error is None and (good.n_docs, good.n_queries) == (3, 3) and good.ndcg_at_1 == pytest.approx(2 / 3) and good.seconds > 0
    seen.clear()
    N.run_tasks(spark, broken, pages, asked, folder, "p", "c", on_done=lambda r: seen.append(r["task"]))
    assert seen == ["eval/s0"]  # the second run repeats only what failed
    put(spark.createDataFrame([("a", "p_a")], "query string, image_filename string"), f"{tmp_path}/eval/s0/data/test-0.parquet")
    seen.clear()
    fixed = {r.task: r for r in N.run_tasks(spark, broken, pages, asked, folder, "p", "c", on_done=lambda r: seen.append(r["task"])).collect()}
    assert seen == ["eval/s0"] and fixed["eval/s0"].error is None and fixed["eval/s0"].recall_at_1 == 1.0
    seen.clear()
    few = [t for t in broken if t["subset"] == "s3"]
    N.run_tasks(spark, few, pages, asked, folder, "p", "other contract", on_done=lambda r: seen.append(r["task"]))
    assert seen == ["eval/s3"]


def test_claims_are_exclusive_and_expire(spark, tmp_path):
    a, b = (N.Claims(spark, f"file://{tmp_path}/claims", o, lease=1.5) for o in "ab")
    number = a.take("t.x")
    assert number == 0 and b.take("t.x") is None and b.take("t") == 0
    with a.kept("t.x", number):  # renewed while it works
        time.sleep(3)
        assert b.take("t.x") is None
    time.sleep(2.5)  # a killed driver's claim runs out
    assert b.take("t.x") == 1 and not a.holds("t.x", 0) and b.holds("t.x", 1) and a.take("t.x") is None
    b.release("t.x", 1)
    assert a.take("t.x") == 2


def test_two_drivers_do_each_task_once_and_one_finalises(spark, broken, tmp_path):
    import threading

    pages, asked = encoders(spark)
    folder, seen = f"file://{tmp_path}/run", []
    own = [N.Claims(spark, f"{folder}/claims", o, lease=60) for o in "ab"]
    assert N.finalise(spark, folder, broken, "run", own[0], "p", "c") is None
    threads = [threading.Thread(target=lambda c=c: N.run_tasks(spark, broken, pages, asked, folder, "p", "c", workers=2, claims=c, on_done=lambda r: seen.append(r["task"]) if not r["error"] else None)) for c in own]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(seen) == sorted(N.tag_of(t) for t in broken if t["subset"] != "s0")
    found = [N.finalise(spark, folder, broken, "run", c, "p", "c") for c in own]
    assert found[0]["status"] == "partial" and found[0]["n_failed"] == 1 and found[0]["completed_tasks"] == 5 and found[1] is None
    assert json.loads((tmp_path / "run" / "summary.json").read_text())["failed_tasks"][0]["task"] == "eval/s0"


def test_no_row_of_zeros(spark):
    pages, asked = encoders(spark)
    rows = spark.createDataFrame([("a", "p_a", 0), ("none", "p_b", 1)], "query string, image_filename string, ord long")
    assert E.evaluate_paired(rows, pages, asked).first().n_queries == 1
    for bad, what in ((rows.where("ord = 1"), "no query"), (rows.where("ord > 5"), "no page")):
        with pytest.raises(Exception, match=what):
            E.evaluate_paired(bad, pages, asked).collect()
    corpus = spark.createDataFrame([("x_a", 0)], "id string, ord long")
    q = spark.createDataFrame([("1", "a", 0)], "id string, text string, ord long")
    judged = spark.createDataFrame([("1", "gone", 1.0, 0)], "`query-id` string, `corpus-id` string, score double, ord long")
    with pytest.raises(Exception, match="judged page"):
        E.evaluate_beir(corpus, q, judged, pages, asked).collect()


def test_failed_tasks_are_not_in_the_means(spark):
    listed = S.catalogue(spark, [{"dataset": "eval", "subset": s, "fmt": "paired", "lang": None, "corpus_key": s, "corpus": [s]} for s in "xy"])
    rows = spark.createDataFrame([("eval/x", "eval", 1, 1, None, 0.0), ("eval/y", "eval", 1, 1, "stale", 1.0)], "task string, dataset string, n_queries long, n_docs long, error string, m double")
    (board,) = Y.boards(rows, listed, ["m"]).collect()
    assert (board.n_subsets, board.m) == (1, 0.0)
    assert Y.boards(rows.drop("error"), listed, ["m"]).first().m == 0.5


def test_every_row_of_oddly_named_files(spark, tmp_path):
    names = ["test-z.parquet", "test-a b.parquet", "test-ü%+#.parquet", "two/test-z.parquet", "empty.parquet"]
    for i, n in enumerate(names):
        put(spark.range(i * 3, i * 3 + (0 if n == "empty.parquet" else 3)), f"{tmp_path}/{n}")
    got = S.read_rows(spark, [f"file://{tmp_path}/{n}" for n in names]).collect()
    assert {r.id: r.ord for r in got} == {i: i for i in range(12)}
    assert S.read_rows(spark, [f"{tmp_path}/{names[1]}"]).count() == 3
    with pytest.raises(ValueError, match="twice"):
        S.read_rows(spark, [f"{tmp_path}/{names[0]}", f"file://{tmp_path}/{names[0]}"])
    with pytest.raises(ValueError, match="not named"):
        S.read_rows(spark, [f"{tmp_path}/two"])


def test_short_tasks_fill_their_batch(spark):
    rows = spark.createDataFrame([(i, 0) for i in range(3)] + [(i, 1) for i in range(10, 45)], "doc_id long, task_id int")
    n = T.task_consistent_batches(rows, 16, 1, "doc_id", drop_last=False).groupBy("task_id", "batch_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("kinds")).collect()
    assert {(r.task_id, r.batch_id): (r.n, r.kinds) for r in n} == {(0, 0): (16, 3), (1, 0): (16, 16), (1, 1): (16, 16), (1, 2): (16, 16)}


@pytest.mark.parametrize("ids", ["long", "string"])
def test_tiles_equal_rows(spark, ids):
    rng = __import__("random").Random(2)
    bag = lambda n: [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(n)]
    q = spark.createDataFrame([(i, bag(rng.randrange(0, 5))) for i in range(20)] + [(99, None)], "query_id long, tokens array<array<double>>").withColumn("query_id", F.col("query_id").cast(ids))
    d = spark.createDataFrame([(i, bag(rng.randrange(0, 6))) for i in range(60)] + [(99, None)], "doc_id long, tokens array<array<float>>").withColumn("doc_id", F.col("doc_id").cast(ids))
    told = lambda df: {(r.query_id, r.doc_id): round(r.score, 5) for r in df.collect()}
    for options in ({}, {"pad_len": 4}, {"tau": 0.5}):
        assert told(M.maxsim(q, d, block=0, tile=5, **options)) == told(M.maxsim(q, d, strategy="rows", **options)) == told(M.maxsim(q, d, **options))
    top = lambda **o: {(r.query_id, r.rank): r.doc_id for r in M.maxsim(q, d, top_k=3, **o).collect()}
    assert top(block=0, tile=5) == top() == top(strategy="rows")
    assert M.maxsim(q.where("query_id is null"), d).count() == 0 == M.maxsim(q.where("query_id is null"), d, block=0).count()
    size = lambda k: len(re.findall("MapInArrow", M.maxsim(q.limit(k), d, top_k=3, block=0, tile=5)._jdf.queryExecution().executedPlan().toString()))
    assert size(2) == size(20) == 1


def test_pages_are_chosen_without_their_bytes(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("p"), F.col("id") % 7).alias("image_filename"), F.col("id").alias("ord"), F.encode(F.repeat(F.col("id").cast("string"), 50), "utf-8").alias("image"))
    rows.write.parquet(f"{tmp_path}/pages")
    got = {r.doc_id: (r.ord, bytes(r.image)) for r in S.candidate_pages(spark.read.parquet(f"{tmp_path}/pages")).collect()}
    assert got == {f"p{i}": (i, str(i).encode() * 50) for i in range(7)}
    read = spark.read.parquet(f"{tmp_path}/pages")
    for bound, joined in ((1000, "LeftSemi"), (6, "LeftSemi"), (33, "LeftSemi")):
        first = S.first_rows(read, "image_filename", "ord", bound)
        assert first.count() == 7
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert joined in plan
        if bound == 1000:  # one scan without the image feeds the shuffle, the other is not shuffled
            assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
            scans = re.findall(r"ReadSchema: (\S+)", plan)
            assert sum("image:binary" in s for s in scans) == 1 and any("image:binary" not in s for s in scans)
    most = spark.range(100).select(F.col("id").alias("key"), F.col("id").alias("ord")).unionByName(spark.range(5).select(F.col("id").alias("key"), (F.col("id") + 100).alias("ord")))
    few = S.first_rows(most, "key", "ord", 50)  # 100 chosen, 5 left out
    assert few.count() == 100 and "LeftAnti" in few._jdf.queryExecution().executedPlan().toString()
    assert R.METRICS
