"""Operators without SQL, edge cases and properties."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.functions import vectors as V
from vecmill.operators import compress as C
from vecmill.operators import losses as L
from vecmill.operators import maxsim as M
from vecmill.operators import merge as G
from vecmill.operators import metrics as R
from vecmill.operators import training as T
from vecmill.sources import sinks as W
from vecmill.sources import tables as S


def brute_ward(points, k):
    groups = [[i] for i in range(len(points))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                x, y = points[groups[a]], points[groups[b]]
                cost = len(x) * len(y) / (len(x) + len(y)) * ((x.mean(0) - y.mean(0)) ** 2).sum()
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, a, b)
        _, a, b = best
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 14), st.integers(1, 8), st.integers(0, 10_000))
def test_ward_equals_brute_force(n, k, seed):
    points = np.random.default_rng(seed).normal(size=(n, 4))
    labels = C.ward(points.copy(), k)
    assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)} == (brute_ward(points, k) if k < n else {frozenset([i]) for i in range(n)})


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 16), st.integers(1, 8), st.integers(1, 3), st.integers(0, 10_000))
def test_ward_with_ties_equals_brute_force(n, k, side, seed):
    """Small whole numbers: equal points and equal distances are exact, and many."""
    points = np.random.default_rng(seed).integers(0, side + 1, size=(n, 2)).astype(float)
    labels = C.ward(points.copy(), k)
    assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)} == (brute_ward(points, k) if k < n else {frozenset([i]) for i in range(n)})


def test_ward_of_a_large_bag_has_linear_memory():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(32, 64)) * 20
    truth = np.concatenate([np.arange(32), rng.integers(0, 32, 6000 - 32)])
    points = (centres[truth] + rng.normal(size=(6000, 64))).astype(np.float32)
    points[1000:2000] = points[1000]
    truth[1000:2000] = truth[1000]
    tracemalloc.start()
    labels = C.ward(points, 32)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (labels == truth).all()
    assert most < 60e6  # a matrix of the distances has 288 MB


def test_ward_refuses_points_that_are_not_finite():
    with pytest.raises(ValueError, match="finite"):
        C.ward(np.array([[0.0], [np.nan], [1.0]]), 2)


def bags(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens array<array<double>>")


def test_maxsim_strategies_and_edges(spark):
    docs = bags(spark, [(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[-1.0, 0.0]]), (3, []), (4, None)])
    q = spark.createDataFrame([(10, [[1.0, 0.0], [0.5, 0.5]]), (11, [])], "query_id long, tokens array<array<double>>")
    want = {(10, 1): 1.5, (10, 2): -1.5}
    for strategy in ("blocks", "rows", "nested"):
        assert {(r.query_id, r.doc_id): r.score for r in M.maxsim(q, docs, strategy).collect()} == want
        padded = {(r.query_id, r.doc_id): r.score for r in M.maxsim(q, docs, strategy, pad_len=2).collect()}
        assert padded == {(10, 1): 1.5, (10, 2): 0.0}
    assert [r.doc_id for r in M.maxsim(q, docs, top_k=1).collect()] == [1]
    assert M.maxsim(q.where("false"), docs).count() == 0
    assert M.maxsim(q, docs.where("false")).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 1000))
def test_maxsim_blocks_split_alike(spark, seed):
    rng = np.random.default_rng(seed)
    docs = bags(spark, [(i, rng.normal(size=(rng.integers(1, 4), 3)).tolist()) for i in range(5)])
    q = spark.createDataFrame([(i, rng.normal(size=(2, 3)).tolist()) for i in range(3)], "query_id long, tokens array<array<double>>")
    a, b = ({(r.query_id, r.doc_id): round(r.score, 9) for r in M.maxsim(q, docs, block=n).collect()} for n in (2, 4096))
    assert a == b and len(a) == 15


def test_score_blocks_split_alike(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 6, 20)
    at, stacked = np.concatenate(([0], np.cumsum(sizes)[:-1])), rng.normal(size=(sizes.sum(), 3))
    docs = pa.array([rng.normal(size=(n, 3)).tolist() for n in (2, 1, 4)] + [[]])
    for options in ((None, None), (3, None), (None, 0.1)):
        whole = M._score_batch([None] * 20, stacked, at, docs, *options)
        for size in (1, 5, 12):
            monkeypatch.setattr(M, "SCORE_BLOCK", size)
            assert np.allclose(M._score_batch([None] * 20, stacked, at, docs, *options), whole, equal_nan=True)
        monkeypatch.undo()


def test_grades(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (-1.0,), (float("nan"),), (2.0,)], "s double")
    assert [r[0] for r in rows.select(V.positive_grade(F.col("s"))).collect()] == [1.0, 1.0, None, None, 2.0]


def test_perfect_ranking_and_no_judgement(spark):
    scores = spark.createDataFrame([(1, d, 1.0 - d / 10) for d in range(5)] + [(2, 0, 1.0)], "query_id long, doc_id long, score double")
    rel = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0)], "query_id long, doc_id long, grade double")
    got = R.per_query(scores, rel).collect()
    assert len(got) == 1 and got[0].ndcg_at_5 == got[0].map_at_5 == got[0].mrr_at_1 == 1.0 and got[0].recall_at_1 == 0.5
    none = R.task_metrics(R.per_query(scores, rel.where("false"))).first()
    assert none.ndcg_at_10 == 0.0 and none.n_queries == 0


def test_average_of_boards_is_null_with_a_board_missing(spark):
    boards = spark.createDataFrame([("a", 1.0)], "dataset string, m double")
    assert R.average_of_boards(boards, "m", ["a", "b"]).first().avg_boards is None


def test_loss_properties(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0.9, True, None), (1, 2, 0.1, 0.1, False, 1)], "query_id long, doc_id long, score double, teacher_score double, is_pos boolean, slot_mask int")
    assert L.info_nce(rows).first().loss < 1e-9
    assert L.relation_kl(rows).first().loss == pytest.approx(0.0)
    assert L.margin_loss(rows).first().loss == pytest.approx(0.0)
    assert L.symmetric(rows).first().loss < 0.01
    masked = L.candidate_masks(rows, spark.createDataFrame([(1, 2)], "query_id long, doc_id long"))
    assert {r.doc_id: r.masked for r in masked.collect()} == {1: False, 2: True}
    with pytest.raises(ValueError):
        L.normalized_weights([1], {1: 0.0})


def test_merge_checks(spark):
    rows = spark.createDataFrame([("a", "p", 0, 1.0), ("b", "p", 0, 3.0), ("a", "q", 0, 1.0)], "arm string, param string, idx int, value double")
    assert G.weighted_merge(rows.where("param = 'p'"), {"a": 1, "b": 1}).first().value == 2.0
    with pytest.raises(Exception, match="arms differ"):
        G.weighted_merge(rows, {"a": 1, "b": 1}).collect()
    with pytest.raises(ValueError):
        G.weighted_merge(rows, {"a": -1, "b": 2})


def test_training_tables(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(10, 13)], "source string, doc_id long")
    got = T.task_consistent_batches(rows, 4, 1, "doc_id", "source", shard_rows=3).groupBy("source", "batch_id").count().collect()
    assert sorted((r.source, r["count"]) for r in got) == [("a", 4), ("a", 4)]
    wrapped = T.task_consistent_batches(rows, 4, 1, "doc_id", "source", drop_last=False).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in wrapped} == {"a": 12, "b": 4}
    with pytest.raises(Exception, match="unknown doc_id"):
        T.strict_join(rows, rows.where("doc_id < 5").select("doc_id"), "doc_id").collect()
    assert sorted(T.interleave({"a": 9, "b": 4}, 4, 0)) == ["a", "a", "b"]
    assert T.balanced({"x": 5, "y": 3, "z": 3}, 2) == [["x"], ["y", "z"]]
    judged = spark.createDataFrame([("q", [1, 2], [5, 6, 7], None)], "query string, positive_doc_ids array<long>, negative_doc_ids array<long>, negative_mask array<long>")
    assert T.layout(judged.columns) == "judged" and T.rows_by_layout(judged, 2).first().neg_ids == [5, 6]
    assert T.seeded_head(rows, 3, 1, "doc_id").count() == 3


def test_compression(spark):
    rng = np.random.default_rng(0)
    tokens = spark.createDataFrame([(d, i, rng.normal(size=8).tolist(), 1, n) for d, n in ((1, 3), (2, 6)) for i in range(n)], "doc_id long, tok_idx int, vec array<double>, height int, width int")
    index = C.compress(tokens, C.Recipe(budget=4, dim=8)).collect()
    assert sorted((r.doc_id, r.cluster_id) for r in index) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in index)
    assert sum(r.n_members for r in index if r.doc_id == 2) == 6
    spans = spark.createDataFrame([(1, 1, 2), (2, 1, 6)], "doc_id long, image_start int, image_end int")
    parts = C.compress_span(tokens.withColumn("width", F.when(F.col("doc_id") == 1, 1).otherwise(5)), spans, C.Recipe(budget=2, dim=8)).groupBy("doc_id", "part").count().collect()
    assert {(r.doc_id, r.part): r["count"] for r in parts} == {(1, 0): 1, (1, 1): 1, (1, 2): 1, (2, 0): 1, (2, 1): 2}
    grids = spark.createDataFrame([(1, [1, 4, 4], 4), (2, [2, 4, 4], 4), (3, [1, 3, 4], 4), (4, [1, 4, 4], 5)], "doc_id long, grid_thw array<int>, n_tokens int")
    assert {r.doc_id for r in C.grid_errors(grids).collect()} == {2, 3, 4}
    assert round(C.gib_per_million_pages(32, 64), 4) == 3.8147 and C.weight_tag(0.1) == "w10"
    with pytest.raises(ValueError):
        C.Recipe(budget=0)


def test_catalogue_and_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    one = spark.range(1)
    for p in ("d1/s1/english-corpus", "d1/s1/english-queries", "d1/s1/english-qrels", "d2/s2/corpus", "d2/s2/queries", "d2/s2/qrels", "demo/s3/corpus"):
        one.coalesce(1).write.parquet(f"{root}/{p}")
    tasks = S.discover_tasks(spark, root, ("d2", "d1", "demo", "none"))
    assert [(t["dataset"], t["fmt"], t["lang"]) for t in tasks] == [("d2", "beir", None), ("d1", "beir", "english"), ("demo", "beir", None)]
    assert len(S.select_datasets(tasks)) == 2 and len(S.select_datasets(tasks, "demo,d2")) == 2
    results = spark.createDataFrame([("t1", 1.0), ("t2", 2.0)], "task string, m double")
    W.write_results(results, f"{root}/out")
    W.write_results(results.where("task = 't1'").withColumn("m", F.lit(9.0)), f"{root}/out")
    assert {r.task: r.m for r in spark.read.parquet(f"{root}/out").collect()} == {"t1": 9.0, "t2": 2.0}
    with pytest.raises(Exception):
        W.write_new(results, f"{root}/out")
    W.write_text(spark, f"{root}/summary.md", W.markdown(results))
    assert "| t1 | 1.00 |" in (tmp_path / "summary.md").read_text()
    rel = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 2.0)], "query_id string, doc_id string, grade double")
    assert sorted(map(tuple, W.read_qrels_json(W.qrels_json(rel)).collect())) == sorted(map(tuple, rel.collect()))
    assert S.resolve_contract({"a": None}, {"a": 1}, 64, [64]) == {"a": 1, "head": 64}
    with pytest.raises(ValueError):
        S.resolve_contract({"a": 2}, {"a": 1}, 64, [64])
    made = S.run_metadata(2, 3, None, 4)
    assert made["effective_batch"] is None and made["consumed"] is None and S.run_metadata(2, 3, 4, 5)["consumed"] == 120


def test_alias_rules(spark):
    corpus = spark.createDataFrame([("x", None, 0), (None, "y", 1), (None, None, 2)], "`corpus-id` string, id string, ord long")
    assert [r.doc_id for r in S.beir_corpus(corpus).collect()] == ["x", "y", "c2"]
    q = S.beir_queries(spark.createDataFrame([("1", None), ("2", " none"), ("3", "NONE"), ("4", " ")], "`query-id` string, query string"))
    rel = spark.createDataFrame([(str(i),) for i in range(5)], "query_id string")
    assert [r.query_id for r in S.keep_queries(q, rel).collect()] == ["2"]
    with pytest.raises(ValueError):
        S.paired_queries(spark.range(1))


def test_incremental_index(spark, tmp_path):
    from vecmill.streaming.incremental import index_arrivals

    src, q = f"{tmp_path}/in", spark.createDataFrame([(1, [[1.0, 0.0]])], "query_id long, tokens array<array<double>>")
    for k, rows in enumerate(([(1, [[1.0, 0.0]])], [(1, [[1.0, 0.0]]), (2, [[0.0, 1.0]])])):
        bags(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("doc_id long, tokens array<array<double>>").parquet(src)
        index_arrivals(stream, q, f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/index").collect()) == [1, 2]


def test_arrivals_outside_the_best_are_scored_once(spark, tmp_path):
    from vecmill.streaming.incremental import index_arrivals

    src, q = f"{tmp_path}/in", spark.createDataFrame([(1, [[1.0, 0.0]])], "query_id long, tokens array<array<double>>")
    both = [(1, [[1.0, 0.0]]), (2, [[0.5, 0.0]])]
    for rows in (both, [*both, (3, [[0.9, 0.0]])]):
        bags(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("doc_id long, tokens array<array<double>>").parquet(src)
        index_arrivals(stream, q, f"{tmp_path}/index", f"{tmp_path}/checkpoint", top_k=1).awaitTermination()
    assert sorted((r.batch, r.doc_id) for r in spark.read.parquet(f"{tmp_path}/index").collect()) == [(0, 1), (1, 3)]
    assert sorted((r.batch, r.doc_id) for r in spark.read.parquet(f"{tmp_path}/index-seen").collect()) == [(0, 1), (0, 2), (1, 3)]
