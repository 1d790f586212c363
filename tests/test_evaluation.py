"""Catalogue, evaluation, dumps, indexes and summaries over files."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from vecmill.functions import vectors as V
from vecmill.operators import compress as C
from vecmill.operators import evaluate as E
from vecmill.operators import index as I
from vecmill.operators import losses as L
from vecmill.operators import metrics as R
from vecmill.operators import runner as N
from vecmill.operators import summary as Y
from vecmill.operators import training as T
from vecmill.sources import sinks as W
from vecmill.sources import tables as S


def put(df, path):
    """One Parquet file of a name of our own."""
    import os
    import shutil

    df.coalesce(1).write.mode("overwrite").parquet(f"{path}.tmp")
    part = next(n for n in os.listdir(f"{path}.tmp") if n.endswith(".parquet"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    shutil.move(f"{path}.tmp/{part}", path)
    shutil.rmtree(f"{path}.tmp")


#: Vectors by name; the encoders look pages and queries up.
POINTS = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.7, 0.7], "d": [-1.0, 0.2]}


def encoders(spark):
    known = spark.createDataFrame([(k, [v, v]) for k, v in POINTS.items()], "name string, tokens array<array<double>>")
    pages = lambda df: df.join(known, F.right("doc_id", F.lit(1)) == known["name"]).select("doc_id", "tokens")
    asked = lambda df: df.join(known, df["text"] == known["name"]).select("query_id", "tokens")
    return pages, asked


@pytest.fixture()
def root(spark, tmp_path):
    """Every layout: judged by language (one without judgements), judged, paired, paired
    by language, and folders that are no datasets."""
    paired = spark.createDataFrame([("a", "p_a"), (" None ", "p_b"), (None, "p_c"), ("c ", "p_c"), ("b", "p_a")], "query string, image_filename string")
    corpus = spark.createDataFrame([("x_a", None), (None, "y_b"), (None, "z_c")], "`corpus-id` string, id string")
    asks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", " ")], "id string, text string")
    judged = spark.createDataFrame([("1", "x_a", 0.0), ("2", "y_b", 2.0), ("2", "y_b", 1.0), ("2", "gone", 1.0), ("3", "x_a", 1.0)], "`query-id` string, `corpus-id` string, score double")
    put(corpus, f"{tmp_path}/eval_v3/s1/english-corpus/test-0.parquet")
    put(corpus.limit(1), f"{tmp_path}/eval_v3/s1/english-corpus/train-0.parquet")
    put(corpus.limit(1), f"{tmp_path}/eval_v3/s1/french-corpus/test-0.parquet")
    put(corpus.limit(1), f"{tmp_path}/eval_v3/s1/german-corpus/test-0.parquet")
    for lang in ("english", "french"):
        put(asks, f"{tmp_path}/eval_v3/s1/{lang}-queries/test-0.parquet")
        put(judged, f"{tmp_path}/eval_v3/s1/{lang}-qrels/test-0.parquet")
    put(asks, f"{tmp_path}/eval_v3/s1/german-queries/test-0.parquet")
    put(corpus, f"{tmp_path}/eval_v2/s2/corpus/c.parquet")
    put(asks, f"{tmp_path}/eval_v2/s2/queries/q.parquet")
    put(judged, f"{tmp_path}/eval_v2/s2/docs/j.parquet")
    put(paired, f"{tmp_path}/eval/s3/data/test-0.parquet")
    put(paired.limit(1), f"{tmp_path}/eval/s3/data/train-0.parquet")
    put(paired, f"{tmp_path}/JinaVDR/s4/fr/test-0.parquet")
    put(paired, f"{tmp_path}/JinaVDR/s4/de/train-0.parquet")
    put(paired, f"{tmp_path}/other/s5/data/test-0.parquet")
    return f"file://{tmp_path}"


def test_catalogue_of_every_layout(spark, root):
    tasks = S.discover_tasks(spark, root)
    assert [(t["dataset"], t["fmt"], t["lang"]) for t in tasks] == [("eval", "paired", None), ("eval_v2", "beir", None), ("eval_v3", "beir", "english"), ("eval_v3", "beir", "french"), ("JinaVDR", "paired", "fr")]
    by = {(t["dataset"], t["lang"]): t for t in tasks}
    assert [f.rpartition("/")[2] for f in by["eval", None]["corpus"]] == ["test-0.parquet"]
    assert by["eval_v2", None]["qrels"] == [f"{root}/eval_v2/s2/docs/j.parquet"]
    assert by["eval_v3", "french"]["corpus"] == by["eval_v3", "english"]["corpus"] == [f"{root}/eval_v3/s1/english-corpus/test-0.parquet"]
    rows = S.catalogue(spark, tasks).orderBy("place").collect()
    assert rows[0].task == "eval/s3" and rows[-1].task == "JinaVDR/s4[fr]" and rows[1].queries
    assert S.corpus_size(spark, by["eval", None]["corpus"]) == 5 and S.corpus_size(spark, []) == 0
    assert S.corpus_id("paired", ["a", "b"]) != S.corpus_id("paired", ["a", "b"], 3)


def test_first_corpus_serves_where_there_is_no_english_one(spark, tmp_path):
    one = spark.range(1)
    for n in ("de-corpus", "fr-corpus", "fr-queries", "fr-qrels"):
        put(one, f"{tmp_path}/eval_v3/s/{n}/test-0.parquet")
    (task,) = S.discover_tasks(spark, f"file://{tmp_path}")
    assert task["lang"] == "fr" and task["corpus_key"].endswith("de-corpus")


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    put(spark.range(0, 5), f"{tmp_path}/b.parquet")
    put(spark.range(5, 8).withColumn("id", F.col("id")), f"{tmp_path}/a.parquet")
    got = S.read_rows(spark, [f"{tmp_path}/b.parquet", f"{tmp_path}/a.parquet"]).repartition(3).collect()
    assert {r.id: r.ord for r in got} == {i: i for i in range(8)}
    named = S.beir_corpus(S.read_rows(spark, [f"{tmp_path}/b.parquet"]).select(F.lit(None).cast("string").alias("id"), "ord"))
    assert sorted(r.doc_id for r in named.collect()) == [f"c{i}" for i in range(5)]
    with pytest.raises(Exception, match="no id and no number"):
        S.beir_corpus(spark.createDataFrame([(None,)], "id string")).collect()


def test_evaluate_tasks_end_to_end(spark, root, tmp_path):
    tasks = S.discover_tasks(spark, root)
    calls = []
    pages, asked = encoders(spark)

    def counted(df):
        calls.append(1)
        return pages(df)

    rows = {r.task: r for r in N.run_tasks(spark, tasks, counted, asked, f"file://{tmp_path}/run").collect()}
    assert len(rows) == 5 and len(calls) == 4  # two languages share a corpus
    paired = rows["eval/s3"]
    assert (paired.n_docs, paired.n_queries) == (3, 3)
    assert paired.ndcg_at_1 == pytest.approx(2 / 3)  # the query b asks for page a
    beir = rows["eval_v3/s1[french]"]
    assert (beir.n_docs, beir.n_queries) == (3, 2) and beir.recall_at_1 == 1.0
    again = N.run_tasks(spark, tasks, counted, asked, f"file://{tmp_path}/run")
    assert again.count() == 5 and len(calls) == 4
    few = E.evaluate_paired(S.read_rows(spark, tasks[0]["corpus"]), pages, asked, max_queries=1, max_docs=2).first()
    assert (few.n_docs, few.n_queries) == (2, 1)
    top = E.score_images(spark.createDataFrame([("p_a",), ("p_b",)], "doc_id string"), spark.createDataFrame([("q", "b")], "query_id string, text string"), pages, asked).collect()
    assert [r.doc_id for r in top] == ["p_b", "p_a"]
    with pytest.raises(Exception, match="image_filename is null"):
        S.candidate_pages(spark.createDataFrame([(None, 1)], "image_filename string, ord long")).collect()
    twice = spark.createDataFrame([("x", 0), ("x", 1)], "id string, ord long")
    with pytest.raises(ValueError, match="repeated"):
        E.beir_parts(twice, twice, twice)


def test_dumps_and_indexes_resume(spark, root, tmp_path):
    tasks = S.discover_tasks(spark, root)
    pages, asked = encoders(spark)
    dump, index = f"file://{tmp_path}/dump", f"file://{tmp_path}/index"
    for t in tasks:
        I.dump_task(spark, t, pages, asked, dump)
    done = I.complete_tasks(spark, dump)
    row = I.dump_counters(done, 5).first()
    assert (row.completed_tasks, row.unique_corpora, row.status) == (5, 4, "complete") and row.n_docs_sum == 15
    assert I.dump_counters(done, 6).first().status == "partial"
    corpus = done.where("tag = 'eval/s3'").first()
    assert I.read_raw(spark, dump, corpus.corpus_id).count() == 3 and I.read_queries(spark, dump, corpus.task).count() == 3
    flat = spark.read.parquet(f"{dump}/docs").select("corpus_id", "doc_id", F.posexplode("tokens").alias("tok_idx", "vec"), F.lit(1).alias("height"), F.lit(2).alias("width"))
    recipe = C.Recipe(budget=1, dim=2)
    stats = I.cluster_corpora(flat, index, recipe).collect()
    assert len(stats) == 4 and all(r.max_stored == 1 for r in stats)
    assert json.loads((tmp_path / "index" / "w10.json").read_text())["n_corpora"] == 4
    before = (tmp_path / "index" / "w10" / f"corpus_id={corpus.corpus_id}" / "_SUCCESS").stat().st_mtime_ns
    I.cluster_corpora(flat, index, recipe)
    assert (tmp_path / "index" / "w10" / f"corpus_id={corpus.corpus_id}" / "_SUCCESS").stat().st_mtime_ns == before
    own = I.read_index(spark, index, corpus.corpus_id, recipe)
    qrels = spark.read.parquet(f"{dump}/qrels").where(F.col("task") == corpus.task)
    scored = I.score_task(I.read_queries(spark, dump, corpus.task), I.index_bags(own), qrels, pad_len=1).first()
    assert (scored.n_docs, scored.n_queries, scored.doc_tokens, scored.query_tokens) == (3, 3, 1, 2) and scored.ndcg_at_1 == pytest.approx(2 / 3)
    assert I.timed(own, 3)["search_ms_per_query"] >= 0
    with pytest.raises(Exception, match="more vectors than the budget"):
        I.checked_index(own.unionByName(own), 1, 2).collect()
    with pytest.raises(Exception, match="another width"):
        I.checked_index(own, 1, 3).collect()
    (tmp_path / "dump" / "qrels" / f"task={corpus.task}" / "_SUCCESS").unlink()
    assert I.complete_tasks(spark, dump).count() == 4
    with pytest.raises(FileNotFoundError):
        I.complete_tasks(spark, f"file://{tmp_path}/nothing")


def test_batches_are_split_by_mask_and_grid(spark):
    schema = "doc_id string, tokens array<array<double>>, attention array<boolean>, token_ids array<int>, grid_thw array<int>"
    tokens = [[float(i)] for i in range(6)]
    rows = spark.createDataFrame([("d", tokens, [False, True, True, True, True, True], [0, 1, 9, 9, 2, 2], [1, 2, 4])], schema)
    r = I.split_tokens(rows, 9).first()
    assert (r.tokens, r.image_start, r.image_end) == (tokens[1:], 1, 3)
    with pytest.raises(Exception, match="image tokens and grid differ"):
        I.split_tokens(rows.withColumn("grid_thw", F.array(F.lit(1), F.lit(4), F.lit(4))), 9).collect()
    packed = spark.createDataFrame([(["x", "y", "z"], tokens[:3], [0, 1, 1, 3])], "ids array<string>, packed array<array<double>>, offsets array<long>")
    assert {r.doc_id: r.tokens for r in S.packed_tokens(packed).collect()} == {"x": tokens[:1], "y": [], "z": tokens[1:3]}


def test_summaries(spark, tmp_path):
    metrics = ["ndcg_at_5", "ndcg_at_10"]
    tasks = [{"dataset": d, "subset": s, "fmt": "paired", "lang": None, "corpus_key": s, "corpus": [s]} for d, s in (("eval", "t1"), ("eval", "t2"), ("eval_v2", "t3"))]
    listed = S.catalogue(spark, tasks)
    schema = "task string, dataset string, n_queries long, n_docs long, error string, ndcg_at_5 double, ndcg_at_10 double"
    rows = [("eval/t2", "eval", 2, 3, None, 0.5, 0.25), ("eval/t1", "eval", 1, 3, None, 0.5, 0.75), ("eval_v2/t3", "eval_v2", 1, 1, "broke", None, None)]
    part = Y.summary(spark.createDataFrame(rows, schema), listed, metrics)
    assert part["status"] == "partial" and part["missing_tasks"] == ["eval_v2/t3"] and part["n_failed"] == 1
    assert [t["task"] for t in part["per_task"]] == ["eval/t1", "eval/t2"] and part["averages"]["avg4_ndcg@10"] is None
    done = spark.createDataFrame([*rows[:2], ("eval_v2/t3", "eval_v2", 1, 1, None, 1.0, 1.0)], schema)
    whole = Y.summary(done, listed, metrics)
    assert whole["status"] == "complete" and whole["headline"]["V1 nDCG@10"] == 0.5 and whole["per_dataset"]["eval"]["n_queries"] == 3
    root = f"file://{tmp_path}"
    for folder in ("raw", "k32", "d64"):
        assert Y.write_summary(spark, f"{root}/{folder}", done, listed, "run", metrics, settings={"seed": 1, "lr": None}) == whole
    text = (tmp_path / "raw" / "summary.md").read_text()
    assert text.startswith("# run: complete") and "| V1 | 2 of 2 | 3 | 6 | 50.00 | 50.00 |" in text and "| seed | 1 |" in text and "Open tasks" not in text
    assert [tuple(r) for r in Y.open_tasks(spark.createDataFrame(rows[1:], schema), listed, metrics).collect()] == [("eval/t2", "missing"), ("eval_v2/t3", "failed: broke")]
    assert Y.read_summary(spark, f"{root}/raw/summary.json", metrics)["status"] == "complete"
    whole["per_task"][0]["ndcg_at_5"] = None
    W.write_json(spark, f"{root}/raw/summary.json", whole)
    assert Y.read_summary(spark, f"{root}/raw/summary.json", metrics)["invalid_metric_tasks"] == ["eval/t1"]
    assert Y.read_summary(spark, f"{root}/none/summary.json") is None
    (tmp_path / "broken.json").write_text("{")
    assert S.read_json(spark, f"{root}/broken.json") == {}
    heads = Y.write_heads(spark, root, [64, 16], metrics)
    assert heads["heads_complete"] == [64] and heads["per_head"]["64"]["boards"]["eval"]["ndcg_at_10"] == 50.0
    wide = (tmp_path / "summary_heads.md").read_text()
    assert "| 16 | missing |" in wide and "| eval | 50.00 |" in wide
    ladder = Y.write_ladder(spark, root)
    assert ladder["footprint"]["gib_per_million_pages"] == 3.8147 and Y.headline_percent(whole, "V1 nDCG@10") == 50.0
    assert W.archived(spark, f"{root}/raw") == f"{root}/raw.old1" and W.archived(spark, f"{root}/raw") is None


def test_cached_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"task": "a", "eval_protocol": "p", "eval_contract_id": "c", "m": 0.5}))
    (tmp_path / "b.json").write_text(json.dumps({"task": "b", "eval_protocol": "p", "eval_contract_id": "old", "m": 0.5}))
    (tmp_path / "c.json").write_text("{ no json")
    assert [r.task for r in S.cached_tasks(spark, f"file://{tmp_path}/*.json", "p", "c", ["m"]).collect()] == ["a"]
    assert S.cached_tasks(spark, f"file://{tmp_path}/a.json", "p", "c", ["m", "other"]).count() == 0


def test_contract_follows_files_and_settings(spark, tmp_path):
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "large.bin").write_bytes(b"x" * 100)
    files = [f"file://{tmp_path}/{n}" for n in ("config.json", "large.bin")]
    by = {r.path.rpartition("/")[2]: r for r in S.file_identity(spark, files, largest=10).collect()}
    assert by["config.json"].sha256 == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a" and by["large.bin"].sha256 is None and by["large.bin"].size == 100
    assert all(r.sha256 for r in S.file_identity(spark, files, always=("large.bin",), largest=10).collect())
    task = {"dataset": "d", "subset": "s", "fmt": "paired", "lang": None, "corpus": files[1:]}
    make = lambda **o: S.evaluation_contract(spark, **({"protocol": "p", "run_name": "r", "training": {}, "evaluation": {"head": 64}, "model_files": files[:1], "tasks": [task]} | o))
    assert make() == make() and make() != make(evaluation={"head": 32})
    (tmp_path / "config.json").write_text("[]")
    assert make() != S.contract({})
    assert set(S.default_paths(spark, "run")) == {"datasets", "tasks", "dumps", "indexes"}


def test_lists_of_widths():
    assert S.parse_dims("128, 64,64") == (64, 128) and S.parse_dims(" ") == ()
    assert S.parse_dim_map("64:0.5, 128:2", (64, 128)) == {64: 0.5, 128: 2.0}
    for bad in ("0,64", "x", ","):
        with pytest.raises(ValueError):
            S.parse_dims(bad)
    for bad in ("64", "64:x", "32:1"):
        with pytest.raises(ValueError):
            S.parse_dim_map(bad, (64,))


def test_images_and_padding(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + bytes(5) + struct.pack(">I", zlib.crc32(b""))
    rows = spark.createDataFrame([((png, "x"),), ((b"GIF89a\x02\x01\x04\x00", "y"),), ((b"no", "z"),)], "image struct<bytes:binary,path:string>")
    got = [r[0] for r in S.image_bytes(rows).select(S.image_size(F.col("image"))).collect()]
    assert [tuple(g) if g else None for g in got] == [(640, 480), (258, 4), None]
    with pytest.raises(TypeError):
        S.image_bytes(spark.range(1).withColumnRenamed("id", "image"))
    bag = spark.createDataFrame([([[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]],), ([[0.0, 0.0]],), ([],)], "t array<array<double>>")
    assert [r[0] for r in bag.select(F.size(V.trim_padding(F.col("t")))).collect()] == [2, 0, 0]
    assert [r[0] for r in bag.select(F.size(V.trim_padding(F.col("t"), side="right"))).collect()] == [2, 0, 0]


def test_more_training_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [(None, i) for i in range(5)], "source string, doc_id long")
    kept = T.truncate_to_batches(rows, 4, ["doc_id"]).groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("m")).collect()
    assert {r.source: (r.n, r.m) for r in kept}["a"] == (8, 7)
    both = T.prefixed(rows, "query_", keep=("doc_id",))
    assert both.columns == ["query_source", "doc_id"] and T.without_prefix(both, "query_", keep=("doc_id",)).columns == ["doc_id", "source"]
    assert T.balanced({"x": 5, "y": 4, "z": 3}, 2, {"x": "c", "z": "c"}) == [["x", "z"], ["y"]]
    assert T.in_turns(["a", "b", "c"], 2) == [["a", "c"], ["b"]]
    inline = spark.createDataFrame([(["q1", "q2"], "page", ["n1", "n2"])], "query array<string>, image string, neg_target array<string>")
    r = T.rows_by_layout(inline, 1).first()
    assert r.query in ("q1", "q2") and (r.pos, r.negs) == ("page", ["n1"])
    assert T.rows_by_layout(spark.createDataFrame([("q", 7)], "query string, pos_target long"), 2).first().neg_ids == []
    listwise = spark.createDataFrame([("q", [1, 2, 3], [3.0, 2.0, 1.0])], "query string, doc_ids array<long>, grades array<double>")
    assert T.rows_by_layout(listwise, 1).first().asDict() == {"query": "q", "pos_id": 1, "neg_ids": [2], "grades": [3.0, 2.0]}
    hard = spark.createDataFrame([("q", 1, [2], "s"), ("r", 1, [2], "t")], "query string, positive_doc_id long, negative_doc_ids array<long>, source string")
    hard.write.parquet(f"{tmp_path}/hard")
    assert S.hard_negatives(spark, f"{tmp_path}/hard", ["s"]).columns[1] == "pos_target" and S.hard_negatives(spark, f"{tmp_path}/hard").count() == 2
    put(rows, f"{tmp_path}/export/part_0.parquet")
    assert S.materialised_parts(spark, f"file://{tmp_path}/export", f"file://{tmp_path}/cache").count() == 15
    assert S.materialised_parts(spark, f"file://{tmp_path}/export", f"file://{tmp_path}/cache").count() == 15
    weights = spark.createDataFrame([("p", 0, 1.5)], "param string, idx int, value float")
    weights.write.parquet(f"{tmp_path}/w")
    assert S.parameters(spark, {"a": f"{tmp_path}/w", "b": f"{tmp_path}/w"}).count() == 2 and S.take(rows, 3).count() == 3


def test_rows_of_a_hot_key_are_dealt_to_several_tasks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, 1).when(F.col("id") < 2990, F.col("id")).alias("query_id"), (F.col("id") / 3000).alias("x"))
    whole, dealt = (L.softmax_sums(rows, ["query_id"], "x", share=n) for n in (10_000, 100))
    want = {r.query_id: (r.x_peak, r.x_sum, r.key_rows) for r in whole.collect()}
    got = {r.query_id: (r.x_peak, r.x_sum, r.key_rows) for r in dealt.collect()}
    assert len(got) == 491 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # it would put small partitions together
    try:
        placed = L.beside(rows, dealt, ["query_id"], 100)
        assert placed.count() == 2990  # a null key has no totals
        tasks = placed.where("query_id = 1").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1 and "SortMergeJoin" in placed._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_masks_and_softmax_of_a_hot_key(spark):
    rows = spark.range(2000).select(F.lit(1).alias("query_id"), F.col("id").alias("doc_id"), (F.col("id") / 2000).alias("score"), (F.col("id") == 1999).alias("is_pos"))
    import math

    want = math.log(sum(math.exp(i / 2000 / 0.1) for i in range(2000))) - 1999 / 2000 / 0.1
    assert L.info_nce(rows, 0.1).first().loss == pytest.approx(want)
    known = spark.createDataFrame([(1, 5)], "query_id int, doc_id long")
    slots = rows.withColumns({"is_hard": F.col("doc_id") < 10, "slot_mask": (F.col("doc_id") != 3).cast("int"), "query_group_id": F.lit(1), "doc_group_id": (F.col("doc_id") == 20).cast("int")})
    assert [r.doc_id for r in L.candidate_masks(slots, known).where("masked").orderBy("doc_id").collect()] == [3, 5, 20]
    assert L.out_of_range(rows.withColumn("score", F.col("score") * 2)).count() == 998
    ranks = R.best_of(rows, rows.where("doc_id = 1999").select("query_id", "doc_id")).first()
    assert ranks.hit and [x.doc_id for x in ranks.top] == [1999, 1998, 1997]
