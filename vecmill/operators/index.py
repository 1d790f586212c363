"""Token dumps and compressed indexes on disk: written by corpus, read with checks,
resumed, and scored.

A dump is a folder with ``docs`` (partitioned by ``corpus_id``), ``queries`` and ``qrels``
(partitioned by ``task``) and ``tasks``, one row for each finished task.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources import sinks as W
from ..sources import tables as S
from . import compress as C
from . import metrics as R
from .evaluate import Encoder, beir_parts, paired_parts
from .maxsim import maxsim, n_places, nested

PROTOCOL = "token-dump-1"


def split_tokens(encoded: DataFrame, image_token: int, merge: int = 2) -> DataFrame:
    """``doc_id, tokens, image_start, image_end, grid_thw`` of encoder batches
    ``doc_id, tokens, attention, token_ids, grid_thw``: padding is dropped by the mask and
    the image tokens must be one run of as many tokens as the merged grid has cells."""
    ids = V.masked(F.col("token_ids"), F.col("attention"))
    start, end, valid = C.image_span(V.image_mask(ids, image_token))
    cells = F.floor(F.get("grid_thw", F.lit(1)) / merge) * F.floor(F.get("grid_thw", F.lit(2)) / merge)
    ok = F.when(valid & (end - start == cells), start.cast("int")).otherwise(F.raise_error(F.concat(F.lit("image tokens and grid differ in "), F.col("doc_id").cast("string"))).cast("int"))
    return encoded.select("doc_id", V.masked(F.col("tokens"), F.col("attention")).alias("tokens"), ok.alias("image_start"), end.cast("int").alias("image_end"), "grid_thw")


def _written(df: DataFrame, path: str, by: str, key: str) -> DataFrame:
    """Write one partition of a table and read it back; the other partitions stay."""
    folder = f"{path}/{by}={key}"
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def dump_task(spark: SparkSession, task: dict, encode_pages: Encoder, encode_queries: Encoder, root: str, max_queries: int | None = None, max_docs: int | None = None) -> DataFrame:
    """Encode a task's corpus (once, if another task has not done so) and queries, write
    them and the judgements, then the task's row; returns the row."""
    corpus = S.corpus_id(task["fmt"], task["corpus"], max_docs or 0)
    tag = f"{task['dataset']}/{task['subset']}" + (f"[{task['lang']}]" if task["lang"] else "")
    slug = tag.replace("/", "__").replace("[", "__").replace("]", "")
    if task["fmt"] == "paired":
        pages, queries, qrels = paired_parts(S.read_rows(spark, task["corpus"]), max_queries, max_docs)
    else:
        pages, queries, qrels = beir_parts(*(S.read_rows(spark, task[k]) for k in ("corpus", "queries", "qrels")), max_queries, max_docs)
    folder = f"{root}/docs/corpus_id={corpus}"
    if not any(n == "_SUCCESS" for n, _ in S.listing(spark, folder)):
        _written(encode_pages(pages), f"{root}/docs", "corpus_id", corpus)
    docs = spark.read.parquet(folder)
    q = _written(encode_queries(queries.select("query_id", "text")), f"{root}/queries", "task", slug)
    _written(qrels, f"{root}/qrels", "task", slug)
    row = docs.agg(F.count("*").alias("n_docs")).crossJoin(q.agg(F.count("*").alias("n_queries")))  # one row each
    row = row.select(F.lit(tag).alias("tag"), F.lit(task["dataset"]).alias("dataset"), F.lit(corpus).alias("corpus_id"), F.lit(PROTOCOL).alias("protocol"), "n_docs", "n_queries")
    return _written(row, f"{root}/tasks", "task", slug)


def complete_tasks(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the tasks of this protocol whose three parts are there (finished writes)."""
    finished = lambda part: {n.partition("=")[2] for n, _ in S.listing(spark, f"{root}/{part}") if any(x == "_SUCCESS" for x, _ in S.listing(spark, f"{root}/{part}/{n}"))}
    if not S.listing(spark, f"{root}/tasks"):
        raise FileNotFoundError(f"no dumped tasks in {root}")
    rows = spark.read.parquet(f"{root}/tasks").where(F.col("protocol") == PROTOCOL)
    both = sorted(finished("queries") & finished("qrels"))
    return rows.where(F.col("task").isin(both) & F.col("corpus_id").isin(sorted(finished("docs"))))


def dump_counters(done: DataFrame, expected: int) -> DataFrame:
    """One row: tasks, distinct corpora, documents and queries summed over tasks, and
    whether all expected tasks are there."""
    row = done.agg(F.count("*").alias("completed_tasks"), F.countDistinct("corpus_id").alias("unique_corpora"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs_sum"), F.coalesce(F.sum("n_queries"), F.lit(0)).alias("n_queries_sum"))
    return row.withColumn("expected_tasks", F.lit(expected).cast("long")).withColumn("status", F.when(F.col("completed_tasks") >= expected, "complete").otherwise("partial"))


def checked_clusters(labels: DataFrame, budget: int) -> DataFrame:
    """``doc_id, n_tokens, n_clusters`` of the documents whose clusters are not as many
    as the budget or their tokens allow: an empty cluster, or one too many."""
    n = labels.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("cluster_id").alias("n_clusters"))
    return n.where(F.col("n_clusters") != F.least(F.col("n_tokens"), F.lit(budget)))


def index_stats(index: DataFrame, tokens: DataFrame, budget: int, dim: int) -> DataFrame:
    """One row of compression statistics of an index ``doc_id, cluster_id, ..``."""
    sizes = index.groupBy("doc_id").agg(F.count("*").alias("n_stored"))
    raw = tokens.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("avg_tokens"))
    return C.compression_stats(sizes, budget, dim).crossJoin(raw)  # one row each


def cluster_corpora(tokens: DataFrame, path: str, recipe: C.Recipe = C.Recipe(), overwrite: bool = False) -> DataFrame:
    """Compress every corpus of ``corpus_id, doc_id, tok_idx, vec, height, width`` below
    ``path/<weight>`` (one partition each) and return the statistics, a row a corpus.

    Corpora whose partition is finished are left as they are unless ``overwrite``; when
    all are, nothing is computed."""
    spark, top = tokens.sparkSession, f"{path}/{C.weight_tag(recipe.weight)}"
    for r in tokens.select("corpus_id").distinct().orderBy("corpus_id").collect():  # a corpus is a folder
        folder = f"{top}/corpus_id={r.corpus_id}"
        if overwrite or not any(n == "_SUCCESS" for n, _ in S.listing(spark, folder)):
            C.compress(tokens.where(F.col("corpus_id") == r.corpus_id).drop("corpus_id"), recipe).write.mode("overwrite").parquet(folder)
    index = spark.read.parquet(top)
    sizes = index.groupBy("corpus_id", "doc_id").agg(F.count("*").alias("n_stored"))
    rows = sizes.groupBy("corpus_id").agg(F.count("*").alias("n_pages"), F.avg("n_stored").alias("avg_stored"), F.min("n_stored").alias("min_stored"), F.max("n_stored").alias("max_stored"), F.count_if(F.col("n_stored") < recipe.budget).alias("below_budget"))
    rows = rows.withColumn("gib_per_million", F.col("avg_stored") * (recipe.dim * 2 * 1e6 / 2**30))
    told = {"n_corpora": rows.count(), **recipe.metadata()}
    W.write_json(spark, f"{path}/{C.weight_tag(recipe.weight)}.json", told)
    return rows


def checked_index(index: DataFrame, budget: int, dim: int) -> DataFrame:
    """The index, with an error for a vector of another width and for a document of more
    vectors than the budget."""
    n = index.groupBy("doc_id").agg(F.count("*").alias("n_stored"), F.max(F.size("vec")).alias("widest"), F.min(F.size("vec")).alias("least"))
    why = F.when((F.col("widest") != dim) | (F.col("least") != dim), "a vector of another width in ").when(F.col("n_stored") > budget, "more vectors than the budget in ")
    ok = F.when(why.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(why, F.col("doc_id").cast("string"))).cast("boolean"))
    return index.join(n.select("doc_id", ok.alias("ok")), "doc_id").where("ok").drop("ok")


def read_index(spark: SparkSession, path: str, corpus: str, recipe: C.Recipe = C.Recipe()) -> DataFrame:
    """The compressed documents of one corpus (one partition is read), checked."""
    rows = spark.read.parquet(f"{path}/{C.weight_tag(recipe.weight)}").where(F.col("corpus_id") == corpus).drop("corpus_id")
    return checked_index(rows, recipe.budget, recipe.dim)


def read_raw(spark: SparkSession, root: str, corpus: str) -> DataFrame:
    return spark.read.parquet(f"{root}/docs").where(F.col("corpus_id") == corpus).drop("corpus_id")


def read_queries(spark: SparkSession, root: str, task: str) -> DataFrame:
    return spark.read.parquet(f"{root}/queries").where(F.col("task") == task).drop("task")


def index_bags(index: DataFrame) -> DataFrame:
    return nested(index.withColumnRenamed("cluster_id", "tok_idx"))


def score_task(queries: DataFrame, bags: DataFrame, qrels: DataFrame, pad_len: int | None = None, ks: tuple[int, ...] = R.KS, candidates: Column | None = None) -> DataFrame:
    """One row of metrics with ``n_docs``, ``n_queries`` and the greatest numbers of tokens
    of a document and a query.  ``candidates`` is a condition on ``query_id, doc_id`` that
    pairs must meet to be ranked."""
    if candidates is None:
        scores = maxsim(queries, bags, top_k=max(ks), pad_len=pad_len).drop("rank")
    else:
        scores = maxsim(queries, bags, pad_len=pad_len).where(candidates)
    row = R.task_metrics(R.per_query(scores, qrels, ks), ks=ks).drop("n_queries")
    sizes = bags.agg(F.count("*").alias("n_docs"), F.max(F.size("tokens")).alias("doc_tokens")).crossJoin(queries.agg(F.count("*").alias("n_queries"), F.max(n_places(queries)).alias("query_tokens")))
    return row.crossJoin(sizes)  # one row each


def timed(scores: DataFrame, n_queries: int) -> dict:
    """Run a scoring plan and tell seconds and milliseconds a query: pure search on stored
    vectors, not a product's throughput."""
    began = time.perf_counter()
    scores.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return {"search_sec": round(took, 4), "search_ms_per_query": round(1000 * took / max(n_queries, 1), 4)}
