"""Retrieval metrics at several cut-offs, and their rollups over tasks and boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .maxsim import ranked

KS = (1, 5, 10)
NAMES = ("ndcg", "recall", "map", "mrr")
METRICS = [f"{m}_at_{k}" for m in NAMES for k in KS]


def normalized_qrels(qrels: DataFrame, corpus: DataFrame | None = None, order_col: str = "ord") -> DataFrame:
    """Judgements as used: positive grades only, the last row (by ``order_col``) of a
    repeated pair wins its grade, and (given a corpus) only documents that exist, before
    any ideal is formed."""
    rows = qrels.withColumn("grade", V.positive_grade(F.col("score"))).where("grade is not null")
    if corpus is not None:
        rows = rows.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("grade", order_col).alias("grade"))


def per_query(scores: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """All metrics of each query that has a judged document; others are left out.

    Only the first ``max(ks)`` ranks of a query leave the ranking step."""
    top = max(ks)
    judged = qrels.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    best = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), F.col("doc_id"))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    ideal = qrels.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    ideal = ideal.groupBy("query_id").agg(*[F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))).alias(f"ideal_{k}") for k in ks])
    hits = ranked(scores).where(F.col("rank") <= top).join(qrels, ["query_id", "doc_id"])
    down = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("found", F.count("*").over(down))
    at = lambda k, x: F.sum(F.when(F.col("rank") <= k, x))
    summed = hits.groupBy("query_id").agg(
        *[at(k, gain(F.col("grade"), F.col("rank"))).alias(f"dcg_{k}") for k in ks],
        *[at(k, F.lit(1.0)).alias(f"hits_{k}") for k in ks],
        *[at(k, F.col("found") / F.col("rank")).alias(f"ap_{k}") for k in ks],
        F.min("rank").alias("first"),
    )
    rows = judged.join(ideal, "query_id").join(summed, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cols: list[Column] = []
    for k in ks:
        cols += [
            zero(F.try_divide(F.col(f"dcg_{k}"), F.col(f"ideal_{k}"))).alias(f"ndcg_at_{k}"),
            zero(F.col(f"hits_{k}") / F.col("n_rel")).alias(f"recall_at_{k}"),
            zero(F.col(f"ap_{k}") / F.least(F.col("n_rel"), F.lit(k))).alias(f"map_at_{k}"),
            zero(F.when(F.col("first") <= k, 1 / F.col("first"))).alias(f"mrr_at_{k}"),
        ]
    return rows.select("query_id", *cols)


def task_metrics(queries_scored: DataFrame, task: str | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """Query means; 0 where no query counts."""
    names = [f"{m}_at_{k}" for m in NAMES for k in ks]
    rows = queries_scored.groupBy(task) if task else queries_scored
    return rows.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names], F.count("*").alias("n_queries"))


def board_rollup(tasks: DataFrame, metrics: list[str]) -> DataFrame:
    """Unweighted task means per board and over all (board null): one rollup."""
    return tasks.rollup("dataset").agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_tasks"), F.sum("n_queries").alias("n_queries"), F.sum("n_docs").alias("n_docs"))


def average_of_boards(boards: DataFrame, metric: str, names: list[str]) -> DataFrame:
    """One row: each board's value and their mean, null if a board is missing."""
    wide = boards.agg(*[F.max(F.when(F.col("dataset") == n, F.col(metric))).alias(n) for n in names])
    return wide.withColumn("avg_boards", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names))


def head_matrix(records: DataFrame, metrics: list[str]) -> DataFrame:
    """Percent by (head, dataset); null where any task lacks the metric."""
    strict = [F.when(F.count(m) == F.count("*"), 100 * F.avg(m)).alias(m) for m in metrics]
    return records.groupBy("head", "dataset").agg(*strict)


def complete(metrics: list[str]) -> Column:
    """All metrics present, finite numbers."""
    ok = F.lit(True)
    for m in metrics:
        ok = ok & F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(F.col(m)) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def finished(records: DataFrame, metrics: list[str]) -> Column:
    """Records of tasks that ended well: no error, complete metrics."""
    return complete(metrics) & (F.col("error").isNull() if "error" in records.columns else F.lit(True))


def usable(protocol: str, contract: str, metrics: list[str]) -> Column:
    """A finished task record of this protocol and contract."""
    return F.coalesce(F.col("error").isNull() & (F.col("eval_protocol") == protocol) & (F.col("eval_contract_id") == contract), F.lit(False)) & complete(metrics)


def pending(expected: DataFrame, done: DataFrame, key: str = "task") -> DataFrame:
    return expected.join(done, key, "left_anti")


def upsert(cached: DataFrame, fresh: DataFrame, key: str = "task") -> DataFrame:
    """Fresh rows win over cached ones."""
    both = cached.withColumn("__p", F.lit(0)).unionByName(fresh.withColumn("__p", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col("__p").desc())
    return both.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn", "__p")


def in_order(results: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every task of the catalogue, in its order, with its result or nulls."""
    extra = [c for c in results.columns if c not in catalogue.columns]
    return catalogue.join(results.select("task", *extra), "task", "left").orderBy("place")


def best_of(scores: DataFrame, gold: DataFrame, n: int = 3) -> DataFrame:
    """``query_id, gold, hit, top``: whether the best document is the wanted one, and the
    ``n`` best with their scores; a report for small grids."""
    top = ranked(scores).where(F.col("rank") <= n)
    listed = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("top"))
    rows = gold.select("query_id", F.col("doc_id").alias("gold")).join(listed, "query_id")
    return rows.select("query_id", "gold", (F.get("top", F.lit(0))["doc_id"] == F.col("gold")).alias("hit"), "top")


def count_mismatch(tasks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Boards whose number of tasks is not the expected one."""
    want = tasks.sparkSession.createDataFrame(list(expected.items()), "dataset string, expected long")
    got = tasks.groupBy("dataset").agg(F.count("*").alias("found"))
    rows = want.join(got, "dataset", "full").select("dataset", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return rows.where("expected <> found")
