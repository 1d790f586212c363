"""Writers: results by task, dumps, judgements, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str) -> None:
    """Task results, one partition per task: rewriting some tasks leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Refuses a folder that exists."""
    df.write.mode("errorifexists").parquet(path)


def qrels_json(qrels: DataFrame) -> DataFrame:
    """One JSON object of document id to grade per query, ids in order."""
    pairs = F.array_sort(F.collect_list(F.struct("doc_id", "grade")))
    return qrels.groupBy("query_id").agg(F.to_json(F.map_from_entries(pairs)).alias("graded"))


def read_qrels_json(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.explode(F.from_json("graded", "map<string,double>")).alias("doc_id", "grade"))


def dump_tokens(bags: DataFrame, path: str) -> DataFrame:
    """Write token bags and return their statistics."""
    write_new(bags, path)
    return token_stats(bags.sparkSession.read.parquet(path))


def token_stats(bags: DataFrame, tokens: str = "tokens") -> DataFrame:
    n = F.size(tokens)
    return bags.agg(F.count("*").alias("n_docs"), F.avg(n).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Small driver file: written beside its place and put there by one rename, so that a
    reader finds the old or the new content."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target, draft = jvm.Path(path), jvm.Path(f"{path}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    context = jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(target), over)


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    write_text(spark, path, json.dumps(payload, ensure_ascii=False, indent=2) + "\n")


def archived(spark: SparkSession, path: str) -> str | None:
    """Move a folder that is not empty out of the way; its new name."""
    jvm = spark._jvm.org.apache.hadoop.fs
    old = jvm.Path(path)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(old) or not fs.listStatus(old):
        return None
    n = 1
    while fs.exists(jvm.Path(f"{path}.old{n}")):
        n += 1
    fs.rename(old, jvm.Path(f"{path}.old{n}"))
    return f"{path}.old{n}"


def markdown(df: DataFrame, decimals: int = 2) -> str:
    """A small result as a Markdown table."""
    show = lambda v: "missing" if v is None else f"{v:.{decimals}f}" if isinstance(v, float) else str(v)
    rows = [" | ".join(show(v) for v in r) for r in df.collect()]
    head = [" | ".join(df.columns), " | ".join("---" for _ in df.columns)]
    return "\n".join(f"| {r} |" for r in head + rows) + "\n"
