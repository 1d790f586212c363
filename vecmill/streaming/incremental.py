"""Incremental corpora: score pages as they arrive (an extension; the batch operators are
the same).  Each micro-batch drops pages that an earlier one has scored, so a restart or a replayed
batch does no work twice, whether or not a page is among the best of any query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.maxsim import maxsim


def index_arrivals(bags: DataFrame, queries: DataFrame, index: str, checkpoint: str, top_k: int = 10):
    """Start a query that appends the scores of new bags (``doc_id, tokens`` stream) to a
    Parquet folder, one sub-folder per micro-batch; the ids of all pages that were scored
    lie beside it, in ``<index>-seen``, and are written after the scores."""
    seen = f"{index.rstrip('/')}-seen"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["doc_id"])
        jvm = spark._jvm.org.apache.hadoop.fs.Path(seen)
        if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            done = spark.read.parquet(seen).where(f"batch < {number}").select("doc_id").distinct()
            fresh = fresh.join(done, "doc_id", "left_anti")
        scores = maxsim(queries, fresh, top_k=top_k)
        scores.write.mode("overwrite").parquet(f"{index}/batch={number}")
        fresh.select("doc_id").write.mode("overwrite").parquet(f"{seen}/batch={number}")

    return bags.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
