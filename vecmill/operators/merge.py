"""Weighted means of parameters over runs, and checks that runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_merge(values: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``param, idx, value``: mean over arms with weights scaled to sum 1.

    Every arm must have every parameter; a missing one is an error.  ``values`` has
    ``arm, param, idx, value``."""
    total = sum(weights.values())
    if min(weights.values()) < 0 or total <= 0:
        raise ValueError(f"weights must be non-negative with a positive sum: {weights}")
    w = F.coalesce(*[F.when(F.col("arm") == a, F.lit(x / total)) for a, x in weights.items()])
    rows = values.where(F.col("arm").isin(sorted(weights)))
    out = rows.groupBy("param", "idx").agg(F.sum(w * F.col("value")).alias("value"), F.countDistinct("arm").alias("__arms"))
    ok = F.when(F.col("__arms") == len(weights), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("arms differ in "), F.col("param"))).cast("double"))
    return out.select("param", "idx", ok.alias("value"))


def disagreements(configs: DataFrame, keys: list[str]) -> DataFrame:
    """From ``arm, key, value``: required keys whose values differ, or that an arm lacks."""
    arms = configs.select(F.countDistinct("arm").alias("n"))
    rows = configs.where(F.col("key").isin(keys)).groupBy("key").agg(F.countDistinct(F.coalesce("value", F.lit("null"))).alias("values"), F.countDistinct("arm").alias("arms"))
    return rows.crossJoin(arms).where("values > 1 or arms < n").select("key", "values", "arms")  # one row on the right
