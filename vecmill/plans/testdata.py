"""How the shared test tables stand in for retrieval data, in Spark and in SQL.

``embeddings`` become token bags: the vectors of a label in id order, eight to a bag
(``doc_id = label * 1000 + bag``); the first bag of a label is a query; a bag of the
query's label is relevant, with grade 2 if it is the next one, else 1.  Beyond 8,000 vectors
a label's bags run into the ids of the next label's: such bags are one, with several tokens
to a place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import maxsim as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str, dim: int | None = None) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").withColumn("rn", rn)
    vec = V.doubles(F.col("embedding")) if dim is None else V.prefix(F.col("embedding"), dim)
    return rows.select((F.col("label") * 1000 + F.floor(F.col("rn") / 8)).cast("long").alias("doc_id"), F.pmod("rn", F.lit(8)).cast("int").alias("tok_idx"), vec.alias("vec"), "label")


def bags(spark: SparkSession, sf_dir: str, dim: int | None = None) -> DataFrame:
    return M.nested(tokens(spark, sf_dir, dim), places=True)


def queries(all_bags: DataFrame) -> DataFrame:
    return all_bags.where(F.pmod("doc_id", F.lit(1000)) == 0).withColumnRenamed("doc_id", "query_id")


def scores(spark: SparkSession, sf_dir: str, dim: int | None = None, **options) -> DataFrame:
    b = bags(spark, sf_dir, dim)
    return M.maxsim(queries(b), b, **options)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bags(spark, sf_dir).select("doc_id")
    rows = docs.withColumn("query_id", (F.floor(F.col("doc_id") / 1000) * 1000).cast("long")).where("query_id <> doc_id")
    return rows.select("query_id", "doc_id", F.when(F.col("doc_id") - F.col("query_id") == 1, 2.0).otherwise(1.0).alias("grade"))


def candidates(all_scores: DataFrame) -> DataFrame:
    """Without the query's own bag."""
    return all_scores.where("query_id <> doc_id")


def loss_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student (32 components) and teacher (64) scores per query token; the positive of a
    query is its next bag, other bags of its label are hard negatives."""
    b64, b32 = bags(spark, sf_dir), bags(spark, sf_dir, 32)
    q64, q32 = queries(b64), queries(b32)
    student = M.length_normalized(candidates(M.maxsim(q32, b32)), q32)
    teacher = M.length_normalized(candidates(M.maxsim(q64, b64)), q64).withColumnRenamed("score", "teacher_score")
    rows = student.join(teacher, ["query_id", "doc_id"])
    same = F.floor(F.col("query_id") / 1000) == F.floor(F.col("doc_id") / 1000)
    return rows.select(
        "query_id", "doc_id", "score", "teacher_score", (F.col("doc_id") == F.col("query_id") + 1).alias("is_pos"),
        (same & (F.col("doc_id") != F.col("query_id") + 1)).alias("is_hard"), F.when(F.pmod("doc_id", F.lit(7)) == 3, 0).otherwise(1).alias("slot_mask"),
        F.floor(F.col("query_id") / 1000).cast("long").alias("query_group_id"), F.floor(F.col("doc_id") / 1000).cast("long").alias("doc_group_id"),
    )


BAGS = """bags AS (SELECT label * 1000 + rn // 8 AS doc_id, rn % 8 AS tok_idx, embedding::DOUBLE[] AS vec, label
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings))"""


def prefix_sql(dim: int) -> str:
    return f"""bags AS (SELECT doc_id, tok_idx, label, list_transform(cut, lambda x: x / greatest(sqrt(list_inner_product(cut, cut)), 1e-12)) AS vec
  FROM (SELECT label * 1000 + rn // 8 AS doc_id, rn % 8 AS tok_idx, label, (embedding::DOUBLE[])[1:{dim}] AS cut
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings)))"""


SCORES = """queries AS (SELECT doc_id AS query_id, tok_idx AS q_tok, vec AS q_vec FROM bags WHERE doc_id % 1000 = 0),
best AS (SELECT query_id, doc_id, q_tok, max(list_inner_product(q_vec, vec)) AS m, count(*) AS n_tok FROM queries, bags GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(m) AS score FROM best GROUP BY ALL)"""
QRELS = """qrels AS (SELECT DISTINCT doc_id // 1000 * 1000 AS query_id, doc_id, CASE WHEN doc_id % 1000 = 1 THEN 2.0 ELSE 1.0 END AS grade FROM bags WHERE doc_id % 1000 <> 0)"""
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE query_id <> doc_id)"""


def metrics_sql() -> str:
    """CTE ``per_query`` with all metrics."""
    cols = []
    for k in (1, 5, 10):
        cols += [
            f"coalesce(sum(CASE WHEN rank <= {k} THEN (pow(2, grade) - 1) / log2(rank + 1) END) / max(ideal_{k}), 0) AS ndcg_at_{k}",
            f"coalesce(sum(CASE WHEN rank <= {k} AND grade IS NOT NULL THEN 1.0 END) / max(n_rel), 0) AS recall_at_{k}",
            f"coalesce(sum(CASE WHEN rank <= {k} AND grade IS NOT NULL THEN found / rank END) / max(least(n_rel, {k})), 0) AS map_at_{k}",
            f"coalesce(max(CASE WHEN rank <= {k} AND grade IS NOT NULL THEN 1.0 / rank END), 0) AS mrr_at_{k}",
        ]
    ideal = ", ".join(f"sum(CASE WHEN r <= {k} THEN (pow(2, grade) - 1) / log2(r + 1) END) AS ideal_{k}" for k in (1, 5, 10))
    return f"""ideal AS (SELECT query_id, count(*) AS n_rel, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM qrels) GROUP BY 1),
hits AS (SELECT r.query_id, r.rank, q.grade, sum(CASE WHEN q.grade IS NOT NULL THEN 1.0 ELSE 0 END) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS found FROM ranked r LEFT JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id),
per_query AS (SELECT h.query_id, {", ".join(cols)} FROM hits h JOIN ideal i ON h.query_id = i.query_id GROUP BY 1)"""


LOSS = f"""{prefix_sql(32).replace("bags AS", "bags32 AS")},
{BAGS},
student AS (SELECT query_id, doc_id, sum(m) / count(*) AS score FROM (SELECT q.doc_id AS query_id, d.doc_id, q.tok_idx, max(list_inner_product(q.vec, d.vec)) AS m FROM bags32 q, bags32 d WHERE q.doc_id % 1000 = 0 GROUP BY ALL) GROUP BY ALL),
teacher AS (SELECT query_id, doc_id, sum(m) / count(*) AS teacher_score FROM (SELECT q.doc_id AS query_id, d.doc_id, q.tok_idx, max(list_inner_product(q.vec, d.vec)) AS m FROM bags q, bags d WHERE q.doc_id % 1000 = 0 GROUP BY ALL) GROUP BY ALL),
rows AS (SELECT s.query_id, s.doc_id, score, teacher_score, s.doc_id = s.query_id + 1 AS is_pos, s.query_id // 1000 = s.doc_id // 1000 AND s.doc_id <> s.query_id + 1 AS is_hard,
  CASE WHEN s.doc_id % 7 = 3 THEN 0 ELSE 1 END AS slot_mask, s.query_id // 1000 AS query_group_id, s.doc_id // 1000 AS doc_group_id
  FROM student s JOIN teacher t ON s.query_id = t.query_id AND s.doc_id = t.doc_id WHERE s.query_id <> s.doc_id)"""
