"""Registered queries over the shared test tables, each with SQL that gives the same rows.

A query is one operator (or a pipeline of them) on the stand-ins of ``testdata``.  Values
are rounded to six decimals so that orders of summation do not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import compress as C
from ..operators import evaluate as E
from ..operators import index as I
from ..operators import losses as L
from ..operators import maxsim as M
from ..operators import merge as G
from ..operators import metrics as R
from ..operators import summary as Y
from ..operators import training as T
from ..sources import files as X
from ..sources import images as P
from ..sources import packed as K
from ..sources import safetensors as N
from ..sources import sinks as W
from ..sources import tables as S
from . import testdata as D

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# Scores ----------------------------------------------------------------------------

_ALL = "SELECT query_id, doc_id, round(score, 6) AS score FROM scores"


@query(f"WITH {D.BAGS}, {D.SCORES} {_ALL}")
def maxsim_scores(spark, d):
    return rounded(D.scores(spark, d), "score")


@query(f"WITH {D.BAGS}, {D.SCORES} {_ALL}")
def maxsim_scores_rows(spark, d):
    return rounded(D.scores(spark, d, strategy="rows"), "score")


@query(f"WITH {D.BAGS}, {D.SCORES} {_ALL}")
def maxsim_scores_nested(spark, d):
    return rounded(D.scores(spark, d, strategy="nested"), "score")


@query(f"WITH {D.BAGS}, {D.SCORES} SELECT query_id, doc_id, round(sum(CASE WHEN n_tok < 8 THEN greatest(m, 0) ELSE m END), 6) AS score FROM best GROUP BY ALL")
def maxsim_padded_scores(spark, d):
    return rounded(D.scores(spark, d, pad_len=8), "score")


_TOP = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10"


@query(f"WITH {D.BAGS}, {D.SCORES} {_TOP}")
def maxsim_topk(spark, d):
    return rounded(D.scores(spark, d, top_k=10), "score")


@query(f"WITH {D.BAGS}, {D.SCORES} {_TOP}")
def maxsim_tiled_topk(spark, d):
    return rounded(D.scores(spark, d, top_k=10, block=0, tile=24), "score")


@query(f"WITH {D.prefix_sql(32)}, {D.SCORES} {_TOP}")
def prefix_maxsim_topk(spark, d):
    return rounded(D.scores(spark, d, 32, top_k=10), "score")


@query(f"WITH {D.prefix_sql(16)}, {D.SCORES} {_TOP}")
def prefix16_maxsim_topk(spark, d):
    return rounded(D.scores(spark, d, 16, top_k=10), "score")


_SMOOTH = """sims AS (SELECT query_id, doc_id, q_tok, list_inner_product(q_vec, vec) AS x FROM queries, bags),
peaks AS (SELECT query_id, doc_id, q_tok, max(x) AS p FROM sims GROUP BY ALL)
SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, q_tok, 0.1 * ln(sum(exp((x - p) / 0.1))) + max(p) AS s FROM sims JOIN peaks USING (query_id, doc_id, q_tok) GROUP BY ALL) GROUP BY ALL"""


@query(f"WITH {D.BAGS}, {D.SCORES.split(',' + chr(10) + 'best')[0]}, {_SMOOTH}")
def smooth_maxsim(spark, d):
    return rounded(D.scores(spark, d, strategy="rows", tau=0.1), "score")


@query(f"WITH {D.BAGS}, {D.SCORES} SELECT query_id, doc_id, round(sum(m) / count(*), 6) AS score FROM best GROUP BY ALL")
def length_normalized_scores(spark, d):
    b = D.bags(spark, d)
    return rounded(M.length_normalized(M.maxsim(D.queries(b), b), D.queries(b)).select("query_id", "doc_id", "score"), "score")


@query(f"WITH {D.BAGS}, {D.SCORES} SELECT query_id, doc_id, round(score, 6) AS score FROM scores WHERE doc_id - query_id BETWEEN 1 AND 3")
def candidate_maxsim(spark, d):
    b = D.bags(spark, d)
    pairs = D.queries(b).select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("query_id", (F.col("query_id") + F.col("i")).alias("doc_id"))
    return rounded(M.candidate_maxsim(pairs, D.queries(b), b), "score")


# Metrics and rollups ---------------------------------------------------------------

_PER_QUERY = f"WITH {D.BAGS}, {D.SCORES}, {D.QRELS}, {D.RANKED}, {D.metrics_sql()}"


def _per_query(spark, d):
    return R.per_query(D.candidates(D.scores(spark, d)), D.qrels(spark, d))


def _metric(name):
    cols = [f"{name}_at_{k}" for k in R.KS]

    def run(spark, d):
        return rounded(_per_query(spark, d).select("query_id", *cols), *cols)

    run.__name__ = {"map": "map_at_k", "mrr": "mrr_at_k", "ndcg": "ndcg_at_k", "recall": "recall_at_k"}[name]
    query(f"{_PER_QUERY} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM per_query")(run)


for _name in R.NAMES:
    _metric(_name)

_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in R.METRICS)


@query(f"{_PER_QUERY} SELECT {_AVG}, count(*) AS n_queries FROM per_query")
def task_metrics(spark, d):
    return rounded(R.task_metrics(_per_query(spark, d)), *R.METRICS)


# Tasks of the rollups: one per query label; boards b0 .. b3 by label modulo 4.
_TASKS = f"{_PER_QUERY}, tasks AS (SELECT 'b' || (query_id // 1000 % 4) AS dataset, 't' || (query_id // 1000) AS task, {', '.join(R.METRICS)}, 1 AS n_queries, (SELECT count(DISTINCT doc_id) FROM bags) AS n_docs FROM per_query)"


def _tasks(spark, d):
    label = F.floor(F.col("query_id") / 1000)
    n = D.bags(spark, d).agg(F.count("*").alias("n_docs"))
    return _per_query(spark, d).crossJoin(n).select(F.concat(F.lit("b"), F.pmod(label, F.lit(4)).cast("string")).alias("dataset"), F.concat(F.lit("t"), label.cast("string")).alias("task"), *R.METRICS, F.lit(1).alias("n_queries"), "n_docs")  # one row on the right


@query(f"{_TASKS} SELECT dataset, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(map_at_5), 6) AS map_at_5, count(*) AS n_tasks, sum(n_queries) AS n_queries, sum(n_docs) AS n_docs FROM tasks GROUP BY ROLLUP (dataset)")
def board_rollup(spark, d):
    return rounded(R.board_rollup(_tasks(spark, d), ["ndcg_at_10", "map_at_5"]), "ndcg_at_10", "map_at_5")


@query(f"{_TASKS}, wide AS (SELECT {', '.join(f'avg(ndcg_at_10) FILTER (dataset = {chr(39)}b{i}{chr(39)}) AS b{i}' for i in range(4))} FROM tasks) SELECT {', '.join(f'round(b{i}, 6) AS b{i}' for i in range(4))}, round((b0 + b1 + b2 + b3) / 4, 6) AS avg_boards FROM wide")
def avg4_headline(spark, d):
    names = [f"b{i}" for i in range(4)]
    return rounded(R.average_of_boards(R.board_rollup(_tasks(spark, d), ["ndcg_at_10"]), "ndcg_at_10", names), *names, "avg_boards")


def _head_sql(dim):
    body = f"WITH {D.BAGS if dim == 64 else D.prefix_sql(dim)}, {D.SCORES}, {D.QRELS}, {D.RANKED}, {D.metrics_sql()}"
    return f"({body} SELECT {dim} AS head, 'b' || (query_id // 1000 % 4) AS dataset, CASE WHEN query_id = 3000 AND {dim} = 16 THEN NULL ELSE ndcg_at_10 END AS m FROM per_query)"


@query(f"SELECT head, dataset, CASE WHEN count(m) = count(*) THEN round(100 * avg(m), 6) END AS ndcg_at_10 FROM ({' UNION ALL '.join(_head_sql(k) for k in (64, 16))}) GROUP BY ALL")
def head_matrix(spark, d):
    rows = None
    for dim in (64, 16):
        got = R.per_query(D.candidates(D.scores(spark, d, None if dim == 64 else dim)), D.qrels(spark, d))
        m = F.when((F.col("query_id") == 3000) & F.lit(dim == 16), None).otherwise(F.col("ndcg_at_10"))
        part = got.select(F.lit(dim).alias("head"), F.concat(F.lit("b"), F.pmod(F.floor(F.col("query_id") / 1000), F.lit(4)).cast("string")).alias("dataset"), m.alias("ndcg_at_10"))
        rows = part if rows is None else rows.unionByName(part)
    return rounded(R.head_matrix(rows, ["ndcg_at_10"]), "ndcg_at_10")


@query("SELECT source AS task FROM documents GROUP BY 1 HAVING source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 3)")
def pending_tasks_anti(spark, d):
    docs = D.table(spark, d, "documents").select(F.col("source").alias("task"), "doc_id")
    return R.pending(docs.select("task").distinct(), docs.where("doc_id % 97 = 3"))


@query("SELECT source AS task, CASE WHEN max(doc_id) % 2 = 0 THEN 'fresh' ELSE 'cached' END AS state FROM documents GROUP BY 1")
def result_upsert(spark, d):
    last = D.table(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("m")).withColumnRenamed("source", "task")
    fresh = last.where("m % 2 = 0").select("task", F.lit("fresh").alias("state"))
    return R.upsert(last.select("task", F.lit("cached").alias("state")), fresh)


_REC = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'nan'::DOUBLE WHEN doc_id % 5 = 2 THEN 'inf'::DOUBLE ELSE n_chars::DOUBLE END AS m, CASE WHEN doc_id % 3 = 0 THEN 'failed' END AS error, lang AS p FROM documents"


@query(f"SELECT doc_id FROM ({_REC}) WHERE error IS NULL AND p = 'en' AND m IS NOT NULL AND isfinite(m)")
def usable_records(spark, d):
    k = F.pmod("doc_id", F.lit(5))
    m = F.when(k == 0, None).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(F.col("n_chars").cast("double"))
    rec = D.table(spark, d, "documents").select("doc_id", m.alias("m"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "failed").alias("error"), F.col("lang").alias("eval_protocol"), F.lit("c").alias("eval_contract_id"))
    return rec.where(R.usable("en", "c", ["m"])).select("doc_id")


@query("SELECT * FROM (SELECT coalesce(e.lang, f.lang) AS dataset, coalesce(n, 0) AS expected, coalesce(found, 0) AS found FROM (VALUES ('en', 10), ('it', 4)) e(lang, n) FULL JOIN (SELECT lang, count(DISTINCT source) AS found FROM documents GROUP BY 1) f ON e.lang = f.lang) WHERE expected <> found")
def task_count_mismatch(spark, d):
    return R.count_mismatch(D.table(spark, d, "documents").select(F.col("lang").alias("dataset"), "source").distinct(), {"en": 10, "it": 4})


# Sources ---------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def page_dedupe_first(spark, d):
    return S.first_rows(D.table(spark, d, "documents"), "text", "doc_id")


# Texts with the awkward cases of query columns, by id.
_ODD = "CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'None' WHEN 4 THEN chr(9) || 'none' || chr(10) WHEN 5 THEN ' ' || lang || ' ' ELSE source END"


def _odd(spark, d):
    k = F.pmod("doc_id", F.lit(9))
    q = F.when(k == 0, None).when(k == 1, "").when(k == 2, "  ").when(k == 3, "None").when(k == 4, "\tnone\n").when(k == 5, F.concat(F.lit(" "), "lang", F.lit(" "))).otherwise(F.col("source"))
    return D.table(spark, d, "documents").select("doc_id", q.alias("query"), F.col("source").alias("image_filename"))


@query(f"SELECT doc_id, q AS query, source AS image_filename FROM (SELECT doc_id, source, regexp_replace({_ODD}, '^\\s+|\\s+$', '', 'g') AS q FROM documents) WHERE q <> '' AND lower(q) <> 'none'")
def paired_queries_valid(spark, d):
    return S.paired_queries(_odd(spark, d))


@query(f"SELECT doc_id::VARCHAR AS query_id, coalesce(q, 'None') AS text FROM (SELECT doc_id, {_ODD} AS q FROM documents) WHERE trim(coalesce(q, 'None'), ' ' || chr(9) || chr(10)) <> '' AND lower(coalesce(q, 'None')) <> 'none' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def beir_keep_queries(spark, d):
    q = S.beir_queries(_odd(spark, d).select(F.col("doc_id").alias("id"), "query"))
    judged = D.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("query_id"))
    return S.keep_queries(q, judged)


# Judgements: every document for its source, once more for the next document's.
_RAW_QRELS = "SELECT source AS query_id, doc_id + k AS doc_id, 2 * doc_id + k AS ord, CASE (doc_id + k) % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN 'nan'::DOUBLE ELSE doc_id % 3 + 1 END::DOUBLE AS score FROM documents, range(2) r(k)"


@query(f"SELECT query_id, doc_id, max_by(g, ord) AS grade FROM (SELECT *, CASE WHEN score IS NULL OR score = 0 THEN 1 ELSE score END AS g FROM ({_RAW_QRELS})) WHERE g > 0 AND NOT isnan(g) AND doc_id IN (SELECT doc_id FROM documents) GROUP BY ALL")
def qrels_normalized(spark, d):
    docs = D.table(spark, d, "documents")
    rows = docs.select(F.col("source").alias("query_id"), "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    k = F.pmod(F.col("doc_id") + F.col("k"), F.lit(7))
    s = F.when(k == 0, None).when(k == 1, 0.0).when(k == 2, -1.0).when(k == 3, F.lit(float("nan"))).otherwise((F.pmod("doc_id", F.lit(3)) + 1).cast("double"))
    raw = rows.select("query_id", (F.col("doc_id") + F.col("k")).alias("doc_id"), (2 * F.col("doc_id") + F.col("k")).alias("ord"), s.alias("score"))
    return R.normalized_qrels(raw, docs)


@query("SELECT doc_id, tag, replace(replace(replace(tag, '/', '__'), '[', '__'), ']', '') AS slug FROM (SELECT doc_id, source || '/' || (doc_id % 3) || CASE WHEN lang = 'en' THEN '' ELSE '[' || lang || ']' END AS tag FROM documents)")
def task_tags(spark, d):
    lang = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    rows = D.table(spark, d, "documents").select("doc_id", S.task_tag(F.col("source"), F.pmod("doc_id", F.lit(3)).cast("string"), lang).alias("tag"))
    return rows.withColumn("slug", S.task_slug(F.col("tag")))


@query(f"SELECT doc_id, 'Query: ' || CASE WHEN coalesce(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), '') = '' THEN ' ' ELSE q END || repeat('<a>', 10) AS prompt FROM (SELECT doc_id, {_ODD} AS q FROM documents)")
def query_prompts(spark, d):
    return _odd(spark, d).select("doc_id", T.query_text(F.col("query"), "Query: ", "<a>").alias("prompt"))


@query(f"WITH {D.BAGS} SELECT count(*) AS n_docs, avg(n) AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM (SELECT doc_id, count(*) AS n FROM bags GROUP BY 1)")
def token_stats(spark, d):
    return W.token_stats(D.bags(spark, d))


@query(f"WITH {D.BAGS}, {D.QRELS} SELECT query_id, '{{' || string_agg('\"' || doc_id || '\":' || grade::DOUBLE, ',' ORDER BY doc_id::VARCHAR) || '}}' AS graded FROM qrels GROUP BY 1")
def qrels_json(spark, d):
    return W.qrels_json(D.qrels(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")))


# Training tables -------------------------------------------------------------------


@query("SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def source_filter(spark, d):
    return T.source_filter(D.table(spark, d, "documents"), ["src5", "src1", "src3"]).select("doc_id", "source", "lang")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def first_n_per_source(spark, d):
    return T.first_n_per_source(D.table(spark, d, "documents").select("doc_id", "source"), 5, ["doc_id"])


@query("SELECT doc_id, source, task_id FROM documents JOIN (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) - 1 AS task_id FROM documents GROUP BY 1) USING (source)")
def task_id_encode(spark, d):
    return T.task_ids(D.table(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def value_counts_source(spark, d):
    return T.value_counts(D.table(spark, d, "documents"))


# Hard negatives: of each labelled document the next ones by id that are labelled bad.
_HARD = "SELECT doc_id AS query, [doc_id, doc_id + 1] AS positive_doc_ids, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE list_transform(range(1, doc_id % 4 + 1), lambda i: doc_id + 10 * i) END AS negative_doc_ids FROM labels"


def _hard(spark, d):
    k = F.pmod("doc_id", F.lit(4))
    neg = F.when(k == 0, None).otherwise(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), lambda i: F.col("doc_id") + 10 * i))
    return D.table(spark, d, "labels").select(F.col("doc_id").alias("query"), F.array("doc_id", F.col("doc_id") + 1).alias("positive_doc_ids"), neg.alias("negative_doc_ids"))


@query(f"SELECT query, len(negative_doc_ids) AS n_neg FROM ({_HARD}) WHERE coalesce(len(negative_doc_ids) >= 2, false)")
def hardneg_valid(spark, d):
    return T.valid_hard_negatives(_hard(spark, d), 2).select("query", F.size("negative_doc_ids").alias("n_neg"))


@query(f"SELECT query, unnest(positive_doc_ids) AS positive_doc_id, len(negative_doc_ids) AS n_neg, 1.0 / len(positive_doc_ids) AS sample_weight, query AS query_group_id FROM ({_HARD})")
def allpos_expand(spark, d):
    rows = T.expand_positives(_hard(spark, d).withColumn("negative_mask", F.lit(None).cast("array<bigint>")), F.col("query"))
    return rows.select("query", "positive_doc_id", F.size("negative_doc_ids").alias("n_neg"), "sample_weight", "query_group_id")


@query("SELECT l.doc_id, l.quality, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def positive_source_join(spark, d):
    return T.strict_join(D.table(spark, d, "labels").select("doc_id", "quality"), D.table(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query("SELECT source, count(*) // 16 * 16 AS n_rows, count(*) // 16 AS n_batches FROM documents GROUP BY 1 HAVING count(*) >= 16")
def task_consistent_batches(spark, d):
    """Sizes only: the order is a hash's."""
    rows = T.task_consistent_batches(D.table(spark, d, "documents").select("doc_id", "source"), 16, 42, "doc_id", "source")
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("batch_id").alias("n_batches"))


@query("SELECT source, r AS rank, count(*) // 16 * 4 AS n_rows, count(*) // 16 AS n_batches, 1 AS tasks_a_batch, (SELECT sum(n // 16) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) AS batches FROM documents, range(4) t(r) GROUP BY ALL HAVING count(*) >= 16")
def rank_slices(spark, d):
    rows = T.rank_batches(D.table(spark, d, "documents").select("doc_id", "source"), 16, 4, 7, "doc_id", task="source")
    tasks = rows.groupBy("batch_no").agg(F.countDistinct("source").alias("tasks"))
    whole = tasks.agg(F.max("tasks").alias("tasks_a_batch"), (F.max("batch_no") + 1).alias("batches"))  # one row
    return rows.groupBy("source", "rank").agg(F.count("*").alias("n_rows"), F.countDistinct("batch_no").alias("n_batches")).crossJoin(whole)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn <= n // 16 * 16")
def truncate_to_batches(spark, d):
    return T.truncate_to_batches(D.table(spark, d, "documents").select("doc_id", "source"), 16, ["doc_id"])


@query("SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def last_row_wins(spark, d):
    return T.last_wins(D.table(spark, d, "documents").select("text", "doc_id"), "text", "doc_id")


# Vectors and compression -----------------------------------------------------------


@query("SELECT vec_id, i, round(x / greatest(n, 1e-8), 6) AS x FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(v) AS x, n FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda e: e * (label + 1)) AS v, sqrt(list_inner_product(v, v)) AS n FROM embeddings))")
def l2_normalized(spark, d):
    v = F.transform(V.doubles(F.col("embedding")), lambda x: x * (F.col("label") + 1))
    rows = D.table(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2(v, V.POOL_EPS)).alias("i", "x"))
    return rounded(rows, "x")


# Grids: a full bag is 2 x 4 cells, a short one 1 x n.
_POS = """grid AS (SELECT doc_id, tok_idx, vec, CASE WHEN n = 8 THEN 2 ELSE 1 END AS h, CASE WHEN n = 8 THEN 4 ELSE n END AS w FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM bags)),
pos AS (SELECT *, CASE WHEN w > 1 THEN (tok_idx % w) / (w - 1) ELSE 0 END::DOUBLE AS x, CASE WHEN h > 1 THEN (tok_idx // w) / (h - 1) ELSE 0 END::DOUBLE AS y FROM grid)"""
_SIN = """freq AS (SELECT list_transform(range(0, 16), lambda i: pow(10000.0, -i / 15.0)) AS f),
enc AS (SELECT doc_id, tok_idx, vec, list_concat(list_concat(list_transform(f, lambda w: sin(x / w)), list_transform(f, lambda w: cos(x / w))), list_concat(list_transform(f, lambda w: sin(y / w)), list_transform(f, lambda w: cos(y / w)))) AS e FROM pos, freq),
encoded AS (SELECT doc_id, tok_idx, vec, list_transform(e, lambda c: c / greatest(sqrt(list_inner_product(e, e)), 1e-8)) AS p FROM enc)"""
_FUSE = """mixed AS (SELECT doc_id, tok_idx, list_transform(list_zip(vec, p), lambda z: 0.9 * z[1] / greatest(sqrt(list_inner_product(vec, vec)), 1e-8) + 0.1 * z[2]) AS m FROM encoded),
fused AS (SELECT doc_id, tok_idx, list_transform(m, lambda c: c / greatest(sqrt(list_inner_product(m, m)), 1e-8)) AS v FROM mixed)"""


def _grid(spark, d):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("doc_id"))
    t = D.tokens(spark, d).withColumn("n", n)
    return t.withColumn("height", F.when(F.col("n") == 8, 2).otherwise(1)).withColumn("width", F.when(F.col("n") == 8, 4).otherwise(F.col("n")))


@query(f"WITH {D.BAGS}, {_POS} SELECT doc_id, tok_idx, round(x, 6) AS x, round(y, 6) AS y FROM pos")
def position_features(spark, d):
    x, y = V.grid_position(F.col("tok_idx"), F.col("height"), F.col("width"))
    return rounded(_grid(spark, d).select("doc_id", "tok_idx", x.alias("x"), y.alias("y")), "x", "y")


@query(f"WITH {D.BAGS}, {_POS}, {_SIN} SELECT doc_id, tok_idx, unnest(range(0, 64)) AS i, round(unnest(p), 6) AS x FROM encoded")
def sinusoidal_position(spark, d):
    x, y = V.grid_position(F.col("tok_idx"), F.col("height"), F.col("width"))
    p = _grid(spark, d).select("doc_id", "tok_idx", V.sinusoidal(x, y, 64).alias("p"))
    return rounded(p.select("doc_id", "tok_idx", F.posexplode("p").alias("i", "x")), "x")


@query(f"WITH {D.BAGS}, {_POS}, {_SIN}, {_FUSE} SELECT doc_id, tok_idx, unnest(range(0, 64)) AS i, round(unnest(v), 6) AS x FROM fused")
def fused_vectors(spark, d):
    v = C.fused_tokens(_grid(spark, d), 0.1, 64)
    return rounded(v.select("doc_id", "tok_idx", F.posexplode("fused").alias("i", "x")), "x")


@query(f"WITH {D.BAGS}, means AS (SELECT doc_id, tok_idx // 3 AS cluster_id, i, avg(x) AS m, count(*) AS n FROM (SELECT doc_id, tok_idx, unnest(range(0, 64)) AS i, unnest(vec) AS x FROM bags) GROUP BY ALL), norms AS (SELECT doc_id, cluster_id, greatest(sqrt(sum(m * m)), 1e-8) AS z FROM means GROUP BY ALL) SELECT doc_id, cluster_id, i, round(m / z, 6) AS x, n AS n_members FROM means JOIN norms USING (doc_id, cluster_id)")
def mean_pool_assignment(spark, d):
    rows = D.tokens(spark, d).withColumn("cluster_id", F.floor(F.col("tok_idx") / 3).cast("int"))
    return rounded(C.pool(rows).select("doc_id", "cluster_id", F.posexplode("vec").alias("i", "x"), "n_members"), "x")


@query(None)
def ward_assignment(spark, d):
    return C.assign(_grid(spark, d), 4)


@query(None)
def compressed_index_topk(spark, d):
    index = C.compress(_grid(spark, d), C.Recipe(budget=4)).select("doc_id", F.col("cluster_id").alias("tok_idx"), "vec")
    b = D.bags(spark, d)
    return rounded(M.maxsim(D.queries(b), M.nested(index), top_k=10, pad_len=4), "score")


# With one vector less than tokens a clustering is one merge, of the nearest fused pair.
_ONE = f"""{_POS}, {_SIN}, {_FUSE},
near AS (SELECT a.doc_id, min_by((a.tok_idx, b.tok_idx), list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS pair FROM fused a JOIN fused b ON a.doc_id = b.doc_id AND a.tok_idx < b.tok_idx GROUP BY 1),
sizes AS (SELECT doc_id, count(*) AS n FROM bags GROUP BY 1),
labels AS (SELECT b.doc_id, b.tok_idx, vec, CASE WHEN n < 8 OR tok_idx < pair[2] THEN tok_idx WHEN tok_idx = pair[2] THEN pair[1] ELSE tok_idx - 1 END AS cluster_id FROM bags b JOIN sizes USING (doc_id) LEFT JOIN near USING (doc_id))"""


@query(f"WITH {D.BAGS}, {_ONE} SELECT doc_id, tok_idx, cluster_id FROM labels")
def ward_one_merge(spark, d):
    return C.assign(_grid(spark, d), 7, places=True)


_POOLED = """means AS (SELECT doc_id, cluster_id, i, avg(x) AS m FROM (SELECT doc_id, cluster_id, unnest(range(0, 64)) AS i, unnest(vec) AS x FROM labels) GROUP BY ALL),
stored AS (SELECT doc_id, cluster_id, list_transform(v, lambda c: c / greatest(sqrt(list_inner_product(v, v)), 1e-8)) AS vec FROM (SELECT doc_id, cluster_id, list(m ORDER BY i) AS v FROM means GROUP BY ALL)),
queries AS (SELECT doc_id AS query_id, tok_idx AS q_tok, vec AS q_vec FROM bags WHERE doc_id % 1000 = 0),
best AS (SELECT query_id, doc_id, q_tok, max(list_inner_product(q_vec, vec)) AS m, count(*) AS n_tok FROM queries, stored GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(CASE WHEN n_tok < 7 THEN greatest(m, 0) ELSE m END) AS score FROM best GROUP BY ALL)"""


@query(f"WITH {D.BAGS}, {_ONE}, {_POOLED} {_TOP}")
def compressed_one_merge_topk(spark, d):
    """Search in a checked index with the floor of its padding."""
    recipe = C.Recipe(budget=7)
    index = I.checked_index(C.compress(_grid(spark, d), recipe, places=True), recipe.budget, recipe.dim)
    return rounded(M.maxsim(D.queries(D.bags(spark, d)), I.index_bags(index), top_k=10, pad_len=7), "score")


@query(f"{_PER_QUERY.replace(D.SCORES, _ONE + ', ' + _POOLED)} SELECT {_AVG}, count(*) AS n_queries, (SELECT count(DISTINCT doc_id) FROM bags) AS n_docs, 7 AS doc_tokens, 8 AS query_tokens FROM per_query")
def index_score_task(spark, d):
    index = I.checked_index(C.compress(_grid(spark, d), C.Recipe(budget=7), places=True), 7, 64)
    q = D.queries(D.bags(spark, d))
    row = I.score_task(q, I.index_bags(index), D.qrels(spark, d), 7, candidates=F.col("query_id") != F.col("doc_id"))
    return rounded(row, *R.METRICS)


@query(f"WITH {D.BAGS}, n AS (SELECT doc_id, count(*) AS n FROM bags GROUP BY 1) SELECT count(*) AS n_pages, round(avg(least(n, 4)), 6) AS avg_stored, min(least(n, 4)) AS min_stored, max(least(n, 4)) AS max_stored, sum((n < 4)::INT) AS below_budget, round(avg(least(n, 4)) * 64 * 2 * 1e6 / pow(2, 30), 6) AS gib_per_million, round(avg(n), 6) AS avg_tokens FROM n")
def compression_stats(spark, d):
    """Of a compressed index: Ward clustering leaves as many vectors as the budget allows."""
    t = _grid(spark, d)
    return rounded(I.index_stats(C.compress(t, C.Recipe(budget=4)), t, 4, 64), "avg_stored", "gib_per_million", "avg_tokens")


@query(f"WITH {D.BAGS}, n AS (SELECT doc_id, count(*) AS n_tokens, count(DISTINCT tok_idx // 3) AS n_clusters FROM bags GROUP BY 1) SELECT * FROM n WHERE n_clusters <> least(n_tokens, 4)")
def cluster_check(spark, d):
    return I.checked_clusters(D.tokens(spark, d).select("doc_id", F.floor(F.col("tok_idx") / 3).cast("int").alias("cluster_id")), 4)



_MASKS = f"WITH {D.BAGS}, masks AS (SELECT doc_id, tok_idx, (tok_idx * 3 + doc_id) % 8 BETWEEN 2 AND 5 AS m FROM bags)"


@query(f"{_MASKS} SELECT doc_id, min(tok_idx) FILTER (m) AS image_start, max(tok_idx) FILTER (m) + 1 AS image_end, coalesce(max(tok_idx) FILTER (m) + 1 - min(tok_idx) FILTER (m) = count(*) FILTER (m), false) AS valid FROM masks GROUP BY 1")
def image_span(spark, d):
    t = D.tokens(spark, d).withColumn("m", (F.pmod(F.col("tok_idx") * 3 + F.col("doc_id"), F.lit(8))).between(2, 5))
    masks = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tok_idx", "m"))).alias("r"))
    start, end, valid = C.image_span(F.col("r")["m"], F.col("r")["tok_idx"])
    return masks.select("doc_id", start.alias("image_start"), end.alias("image_end"), valid.alias("valid"))


_SMALL = f"WITH {D.prefix_sql(16)}, {D.SCORES}, {D.QRELS}, {D.RANKED}, {D.metrics_sql()}"
_BOARD = "SELECT 'b' || (query_id // 1000 % 4) AS dataset, avg(ndcg_at_10) AS v FROM per_query GROUP BY 1"


@query(f"WITH raw AS ({_PER_QUERY} {_BOARD}), small AS ({_SMALL} {_BOARD}) SELECT dataset, round(100 * raw.v, 6) AS raw_pct, round(100 * small.v, 6) AS compressed_pct, round(100 * (small.v - raw.v), 6) AS delta_pct FROM raw FULL JOIN small USING (dataset)")
def ladder(spark, d):
    """Whole vectors against their first 16 components."""
    board = F.concat(F.lit("b"), F.pmod(F.floor(F.col("query_id") / 1000), F.lit(4)).cast("string")).alias("dataset")
    one = lambda dim: R.per_query(D.candidates(D.scores(spark, d, dim)), D.qrels(spark, d)).groupBy(board).agg(F.avg("ndcg_at_10").alias("v"))
    return rounded(C.ladder(one(None), one(16), "v"), "raw_pct", "compressed_pct", "delta_pct")


@query(f"WITH w AS (SELECT head, dataset, CASE WHEN count(m) = count(*) THEN round(100 * avg(m), 6) END AS v FROM ({' UNION ALL '.join(_head_sql(k) for k in (64, 16))}) GROUP BY ALL) SELECT dataset, max(v) FILTER (head = 64) AS d64, max(v) FILTER (head = 16) AS d16 FROM w GROUP BY 1")
def head_table(spark, d):
    board = F.concat(F.lit("b"), F.pmod(F.floor(F.col("query_id") / 1000), F.lit(4)).cast("string")).alias("dataset")

    def one(dim: int) -> DataFrame:
        got = R.per_query(D.candidates(D.scores(spark, d, None if dim == 64 else dim)), D.qrels(spark, d))
        m = F.when((F.col("query_id") == 3000) & F.lit(dim == 16), None).otherwise(F.col("ndcg_at_10"))
        return got.select(board, m.alias("ndcg_at_10"))

    return rounded(Y.head_table(E.by_head([64, 16], one), "ndcg_at_10", [64, 16]), "d64", "d16")


@query(f"{_TASKS}, c AS (SELECT 'b' || (label % 5) AS dataset, label FROM (SELECT DISTINCT label FROM embeddings)), done AS (SELECT dataset, count(*) AS n_subsets, sum(n_queries) AS n_queries, sum(n_docs) AS n_docs, avg(ndcg_at_10) AS m FROM tasks GROUP BY 1) SELECT dataset, coalesce(max(n_subsets), 0) AS n_subsets, count(*) AS n_subsets_expected, max(n_queries) AS n_queries, max(n_docs) AS n_docs, round(max(m), 6) AS ndcg_at_10 FROM c LEFT JOIN done USING (dataset) GROUP BY 1")
def summary_boards(spark, d):
    """Of a catalogue that has one board more than the results."""
    labels = D.table(spark, d, "embeddings").select("label").distinct()
    wanted = labels.select(F.concat(F.lit("b"), F.pmod("label", F.lit(5)).cast("string")).alias("dataset"), F.col("label").alias("place"))
    return rounded(Y.boards(_tasks(spark, d), wanted, ["ndcg_at_10"]), "ndcg_at_10")


# Evaluation ------------------------------------------------------------------------

# A paired table: each bag is a row, every fifth repeats the page before; a third of the
# rows has no query, the others ask for the first bag of the label.
_PAIRED = """rows AS (SELECT DISTINCT doc_id AS ord, CASE WHEN doc_id % 1000 % 5 = 4 THEN doc_id - 1 ELSE doc_id END AS page, doc_id // 1000 * 1000 AS ask FROM bags),
pages AS (SELECT DISTINCT page FROM rows),
judged AS (SELECT 'q' || ord AS query_id, ask, page FROM rows WHERE ord % 1000 % 3 <> 0),
scores AS (SELECT query_id, doc_id, sum(m) AS score FROM (SELECT query_id, 'p' || p.page AS doc_id, q.tok_idx, max(list_inner_product(q.vec, b.vec)) AS m FROM judged j JOIN bags q ON q.doc_id = j.ask, pages p JOIN bags b ON b.doc_id = p.page GROUP BY ALL) GROUP BY ALL),
qrels AS (SELECT query_id, 'p' || page AS doc_id, 1.0 AS grade FROM judged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)"""


def _paired(spark, d):
    bag, b = F.col("doc_id"), F.pmod("doc_id", F.lit(1000))
    ask = ((F.col("doc_id") / 1000).cast("long") * 1000).cast("string")
    text = F.when(b % 3 == 0, F.when(b % 2 == 0, " None ")).when(b % 3 == 1, F.concat(F.lit(" "), ask, F.lit("\n"))).otherwise(ask)
    page = F.when(b % 5 == 4, bag - 1).otherwise(bag)
    return D.bags(spark, d).select(bag.alias("ord"), text.alias("query"), F.concat(F.lit("p"), page.cast("string")).alias("image_filename"))


def _encoders(spark, d):
    """Bags by the number in a page's or a query's name."""
    known = D.bags(spark, d).withColumnRenamed("doc_id", "bag")
    pages = lambda df: df.withColumn("bag", F.regexp_extract("doc_id", "[0-9]+", 0).cast("long")).join(known, "bag").select("doc_id", "tokens")
    asked = lambda df: df.withColumn("bag", F.col("text").cast("long")).join(known, "bag").select("query_id", "tokens", "places")
    return pages, asked


@query(f"WITH {D.BAGS}, {_PAIRED}, {D.metrics_sql()} SELECT {_AVG}, count(*) AS n_queries, (SELECT count(*) FROM pages) AS n_docs FROM per_query")
def evaluate_paired(spark, d):
    return rounded(E.evaluate_paired(_paired(spark, d), *_encoders(spark, d)), *R.METRICS)


# Judged triples: ids fall back from one column to the next and to the row's number.
_BEIR = """corpus AS (SELECT DISTINCT doc_id AS bag, CASE WHEN doc_id % 4 <> 3 THEN 'x' WHEN doc_id % 8 <> 7 THEN 'y' ELSE 'c' END || doc_id AS doc_id, doc_id // 1000 AS label FROM bags),
asks AS (SELECT DISTINCT 'q' || label AS query_id, label FROM corpus WHERE label % 7 <> 6),
qrels AS (SELECT query_id, doc_id, CASE WHEN bag % 3 = 2 THEN 2.0 ELSE 1.0 END AS grade FROM asks JOIN corpus USING (label) WHERE bag % 5 <> 4 AND bag % 1000 > 0),
judged AS (SELECT * FROM asks WHERE query_id IN (SELECT query_id FROM qrels)),
scores AS (SELECT query_id, doc_id, sum(m) AS score FROM (SELECT query_id, c.doc_id, q.tok_idx, max(list_inner_product(q.vec, b.vec)) AS m FROM judged j JOIN bags q ON q.doc_id = j.label * 1000, corpus c JOIN bags b ON b.doc_id = c.bag GROUP BY ALL) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)"""


@query(f"WITH {D.BAGS}, {_BEIR}, {D.metrics_sql()} SELECT {_AVG}, count(*) AS n_queries, (SELECT count(*) FROM corpus) AS n_docs FROM per_query")
def evaluate_beir(spark, d):
    bag = F.col("doc_id")
    rows = D.bags(spark, d).select("doc_id")
    corpus = rows.select(F.when(bag % 4 != 3, F.concat(F.lit("x"), bag.cast("string"))).alias("corpus-id"), F.when(bag % 8 != 7, F.concat(F.lit("y"), bag.cast("string"))).alias("id"), bag.alias("ord"))
    label = (bag / 1000).cast("long")
    asks = rows.where(bag % 1000 == 0).select(F.concat(F.lit("q"), label.cast("string")).alias("id"), F.when(label % 7 != 6, bag.cast("string")).alias("text"), bag.alias("ord"))
    name = F.concat(F.when(bag % 4 != 3, "x").when(bag % 8 != 7, "y").otherwise("c"), bag.cast("string"))
    score = F.when(bag % 5 == 4, -1.0).when(bag % 3 == 0, None).when(bag % 3 == 1, 0.0).otherwise(2.0)
    judged = rows.where(bag % 1000 > 0).select(F.concat(F.lit("q"), label.cast("string")).alias("query-id"), name.alias("corpus-id"), score.alias("score"), (2 * bag).alias("ord"))
    lost = judged.withColumns({"corpus-id": F.lit("unknown"), "ord": F.col("ord") + 1})
    return rounded(E.evaluate_beir(corpus, asks, judged.unionByName(lost), *_encoders(spark, d)), *R.METRICS)


@query("SELECT doc_id, min(ord) AS ord FROM (SELECT source || lang AS doc_id, doc_id AS ord FROM documents) GROUP BY 1 ORDER BY 2 LIMIT 20")
def candidate_pages_limit(spark, d):
    rows = D.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat("source", "lang").alias("image_filename"))
    return S.candidate_pages(rows, max_docs=20).select("doc_id", "ord")


@query(f"WITH q AS (SELECT doc_id, source || lang AS page, regexp_replace({_ODD}, '^\\s+|\\s+$', '', 'g') AS t FROM documents) SELECT 'q' || doc_id AS query_id, t AS text, page AS doc_id, doc_id AS ord FROM q WHERE t <> '' AND lower(t) <> 'none' AND page IN (SELECT page FROM q WHERE doc_id % 11 = 1)")
def page_lookup(spark, d):
    rows = _odd(spark, d).join(D.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("ord"), "query", F.concat("image_filename", "lang").alias("image_filename"))
    return S.paired_judged(rows, S.candidate_pages(rows.where("ord % 11 = 1")))


@query(f"WITH {D.BAGS}, {D.SCORES}, {D.RANKED} SELECT query_id, query_id + 1 AS gold, max(doc_id) FILTER (rank = 1) = query_id + 1 AS hit, max(doc_id) FILTER (rank = 1) AS first, max(doc_id) FILTER (rank = 2) AS second, max(doc_id) FILTER (rank = 3) AS third FROM ranked GROUP BY 1")
def best_three(spark, d):
    s = D.candidates(D.scores(spark, d))
    rows = R.best_of(s, s.select("query_id", (F.col("query_id") + 1).alias("doc_id")).distinct())
    return rows.select("query_id", "gold", "hit", *[F.get("top", F.lit(i))["doc_id"].alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("SELECT concat(source, '/', lang) AS task, lang AS dataset, row_number() OVER (ORDER BY source, lang) - 1 AS place, CASE WHEN n % 2 = 0 THEN n END AS n FROM (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)")
def results_in_order(spark, d):
    from pyspark.sql import Window

    n = D.table(spark, d, "documents").where("source is not null and lang is not null").groupBy("source", F.col("lang").alias("dataset")).agg(F.count("*").alias("n"))
    n = n.withColumn("task", F.concat_ws("/", "source", "dataset"))
    listed = n.select("task", "dataset", (F.row_number().over(Window.orderBy("source", "dataset")) - 1).alias("place"))  # a catalogue
    return R.in_order(n.where("n % 2 = 0").select("task", "n"), listed)


@query("SELECT count(DISTINCT source || lang) AS completed_tasks, count(DISTINCT lang) AS unique_corpora, sum(n) AS n_docs_sum, sum(q) AS n_queries_sum, 1000 AS expected_tasks, 'partial' AS status FROM (SELECT source, lang, count(*) AS n, count(DISTINCT text) AS q FROM documents GROUP BY ALL)")
def dump_counters(spark, d):
    done = D.table(spark, d, "documents").groupBy("source", F.col("lang").alias("corpus_id")).agg(F.count("*").alias("n_docs"), F.countDistinct("text").alias("n_queries"))
    return I.dump_counters(done, 1000)


# Token masks and layouts -----------------------------------------------------------

_N = f"WITH {D.BAGS}, n AS (SELECT doc_id, count(*) AS n FROM bags GROUP BY 1)"


@query(f"{_N} SELECT doc_id, n - least(n, doc_id % 4) AS n_left, CASE WHEN doc_id % 4 >= n THEN 0 ELSE n END AS n_right FROM n")
def trimmed_bags(spark, d):
    """The first tokens of a bag are padding: none from its right end unless all are."""
    pad = F.col("tok_idx") < F.pmod("doc_id", F.lit(4))
    t = D.tokens(spark, d).withColumn("vec", F.when(pad, F.transform("vec", lambda x: x * 0)).otherwise(F.col("vec")))
    return M.nested(t).select("doc_id", F.size(V.trim_padding(F.col("tokens"))).alias("n_left"), F.size(V.trim_padding(F.col("tokens"), side="right")).alias("n_right"))


@query(f"WITH {D.BAGS} SELECT doc_id, tok_idx, unnest(range(0, 64)) AS i, round(unnest(list_transform(vec, lambda c: CASE WHEN (tok_idx + doc_id) % 3 = 0 THEN c ELSE 0 END)), 6) AS x FROM bags")
def non_image_zeroed(spark, d):
    bags = M.nested(D.tokens(spark, d))
    ids = F.transform("tokens", lambda t, i: F.pmod(i + F.col("doc_id"), F.lit(3)))
    rows = bags.select("doc_id", F.posexplode(V.zeroed(F.col("tokens"), V.image_mask(ids, 0))).alias("tok_idx", "vec"))
    return rounded(rows.select("doc_id", "tok_idx", F.posexplode("vec").alias("i", "x")), "x")


@query(
    "WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(128 + 256 * x::DOUBLE)))) AS v FROM embeddings) "
    "SELECT vec_id, 4 AS width, 4 AS height, c AS cell, floor((v[base + 1] + v[base + 2] + v[base + 9] + v[base + 10]) / 4 + 0.5)::INT AS value FROM (SELECT vec_id, v, c, c // 4 * 16 + c % 4 * 2 AS base FROM p, range(16) t(c))"
)
def decoded_pages(spark, d):
    """Vectors as grey pictures of eight by eight, decoded and brought to four by four."""
    grey = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * x.cast("double")))).cast("int")
    body = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(grey(x)), 2, "0")), "")
    pages = D.table(spark, d, "embeddings").select("vec_id", F.unhex(F.concat(F.hex(F.lit("P5 8 8 255\n")), body)).alias("image"), F.lit(4).alias("w"), F.lit(4).alias("h"))
    cells = P.decoded(pages, size=("w", "h"), rows=256).select("vec_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("cell"), "pixels")
    red = F.conv(F.hex(F.substring("pixels", F.col("cell") * 3 + 1, F.lit(1))), 16, 10).cast("int")
    return cells.select("vec_id", "width", "height", "cell", red.alias("value"))


_SIZES = "SELECT doc_id, (n_chars % 9000 + 20)::DOUBLE AS w, (doc_id % 7000 + 20)::DOUBLE AS h FROM documents"


@query(
    f"WITH s AS ({_SIZES}), r AS (SELECT *, greatest(32, round_even(w / 32, 0) * 32) AS rw, greatest(32, round_even(h / 32, 0) * 32) AS rh, sqrt(h * w / 16777216) AS down, sqrt(65536 / (h * w)) AS up FROM s) "
    "SELECT doc_id, CASE WHEN rw * rh > 16777216 THEN greatest(1, floor(w / down / 32)) WHEN rw * rh < 65536 THEN ceil(w * up / 32) ELSE rw / 32 END::INT AS across, CASE WHEN rw * rh > 16777216 THEN greatest(1, floor(h / down / 32)) WHEN rw * rh < 65536 THEN ceil(h * up / 32) ELSE rh / 32 END::INT AS down FROM r"
)
def image_patches(spark, d):
    w, h = F.col("n_chars") % 9000 + 20, F.col("doc_id") % 7000 + 20
    across, down = V.patches(w.cast("double"), h.cast("double"))
    return D.table(spark, d, "documents").select("doc_id", across.alias("across"), down.alias("down"))


@query("SELECT doc_id, dataset FROM (SELECT doc_id, lang AS dataset, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')) WHERE rn <= n // 16 * 16")
def concatenated_datasets(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "lang")
    return T.concatenated({x: docs.where(F.col("lang") == x).select("doc_id") for x in ("de", "en", "es", "fr")}, 16, ["doc_id"])


@query("SELECT a.doc_id // 16 AS batch_id, a.doc_id AS row_a, b.doc_id AS row_b FROM documents a JOIN documents b ON a.doc_id // 16 = b.doc_id // 16 AND a.source = b.source AND a.doc_id <> b.doc_id")
def group_positives(spark, d):
    rows = D.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 16).alias("batch_id"), F.col("source").alias("query_group_id"), F.col("doc_id").alias("row_id"))
    return T.group_positives(rows)


# Losses ----------------------------------------------------------------------------


def _softmax_sql(name: str, x: str, key: str = "query_id", source: str = "rows") -> str:
    """CTE with ``name``: log softmax of an expression over a key."""
    return f"{name}_x AS (SELECT *, {x} AS x FROM {source}), {name}_p AS (SELECT *, max(x) OVER (PARTITION BY {key}) AS peak FROM {name}_x), {name}_t AS (SELECT * EXCLUDE (x, peak), x - peak - ln(sum(exp(x - peak)) OVER (PARTITION BY {key})) AS {name} FROM {name}_p)"


@query(f"WITH {D.LOSS}, {_softmax_sql('lp', 'score / 0.02')} SELECT query_id, round(-lp, 6) AS loss FROM lp_t WHERE is_pos")
def infonce_loss(spark, d):
    return rounded(L.info_nce(D.loss_table(spark, d)), "loss")


_POSQ = "pos AS (SELECT query_id, score AS ps, teacher_score AS pt FROM rows WHERE is_pos)"


@query(f"WITH {D.LOSS}, {_POSQ}, hot AS (SELECT r.* REPLACE (CASE WHEN NOT is_pos AND score > 0.95 * ps THEN 0.5 * score ELSE score END AS score) FROM rows r JOIN pos USING (query_id)), {_softmax_sql('lp', 'score / 0.02', source='hot')} SELECT query_id, round(-lp, 6) AS loss FROM lp_t WHERE is_pos")
def filtered_infonce_loss(spark, d):
    return rounded(L.info_nce(L.filter_high_negatives(D.loss_table(spark, d))), "loss")


@query(f"WITH {D.LOSS}, kept AS (SELECT * FROM rows WHERE is_pos OR query_group_id <> doc_group_id), {_softmax_sql('lp', 'score / 0.02', source='kept')} SELECT query_id, round(-lp, 6) AS loss FROM lp_t WHERE is_pos")
def group_masked_infonce(spark, d):
    return rounded(L.info_nce(L.same_group_mask(D.loss_table(spark, d))), "loss")


_SOFTPLUS = "(greatest((score - ps) / 0.02, 0) + ln(1 + exp(-abs((score - ps) / 0.02))))"
_HARDLOSS = f"hard AS (SELECT query_id, sum({_SOFTPLUS} * slot_mask) / greatest(sum(slot_mask), 1) AS loss FROM rows JOIN pos USING (query_id) WHERE is_hard GROUP BY 1)"


@query(f"WITH {D.LOSS}, {_POSQ}, {_HARDLOSS} SELECT query_id, round(loss, 6) AS loss FROM hard")
def hardneg_softplus_loss(spark, d):
    return rounded(L.hard_negative_softplus(D.loss_table(spark, d).where("is_pos or is_hard")), "loss")


@query(
    f"WITH {D.LOSS}, {_POSQ}, {_HARDLOSS}, easy AS (SELECT r.* REPLACE (CASE WHEN NOT is_pos AND score > 0.95 * ps THEN 0.5 * score ELSE score END AS score) FROM rows r JOIN pos USING (query_id) WHERE NOT is_hard), {_softmax_sql('lp', 'score / 0.02', source='easy')}, "
    "w AS (SELECT query_id, 1.0 / (1 + query_id // 1000 % 3) AS weight FROM pos) SELECT round(sum(weight * (hard.loss * 0.5 - lp * 0.5)) / greatest(sum(weight), 1e-6), 6) AS loss FROM hard JOIN lp_t USING (query_id) JOIN w USING (query_id) WHERE is_pos"
)
def weighted_task_loss(spark, d):
    loss = L.task_loss(D.loss_table(spark, d)).withColumn("weight", 1.0 / (1 + F.pmod(F.floor(F.col("query_id") / 1000), F.lit(3))))
    return rounded(L.weighted_mean(loss, "weight"), "loss")


@query(f"WITH {D.LOSS}, graded AS (SELECT *, doc_id % 4 AS grade FROM rows), {_softmax_sql('lq', 'score / 0.02', source='graded')}, {_softmax_sql('lp', 'grade / 1.0', source='lq_t')} SELECT round(sum(exp(lp) * (lp - lq)) / count(DISTINCT query_id), 6) AS loss FROM lp_t")
def listwise_kl(spark, d):
    return rounded(L.listwise_kl(D.loss_table(spark, d).withColumn("grade", F.pmod("doc_id", F.lit(4)).cast("double"))), "loss")


def _confidence_sql(key, tie):
    return f"{_softmax_sql('tp', 'teacher_score / 0.13', key)}, conf AS (SELECT {key}, (0.1 + 0.9 * least(greatest(1 - (-sum(exp(tp) * tp)) / ln(greatest(count(*), 2)), 0), 1)) * CASE WHEN max_by(is_pos, (tp, -{tie})) THEN 1.0 ELSE 0.25 END AS confidence FROM tp_t GROUP BY 1)"


@query(f"WITH {D.LOSS}, {_confidence_sql('query_id', 'doc_id')} SELECT query_id, round(confidence, 6) AS confidence FROM conf")
def teacher_confidence(spark, d):
    return rounded(L.teacher_confidence(D.loss_table(spark, d)), "confidence")


def _kl_sql(key, tie):
    return f"WITH {D.LOSS}, {_confidence_sql(key, tie)}, {_softmax_sql('lq', 'score / 0.13', key, 'tp_t')} SELECT {key}, round(sum(exp(tp) * (tp - lq)) * max(confidence), 6) AS loss FROM lq_t JOIN conf USING ({key}) GROUP BY 1"


@query(_kl_sql("query_id", "doc_id"))
def ard_row_kl(spark, d):
    return rounded(L.relation_kl(D.loss_table(spark, d)), "loss")


@query(_kl_sql("doc_id", "query_id"))
def ard_column_kl(spark, d):
    return rounded(L.relation_kl(D.loss_table(spark, d), "doc_id", "query_id"), "loss")


# Masks and towers: every document with id 3 or 5 modulo 11 is a known positive.
_MASKED = "NOT is_pos AND (doc_id % 11 IN (3, 5) OR CASE WHEN is_hard THEN slot_mask <= 0 ELSE query_group_id = doc_group_id END)"


def _masked(spark, d):
    rows = D.loss_table(spark, d)
    return L.candidate_masks(rows, rows.where("doc_id % 11 in (3, 5)").select("query_id", "doc_id"))


@query(f"WITH {D.LOSS} SELECT query_id, doc_id, {_MASKED} AS masked FROM rows")
def candidate_masks(spark, d):
    return _masked(spark, d).select("query_id", "doc_id", "masked")


def _relation_sql(mask: str) -> str:
    """Row and column terms of masked logits, averaged; SQL of ``relation_loss``."""
    logits = f"z AS (SELECT *, {mask} AS masked, CASE WHEN {mask} THEN -10000 ELSE teacher_score / 0.13 END AS p, CASE WHEN {mask} THEN -10000 ELSE score / 0.13 END AS q FROM rows)"

    def one(key: str, tie: str) -> str:
        return (
            f"(SELECT {key}, sum(exp(lp) * (lp - lq)) * (0.1 + 0.9 * least(greatest(1 - (-sum(exp(lp) * lp)) / ln(greatest(count(*) FILTER (NOT masked), 2)), 0), 1)) * CASE WHEN max_by(is_pos, (p, -{tie})) THEN 1.0 ELSE 0.25 END AS loss FROM "
            f"(SELECT *, p - pp - ln(sum(exp(p - pp)) OVER (PARTITION BY {key})) AS lp, q - qq - ln(sum(exp(q - qq)) OVER (PARTITION BY {key})) AS lq FROM (SELECT *, max(p) OVER (PARTITION BY {key}) AS pp, max(q) OVER (PARTITION BY {key}) AS qq FROM z)) GROUP BY 1)"
        )

    return f"WITH {D.LOSS}, {logits} SELECT r.query_id, round((r.loss + c.loss) / 2, 6) AS loss FROM {one('query_id', 'doc_id')} r JOIN (SELECT query_id, doc_id FROM rows WHERE is_pos) USING (query_id) JOIN {one('doc_id', 'query_id')} c USING (doc_id)"


@query(_relation_sql("false"))
def relation_loss(spark, d):
    return rounded(L.relation_loss(D.loss_table(spark, d)), "loss")


@query(_relation_sql(_MASKED))
def masked_relation_loss(spark, d):
    return rounded(L.relation_loss(_masked(spark, d), masked=F.col("masked")), "loss")


@query(f"WITH {D.LOSS}, {_softmax_sql('lp', 'score / 0.02')}, {_softmax_sql('lb', 'score / 0.02', 'doc_id', 'lp_t').replace('* EXCLUDE (x, peak)', '* EXCLUDE (x, peak)')} SELECT round((avg(-lp) + avg(-lb)) / 2, 6) AS loss FROM lb_t WHERE is_pos")
def symmetric_loss(spark, d):
    return rounded(L.symmetric(D.loss_table(spark, d)), "loss")


@query(f"WITH {D.BAGS}, {D.SCORES}, s AS (SELECT query_id, doc_id, round(score / 8, 6) AS score FROM scores WHERE query_id <> doc_id) SELECT 'rows' AS part, query_id, doc_id, score FROM s WHERE query_id // 1000 % 2 = 0 AND doc_id % 3 <> 0 UNION ALL SELECT 'cols', query_id, doc_id, score FROM s WHERE doc_id % 3 <> 0 AND doc_id // 1000 % 2 = 0 AND doc_id % 1000 = 1 UNION ALL SELECT 'kd_rows', query_id, doc_id, score FROM s WHERE query_id // 1000 % 2 = 0 UNION ALL SELECT 'neg', query_id, doc_id, score FROM s WHERE query_id // 1000 % 2 = 0 AND doc_id % 3 = 0 UNION ALL SELECT 'pos', query_id, doc_id, score FROM s WHERE query_id // 1000 % 2 = 0 AND doc_id = query_id + 1 AND doc_id % 3 <> 0")
def score_tower(spark, d):
    """Documents with ids divisible by three are the hard negatives, even labels the block."""
    b = D.bags(spark, d)
    s = D.candidates(M.maxsim(D.queries(b), b)).withColumn("is_pos", F.col("doc_id") == F.col("query_id") + 1)
    sizes = D.queries(b).select("query_id", F.lit(8).alias("n_qtok"))
    tower = L.score_tower(s.where("doc_id % 3 <> 0"), sizes, s.where("doc_id % 3 = 0"), True, F.floor(F.col("query_id") / 1000) % 2 == 0)
    out = None
    for part, rows in tower.items():
        rows = rows.select(F.lit(part).alias("part"), "query_id", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "score")


def _heads_sql() -> str:
    """Mean losses of both widths (the wide one is the teacher) and their weighted totals."""
    lone = f"WITH {D.LOSS}, {_softmax_sql('lp', 'score / 0.02')} SELECT query_id, -lp AS loss FROM lp_t WHERE is_pos"
    pair = _relation_sql("false").replace("round((r.loss + c.loss) / 2, 6)", "(r.loss + c.loss) / 2")
    margin = f"WITH {D.LOSS}, {_POSQ}, m AS (SELECT query_id, slot_mask, ps - score AS s, pt - teacher_score AS t FROM rows JOIN pos USING (query_id) WHERE NOT is_pos) SELECT query_id, sum(CASE WHEN abs(s - t) < 1 THEN 0.5 * (s - t) * (s - t) ELSE abs(s - t) - 0.5 END / (1 + exp(-t / 0.13)) * slot_mask) / greatest(sum(slot_mask), 1) AS loss FROM m GROUP BY 1"
    wide = lambda q: q.replace("SELECT s.query_id, s.doc_id, score, teacher_score", "SELECT s.query_id, s.doc_id, teacher_score AS score, teacher_score")
    row = lambda head, f: f"SELECT {head} AS head, " + ", ".join(f"(SELECT avg(loss) FROM ({f(q)})) AS {n}" for n, q in (("task", lone), ("relation", pair), ("margin", margin)))
    sums = ", ".join(f"sum(CASE head WHEN 32 THEN 0.25 ELSE 0.75 END * {c}) AS {c}" for c in ("task", "relation", "margin"))
    return f"SELECT round(task, 5) AS task, round(relation, 5) AS relation, round(margin, 5) AS margin, 0.0 AS anchor, round(task + 2 * (relation + 0.25 * margin), 5) AS total FROM (SELECT {sums} FROM ({row(32, str)} UNION ALL {row(64, wide)}))"


@query(_heads_sql())
def combined_heads_scored(spark, d):
    t = D.loss_table(spark, d)

    def one(head: int) -> DataFrame:
        rows = t if head == 32 else t.withColumn("score", F.col("teacher_score"))
        parts = {"task": L.info_nce(rows), "relation": L.relation_loss(rows), "margin": L.margin_loss(rows)}
        row = None
        for name, losses in parts.items():
            mean = L.weighted_mean(losses).withColumnRenamed("loss", name)
            row = mean if row is None else row.crossJoin(mean)  # one row each
        return row

    total = L.combine_heads(E.by_head([32, 64], one), L.normalized_weights([32, 64], {32: 1.0, 64: 3.0}), scale=2.0)
    return total.withColumns({c: F.round(F.col(c), 5) for c in ("task", "relation", "margin", "anchor", "total")})


@query("SELECT label, count(*) AS vectors, len(any_value(embedding)) AS dim, round(count(*) * len(any_value(embedding)) * 2 * 1e6 / pow(2, 30), 6) AS gib FROM embeddings GROUP BY 1")
def storage_by_label(spark, d):
    """A page of all vectors of a label."""
    n = D.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dim"))
    return rounded(n.withColumn("gib", C.gib_per_million_pages(F.col("vectors"), F.col("dim"))), "gib")


@query(f"WITH {D.BAGS}, {D.SCORES.split(',' + chr(10) + 'best')[0]}, {_SMOOTH}")
def smooth_maxsim_blocks(spark, d):
    return rounded(D.scores(spark, d, tau=0.1), "score")


@query(f"WITH {D.LOSS}, {_POSQ}, m AS (SELECT query_id, slot_mask, ps - score AS s, pt - teacher_score AS t FROM rows JOIN pos USING (query_id) WHERE NOT is_pos) SELECT query_id, round(sum(CASE WHEN abs(s - t) < 1 THEN 0.5 * (s - t) * (s - t) ELSE abs(s - t) - 0.5 END / (1 + exp(-t / 0.13)) * slot_mask) / greatest(sum(slot_mask), 1), 6) AS loss FROM m GROUP BY 1")
def ard_margin(spark, d):
    return rounded(L.margin_loss(D.loss_table(spark, d)), "loss")



# Merging ---------------------------------------------------------------------------


# Arms are the vectors with even and odd row numbers of a label, parameters their pairs.
def _arms(spark, d):
    """Two arms of the vectors of a label in turn, ``arm, param, values``."""
    w = Window.partitionBy("label")
    rows = D.table(spark, d, "embeddings").withColumn("rn", F.row_number().over(w.orderBy("vec_id")) - 1).withColumn("n", F.count("*").over(w))
    whole = rows.where("rn < n - n % 2")  # every arm must have every parameter
    name = F.concat_ws(".", F.col("label").cast("string"), F.floor(F.col("rn") / 2).cast("string"))
    return whole.select(F.concat(F.lit("arm"), F.pmod("rn", F.lit(2)).cast("string")).alias("arm"), name.alias("param"), F.col("embedding").alias("values"))


@query("SELECT param, i AS idx, round(sum(w * x), 6) AS value FROM (SELECT label || '.' || (rn // 2) AS param, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS x, CASE rn % 2 WHEN 0 THEN 0.4 ELSE 0.6 END AS w, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE rn < n // 2 * 2) GROUP BY ALL")
def weighted_merge(spark, d):
    elements = _arms(spark, d).select("arm", "param", F.posexplode("values").alias("idx", "value"))
    return rounded(G.weighted_merge(elements, {"arm0": 0.8, "arm1": 1.2}), "value")


@query("SELECT key, count(DISTINCT coalesce(value, 'null')) AS values, count(DISTINCT arm) AS arms FROM (SELECT lang AS arm, source AS key, (n_chars > 3000)::VARCHAR AS value FROM documents) GROUP BY 1 HAVING count(DISTINCT coalesce(value, 'null')) > 1 OR count(DISTINCT arm) < (SELECT count(DISTINCT lang) FROM documents)")
def config_disagreements(spark, d):
    docs = D.table(spark, d, "documents")
    cfg = docs.select(F.col("lang").alias("arm"), F.col("source").alias("key"), (F.col("n_chars") > 3000).cast("string").alias("value"))
    return G.disagreements(cfg, [f"src{i}" for i in range(20)])


@query(_SQL["weighted_merge"])
def merged_weights(spark, d):
    """The same through files: arms written as 64-bit safetensors, merged run by run."""
    top, arms = X.scratch(spark), _arms(spark, d)
    shapes = dict.fromkeys(arms.select("param").distinct().toArrow()["param"].to_pylist(), ("F64", [64]))  # a row a tensor, which the head of a file lists
    paths = {}
    for arm in ("arm0", "arm1"):
        names = N.write_safetensors(N.cut(arms.where(F.col("arm") == arm).drop("arm"), 48), shapes, f"{top}/{arm}")
        paths[arm] = [f"{top}/{arm}/{n}" for n in names]
    merged = N.merged_runs(N.read_safetensors(spark, paths, 40), {"arm0": 0.8, "arm1": 1.2})
    return rounded(N.elements(merged), "value")


@query(f"WITH {D.BAGS} SELECT doc_id, tok_idx, unnest(range(0, 64)) AS i, unnest(list_transform(vec, lambda x: floor(64 * x) / 64)) AS x FROM bags WHERE doc_id % 3 = 1")
def packed_bags(spark, d):
    """Bags in half precision (of values that it holds), read back for some documents."""
    top = X.scratch(spark)
    bags = D.bags(spark, d).withColumn("tokens", F.transform("tokens", lambda v: F.transform(v, lambda x: F.floor(64 * x) / 64)))
    index = K.write_packed(bags, f"{top}/bags", 8192)
    got = K.read_packed(spark, f"{top}/bags", index.where(F.pmod("doc_id", F.lit(3)) == 1))
    return got.select("doc_id", F.posexplode("tokens").alias("tok_idx", "v")).select("doc_id", "tok_idx", F.posexplode("v").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
