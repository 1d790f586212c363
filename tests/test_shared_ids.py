"""Queries against their SQL where two labels' bags come under one id: a label of more than
1,000 bags runs into the ids of the next, so a bag has several tokens to a place."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_queries import cell

from vecmill.operators import compress as C
from vecmill.operators import maxsim as M
from vecmill.plans import registry

# Bags 1000 to 1007 of label 0 are 0 to 7 of label 1; the last has 5 tokens of one and 4 of the other.
ROWS = {0: 8061, 1: 60, 2: 41, 3: 30}
QUERIES = [
    "candidate_maxsim",
    "avg4_headline",
    "best_three",
    "board_rollup",
    "head_matrix",
    "head_table",
    "filtered_infonce_loss",
    "group_masked_infonce",
    "hardneg_softplus_loss",
    "combined_heads_scored",
    "evaluate_beir",
    "image_span",
    "ward_one_merge",
    "compressed_one_merge_topk",
    "index_score_task",
]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rng, folder = np.random.default_rng(4), tmp_path_factory.mktemp("shared")
    labels = rng.permutation(np.repeat(list(ROWS), list(ROWS.values())))
    vectors = ((rng.normal(size=(len(labels), 64)) + 0.4 * rng.normal(size=(len(ROWS), 64))[labels]) / 8).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(labels)), "embedding": list(vectors), "label": pa.array(labels, pa.int32())}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_with_shared_ids(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tables}/embeddings.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    df = registry.queries()[name](spark, tables)
    assert sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


@pytest.mark.parametrize("options", [{}, {"pad_len": 5}, {"tau": 0.1}])
def test_tokens_of_a_place_count_once(spark, options):
    """Every strategy, with documents that a place's two tokens lift over the padded length."""
    rng = np.random.default_rng(4)
    docs = [(i, rng.normal(size=(n, 3)).tolist()) for i, n in enumerate((1, 2, 3, 4, 6))]
    asked = [(10, rng.normal(size=(4, 3)).tolist(), [0, 0, 1, 2]), (11, rng.normal(size=(2, 3)).tolist(), [0, 1]), (12, rng.normal(size=(3, 3)).tolist(), [7, 7, 7])]
    bags = spark.createDataFrame(docs, "doc_id long, tokens array<array<double>>")
    q = spark.createDataFrame(asked, "query_id long, tokens array<array<double>>, places array<int>")
    want = {}
    for i, tokens, places in asked:
        for j, doc in docs:
            score = 0.0
            for p in set(places):
                x = (np.array([t for t, at in zip(tokens, places, strict=True) if at == p]) @ np.array(doc).T).ravel()
                best = x.max() if "tau" not in options else 0.1 * np.log(np.exp((x - x.max()) / 0.1).sum()) + x.max()
                score += max(best, 0.0) if len(x) < options.get("pad_len", 0) else best
            want[i, j] = round(score, 9)
    for how in ({}, {"block": 0, "tile": 3}, {"strategy": "rows"}, {"strategy": "nested"}):
        assert {(r.query_id, r.doc_id): round(r.score, 9) for r in M.maxsim(q, bags, **how, **options).collect()} == want
    if not options:
        pairs = bags.select("doc_id").crossJoin(q.select("query_id"))
        assert {(r.query_id, r.doc_id): round(r.score, 9) for r in M.candidate_maxsim(pairs, q, bags).collect()} == want
        assert {r.query_id: r.score for r in M.length_normalized(pairs.withColumn("score", F.lit(6.0)), q).where("doc_id = 0").collect()} == {10: 2.0, 11: 3.0, 12: 6.0}
