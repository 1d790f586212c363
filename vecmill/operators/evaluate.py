"""Evaluation end to end: pages and queries to metrics (``runner`` does it by task).

A page encoder maps rows with ``doc_id`` to ``doc_id, tokens`` and a query encoder rows
``query_id, text`` to ``query_id, tokens`` (hooks for a model, see ``compress.encode``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables as S
from . import metrics as R
from .maxsim import maxsim

Encoder = Callable[[DataFrame], DataFrame]


def _measured(bags: DataFrame, queries: DataFrame, qrels: DataFrame, ks: tuple[int, ...], pad_len: int | None) -> DataFrame:
    """One row of metrics; without a page, or without a query that is judged, an error (a
    row of zeros would pass for a result)."""
    scores = maxsim(queries, bags, top_k=max(ks), pad_len=pad_len).drop("rank")
    row = R.task_metrics(R.per_query(scores, qrels, ks), ks=ks)
    row = row.crossJoin(bags.agg(F.count("*").alias("n_docs")))  # one row each
    some = lambda n, what: F.when(F.col(n) > 0, True).otherwise(F.raise_error(F.lit(f"nothing to evaluate: no {what}")).cast("boolean"))
    return row.where(some("n_docs", "page") & some("n_queries", "query with a judged page"))


def paired_parts(rows: DataFrame, max_queries: int | None = None, max_docs: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, queries, judgements) of a paired table ``query, image_filename, ord``."""
    pages = S.candidate_pages(rows, max_docs=max_docs)
    judged = S.paired_judged(rows, pages, max_queries=max_queries)
    return pages, judged.select("query_id", "text", "ord"), judged.select("query_id", "doc_id", F.lit(1.0).alias("grade"))


def beir_parts(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, max_queries: int | None = None, max_docs: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, queries, judgements) of judged triples: judgements of documents that exist,
    queries with a usable text and a positive judgement.  Repeated document ids are an
    error."""
    pages = S.head(S.beir_corpus(corpus), max_docs)
    if not (twice := S.duplicate_ids(pages)).isEmpty():
        raise ValueError(f"repeated document ids, such as {twice.first().doc_id}")
    judged = R.normalized_qrels(S.beir_qrels(qrels), pages)
    kept = S.head(S.keep_queries(S.beir_queries(queries), judged), max_queries)
    return pages, kept, judged.join(kept.select("query_id"), "query_id", "left_semi")


def evaluate_paired(rows: DataFrame, encode_pages: Encoder, encode_queries: Encoder, max_queries: int | None = None, max_docs: int | None = None, ks: tuple[int, ...] = R.KS, pad_len: int | None = None) -> DataFrame:
    """One row of metrics, ``n_queries`` and ``n_docs``: every page of the table is a
    candidate once, and a query's wanted page is the one of its row."""
    pages, queries, qrels = paired_parts(rows, max_queries, max_docs)
    return _measured(encode_pages(pages), encode_queries(queries.select("query_id", "text")), qrels, ks, pad_len)


def evaluate_beir(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, encode_pages: Encoder, encode_queries: Encoder, max_queries: int | None = None, max_docs: int | None = None, ks: tuple[int, ...] = R.KS, pad_len: int | None = None) -> DataFrame:
    """One row of metrics, ``n_queries`` and ``n_docs`` of judged triples."""
    pages, kept, judged = beir_parts(corpus, queries, qrels, max_queries, max_docs)
    return _measured(encode_pages(pages), encode_queries(kept.select("query_id", "text")), judged, ks, pad_len)


def by_head(heads: list[int], one: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of every width, with ``head``, in one plan."""
    out = None
    for head in heads:
        part = one(head).withColumn("head", F.lit(head))
        out = part if out is None else out.unionByName(part)
    return out


def score_images(pages: DataFrame, queries: DataFrame, encode_pages: Encoder, encode_queries: Encoder, top_k: int | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of images (``doc_id`` and what the encoder reads)
    for texts, the best first."""
    scores = maxsim(encode_queries(queries), encode_pages(pages), top_k=top_k)
    return (scores if top_k else R.ranked(scores)).orderBy("query_id", "rank")
