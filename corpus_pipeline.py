"""A corpus pipeline of five stages on the table ``documents``.

Quality classifier, near-duplicate removal, removal of repeated strings, benchmark
decontamination, packing.  Each stage takes (spark, docs, sf_dir) and works on all rows
that the one before kept; all but the last return the columns of ``documents``, and
further columns of the input as they are, whatever their names.

Rows with a null text, an empty text or fewer words than a shingle are clean: no stage
rejects them.  A null id is an id of its own kind that sorts first.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.decontamination import drop_contaminated
from vecmill.llm.near_dedup import keep_one_of_each
from vecmill.llm.packing import pack_documents
from vecmill.llm.quality_lm import keep_good
from vecmill.llm.storage import saved
from vecmill.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity and variety are within their language's thresholds stay.

    A null language is a language; without trusted rows everything stays; repeated rows
    share their verdict."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least id; of rows that repeat an
    id and a text one stays; rows with a null text all stay."""
    return keep_one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut; ``n_chars`` follows the text.

    No row goes; a text that is cut whole is empty."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a test item's shingles go; of rows with one id
    only those whose text matches."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 512 to 4096 tokens; one row per piece of a document.

    A text without tokens has one piece of length 0 and no bin; repeated rows are packed
    as often as they occur."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No stage but the bookkeeping around it can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
