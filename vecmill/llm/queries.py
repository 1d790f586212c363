"""The queries of this package: ``opN_<name>`` applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents")).drop("node")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_texts

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))  # a null id is not held out
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, manifest).drop("ids")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_lm import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import image_copies, media_of_vectors

    return image_copies(media_of_vectors(table(spark, sf_dir, "embeddings")), ["vec_id", "variant"])


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("n_words")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.col("label").cast("long")
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


def op13_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_toxicity, op3_main_text, op4_repeated_strings, op5_decontamination, op6_token_counts, op7_packing, op8_token_files, op9_quality, op10_media_copies, op11_resampling, op12_hard_negatives, op13_vector_duplicates)}


def oracle_sql() -> dict[str, str]:
    from .hard_negatives import hard_negatives_sql
    from .resampling import resampling_sql
    from .vector_dedup import near_duplicate_vectors_sql

    return {"op11_resampling": resampling_sql(), "op12_hard_negatives": hard_negatives_sql(), "op13_vector_duplicates": near_duplicate_vectors_sql()}
