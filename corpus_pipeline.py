"""The training-data pipeline: documents in, encoded documents out.

Each stage takes what the one before it kept, written as Parquet and read again.
"""

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, langid, lines, minhash, pieces
from quarry.llm.scratch import Scratch, table

#: Documents with so many percent of their word shingles in common are near duplicates.
NEAR_PERCENT = 80

#: The tokenizer's model file, on the driver.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known: those without a letter (null and empty texts too), or as near to two languages, go.
    Rows with the same doc_id are judged each; other columns stay as they are."""
    return langid.with_language(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go from the texts. Documents that keep no word of theirs go; others stay, also those that had
    none before (null, empty)."""
    return lines.without_later_lines(spark, docs, keep_emptied=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest doc_id stays. Texts without words and rows without a doc_id
    are in no group and stay."""
    return minhash.without_near_duplicates(spark, docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none."""
    return decontam.without_benchmark(spark, docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of each document."""
    return pieces.encode_documents(spark, docs, MODEL_PATH)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
