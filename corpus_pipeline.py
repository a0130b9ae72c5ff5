"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the docs of the next one. All but the last keep the columns of documents. Empty tables stay
empty through all stages, and docs may have any other columns, which those before the last keep. Texts of
any length are read whole; they go to Python in small batches, which the stages set for their session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm import dedup, mixing, ngram_join, packing, toxicity
from scorelake.llm.common import read_table, written


#: Rows and bytes of texts that a worker gets at a time at most.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to the bounds above, or fewer rows if it has fewer: a batch is held several times over, on both sides of the pipe."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that noisy-or scores below the threshold stay; null, empty and blank texts score 0 and stay, of any length plain texts too."""
    small_batches(spark)
    return toxicity.clean(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays, and one of repeated rows.

    Null and empty texts are equal. Documents without doc_id all stay; of an id's rows each different text is judged on its own.
    """
    small_batches(spark)
    return dedup.exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest doc_id stays; documents without doc_id or without words stay."""
    small_batches(spark)
    return ngram_join.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or repeated. Null source is a source; sources without words aren't taken."""
    small_batches(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and place in it; repeated documents are packed each time, null text as its end id alone."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Models and tokens can't be had in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
