"""From raw documents to packed token sequences: quality rules, quality classifier, near copies, secrets, packing.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import common, jaccard, ngrams, packing, secrets

#: Rows of an Arrow batch: texts of some kilobytes make batches of some megabytes, in executors and in workers.
BATCH_ROWS = 1000


def bounded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose batches have at most ``BATCH_ROWS`` rows, in what it runs itself and in what it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose text is unlike trusted text go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ngrams.passing(docs, ngrams.fit(docs, ngrams.trusted_ids(labels, "quality")))


@bounded
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; documents that are not drawn go.

    The raw model is that of the whole table: in what the rules kept, junk is too rare to be told from trusted
    text.  The sample is as large as the number of documents that are about as likely under either model; weights
    are tempered less than by default, so that a filter draws little that is unlike the target.
    """
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = ngrams.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return ngrams.resampled(docs, ngrams.fit(raw, trusted), effective=200.0)


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(docs, n=5, percent=80)


@bounded
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars, where there is one, follows the text."""
    clean = secrets.redact(docs, secrets.fit(docs))
    if "n_chars" not in clean.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


@bounded
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near copies", near_copies),
    ("secret scan", secret_scan),
    ("packing", pack_sequences),
]

#: Hashed models and tokenizers are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
