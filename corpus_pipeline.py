"""A pipeline over the documents of a corpus: quality, near-duplicates, secrets, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``. ``run`` chains them through tables in shared scratch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import bpe, minhash_dedup, mixing, quality, secrets
from strophe.llm.common import drop_scratch, materialize, scratch_tables


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score under 0.5).

    A null text is scored as the empty text; rows with null or repeated ids are scored like any other.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality.score_of(spark, quality.fit(docs, labels))(F.col("text"))
    return docs.where(good >= 0.5).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: the one of least id."""
    return minhash_dedup.keep_one(docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))).cast("bigint"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number: 0, 1 or 2 times."""
    mixed = mixing.mix_documents(docs)
    return mixed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids and digests of every text that the mix holds."""
    return bpe.round_trip(docs, bpe.vocabulary_path(), keep=["doc_id", "source"], with_ids=True)


STAGES = [("quality classifier", classify), ("near-duplicates", dedup), ("secret scans", scan_secrets), ("source mix", mix), ("BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's scratch tables go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = scratch_tables()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_scratch(spark, begun, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage but the mixture's counts can be said in SQL.
ORACLE_SQL = None
