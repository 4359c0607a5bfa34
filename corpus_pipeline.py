"""From raw documents to token ids: toxicity, near-duplicates, secrets, source mix, byte-pair encoding.

Each stage reads the columns of documents, whatever others there are, and returns those alone (the last one: doc_id,
source, ids, n_tokens). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochflow.llm import bpe, mixing, secret_grammar, simhash, toxicity
from epochflow.llm.common import written
from epochflow.llm.queries import byte_bpe_path

#: Rows of an Arrow batch between Spark and Python: whole documents are large, and five stages share the executors.
BATCH_ROWS = 1000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size where it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents whose toxicity is 0.5 or more; the model is learned from the labels of docs.

    Null and empty texts get the prior, which is below 0.5, and stay; so do repeated rows.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.where(F.col("toxicity") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of texts with a Jaccard similarity of 0.8 or more of their
    five-word shingles, directly or by others; candidates come from SimHash fingerprints.

    Null and empty texts are one group; of repeated rows one stays.
    """
    small_batches(spark)
    return simhash.keep_one(docs, similarity=0.8, shingle=5).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; keeps all documents. Null texts stay null, with null n_chars."""
    small_batches(spark)
    return secret_grammar.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources come near their target weights; a document comes once for each draw.

    Null sources are a source of their own; null and empty texts come with the block that they lie in.
    """
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of each document; null and empty texts have no ids."""
    small_batches(spark)
    ids = bpe.encode_column(docs.select("doc_id", "source", "text"), byte_bpe_path())
    return ids.select("doc_id", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Learned scores, automata and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written before the next; the session's batch size is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return docs
