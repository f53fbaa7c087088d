"""A training corpus from ``documents``: toxicity, near-dedup, personal data, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet to the shared folder and read back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.bpe_codec import coded_column
from lexiforge.llm.common import documents, materialize
from lexiforge.llm.mixing import apply_mix
from lexiforge.llm.near_dedup import first_of_group
from lexiforge.llm.pii import redact
from lexiforge.llm.toxicity import score_column, train

#: Words that a stage remembers in a worker, which holds those of several stages at once: fewer than an operator on its own does.
CACHE = 100_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score_column(F.col("text"), model, CACHE) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the least id stays."""
    return first_of_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; what it takes nothing of goes."""
    return apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them."""
    coded = docs.select("doc_id", "lang", "source", coded_column(F.col("text"), outputs=("ids",), cache=CACHE).alias("c"))
    return coded.select("doc_id", "lang", "source", "c.ids", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]

#: SQL expresses neither the classifier nor the encoder: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
