"""Incremental ingest: a folder of documents as a stream through the same transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.profiles import LATIN, Profile
from lexiforge.operators import layout, lexicon
from lexiforge.operators.tokenizers import RegexTokenizer
from lexiforge.sources.files import from_documents

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(documents: DataFrame, profile: Profile = LATIN, tokenizer=None) -> DataFrame:
    """lemma, frequency, tags over all that has arrived: stateless extraction and tokenisation,
    then one stateful aggregate whose state is a row per lemma."""
    tokens = (tokenizer or RegexTokenizer()).tokens(layout.extract_sentences(from_documents(documents)))
    kept = tokens.where((F.col("lemma") != "") & ~lexicon.is_useless(F.col("lemma"), F.col("pos"), profile))
    return kept.groupBy("lemma").agg(F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_set("tag")).alias("tags"))


def start(counts: DataFrame, out: str, checkpoint: str):
    """Write the counts of every trigger as a Parquet snapshot per batch; replays overwrite their own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
