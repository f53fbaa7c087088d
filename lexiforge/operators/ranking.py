"""Frequency threshold by an exact order statistic, and word scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.scoring import scaled_score, tag_diversity, word_score


def frequency_threshold(words: DataFrame, min_frequency: int = 4, keep_percent: int = 98) -> DataFrame:
    """One row, ``threshold``: the frequency at place floor(n * (100 - keep) / 100) of the sorted
    frequencies, ``min_frequency`` at least. By a histogram, so only distinct frequencies are
    ordered, however many words there are."""
    histogram = words.groupBy("frequency").agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("frequency").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    placed = histogram.select("frequency", F.sum("n").over(up).alias("upto"), F.sum("n").over(everything).alias("all"))
    at = F.expr(f"(`all` * {100 - keep_percent}) div 100")
    return placed.where(F.col("upto") > F.greatest(F.lit(0), at)).agg(F.greatest(F.min("frequency"), F.lit(min_frequency)).alias("threshold"))


def filter_frequency(words: DataFrame, min_frequency: int = 4, keep_percent: int = 98) -> DataFrame:
    limit = frequency_threshold(words, min_frequency, keep_percent)
    return words.join(F.broadcast(limit), F.col("frequency") >= F.col("threshold")).drop("threshold")  # one row


def score_words(words: DataFrame) -> DataFrame:
    """``words`` with score: raw score times tag diversity, the best one scaled to 1000."""
    top = words.agg(F.max("frequency").alias("max_frequency"))
    raw = words.join(F.broadcast(top), F.lit(True))  # one row
    raw = raw.withColumn("raw", word_score(F.col("frequency"), F.col("index"), F.col("max_frequency")) * tag_diversity(F.size("tags")))
    best = raw.agg(F.max("raw").alias("max_raw"))
    return raw.join(F.broadcast(best), F.lit(True)).withColumn("score", scaled_score(F.col("raw"), F.col("max_raw"))).drop("raw", "max_raw", "max_frequency")


def ranked_words(words: DataFrame, min_frequency: int = 4, keep_percent: int = 98) -> DataFrame:
    """score_words of filter_frequency, from three readings of a staged table: threshold and highest
    frequency come from one histogram, the best raw score from a second reading, and the threshold reaches the scan
    of either as a plain number, so that rows below it aren't read where the file's statistics rule them out."""
    histogram = words.groupBy("frequency").agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("frequency").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.select("frequency", F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    at = F.greatest(F.lit(0), F.expr(f"(`all` * {100 - keep_percent}) div 100"))
    threshold, highest = placed.agg(F.min(F.when(F.col("upto") > at, F.col("frequency"))), F.max("frequency")).first()
    # no place beyond the last one (keep 0), or no words: nothing is kept
    kept = words.where(F.lit(False)) if threshold is None else words.where(F.col("frequency") >= max(threshold, min_frequency))
    raw = kept.withColumn("raw", word_score(F.col("frequency"), F.col("index"), F.lit(highest or 0)) * tag_diversity(F.size("tags")))
    best = raw.agg(F.max("raw")).first()[0]
    return raw.withColumn("score", scaled_score(F.col("raw"), F.lit(best or 0.0))).drop("raw")
