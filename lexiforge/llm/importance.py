"""Importance resampling towards a target collection, over hashed word n-grams.

One scan of each document cuts its words and keeps a ring of running CRC-32 states, one for each of
the last n starts; a word extends every state by a space and itself, so that each n-gram's checksum
costs one step and no n-gram is ever spelt out. What the scan emits is buckets. Counts, gains and
weights are made from these; the texts aren't read again.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import documents, forget, materialize, rank_id
from lexiforge.operators.numbering import numbered

#: Words are runs of letters, digits and characters beyond ASCII, of lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
ORDER, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Texts whose buckets are held at a time.
ROWS = 64


def ring_checksums(words: list[bytes], order: int) -> list[int]:
    """CRC-32 of every run of 1 to ``order`` words joined by one space, by ends."""
    ring: deque[int] = deque(maxlen=order)
    out: list[int] = []
    for word in words:
        if order > 1:
            if len(ring) == order:
                ring.popleft()  # its run is complete
            spaced = b" " + word
            for i, state in enumerate(ring):
                ring[i] = crc32(spaced, state)
        ring.append(crc32(word))
        out.extend(ring)
    return out


def hashed(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with n_words and buckets, an array with one bucket per n-gram, repeats included. A
    null text has none. The column ``text`` goes."""

    @F.arrow_udf("n_words long, buckets array<int>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def part(texts: pa.Array) -> pa.Array:
            counts, offsets, found = [], [0], []
            for text in texts.to_pylist():
                words = WORD.findall((text or "").encode("utf-8").lower())
                got = np.array(ring_checksums(words, order), dtype=np.uint32) % np.uint32(buckets)
                counts.append(len(words))
                offsets.append(offsets[-1] + len(got))
                found.append(got)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))
            return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists], ["n_words", "buckets"])

        for texts in batches:
            yield pa.concat_arrays([part(texts.slice(i, ROWS)) for i in range(0, max(len(texts), 1), ROWS)])

    others = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0)).alias("row"), scan(F.col("text")).alias("got")).select("row", "got.n_words", "got.buckets")


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """n-grams in each bucket: one number per bucket is all that reaches the driver."""
    rows = scanned.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()
    out = np.zeros(buckets, np.int64)
    for b, n in rows:
        out[b] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of each bucket's smoothed shares in target and source."""
    n, t_all, s_all = len(target), int(target.sum()), int(source.sum())
    one = lambda t, s: floor(1000 * log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
    return np.array([one(int(t), int(s)) for t, s in zip(target, source)], np.int64)


def weighted(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """``scanned`` with n_features and weight, the floored mean gain of its buckets (none: 0)."""

    @F.arrow_udf("n_features long, weight long")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values = gain[lists.flatten().to_numpy(zero_copy_only=False)]
            sizes = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
            upto = np.concatenate([[0], np.cumsum(values)])
            ends = np.cumsum(sizes)
            sums = upto[ends] - upto[ends - sizes]
            yield pa.StructArray.from_arrays([pa.array(sizes), pa.array(sums // np.maximum(sizes, 1))], ["n_features", "weight"])

    return scanned.withColumn("w", weigh(F.col("buckets"))).select("row", "n_words", "w.n_features", "w.weight")


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``docs`` without its text, as ``row``, with n_words, n_features, weight, score and rank: 1, 2, 3...
    for the ``percent`` of documents with ``min_words`` words or more that have the highest weight
    plus seeded Gumbel noise, which is a draw without replacement in proportion to exp(weight / 1000).

    A null text has no words, weight 0 and is never drawn. Ties go to the smaller doc_id, null
    ids last; a null id draws its noise from the seed alone. Rows of one id share their noise; repeated rows are rows of
    their own. Empty tables: no documents give no rows, no target gives gains from smoothing alone. Texts are scanned
    whole, once.
    """
    own = materialize(hashed(docs, order, buckets), "buckets")
    theirs = hashed(target.select("text"), order, buckets)
    scored = weighted(own, gains(bucket_counts(theirs, buckets), bucket_counts(own, buckets)))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(draw, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000)
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("short", F.col("n_words") < min_words)
    out = numbered(scored, ["short", F.desc("score"), rank_id(F.col("row.doc_id"))], "place")
    drawn = out.where("not short").count() * percent // 100
    forget(own)
    return out.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("short", "place")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's features, weight, score and rank in the draw towards ``benchmark``; see resample."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = resample(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")
