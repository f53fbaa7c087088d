"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The budget of all tokens is cut into blocks of BLOCK tokens. Blocks go to sources by the
highest quotients target / (2 * seats + 1), then each source's blocks go to its shards the same
way, so every shard has an integer quota. In a shard, documents stand in a seeded order, and the
shard's blocks are the runs of BLOCK tokens of that order: whole passes over the shard come first, the
rest of the quota takes the first blocks. So the seed selects blocks by the order of their
documents, and in a shard one document at most is taken in part.
Shards hold about SHARD_TOKENS tokens and SHARD_ROWS rows each, so no task holds a whole source, however
short its texts are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import documents, materialize, n_words

BLOCK = 32
SHARD_TOKENS = 1_000_000
SHARD_ROWS = 20_000
REPEATS = 3
SEED = 7
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: np.ndarray, weights: np.ndarray, repeats: int = REPEATS) -> np.ndarray:
    """Shares of the total by weight; a target stops at ``repeats`` times its source's size,
    and the excess is shared anew by weight until none is above."""
    sizes = sizes.astype(np.float64)
    cap, out, left = repeats * sizes, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while left.any():
        budget = max(sizes.sum() - cap[~left].sum(), 0.0)
        out[left] = budget * weights[left] / weights[left].sum()
        above = left & (out > cap)
        if not above.any():
            break
        out[above] = cap[above]
        left &= ~above
    return out


def sainte_lague(claims: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients claim / (2 * own + 1); earlier entries win ties.

    Rounding the exact shares is itself a Sainte-Lague result for some house size, at most
    half an entry off each; single seats are then given or taken by quotient, so the cost
    doesn't depend on the number of seats."""
    claims = claims.astype(np.float64)
    total = claims.sum()
    if total <= 0 or seats <= 0:
        return np.zeros(len(claims), np.int64)
    own = np.floor(claims * (seats / total) + 0.5).astype(np.int64)
    short = int(seats - own.sum())
    if short > 0:
        heap = [(-c / (2 * n + 1), i) for i, (c, n) in enumerate(zip(claims, own)) if c > 0]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heapq.heappop(heap)
            own[i] += 1
            heapq.heappush(heap, (-claims[i] / (2 * own[i] + 1), i))
    elif short < 0:
        heap = [(c / (2 * n - 1), -i) for i, (c, n) in enumerate(zip(claims, own)) if n > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            own[-i] -= 1
            if own[-i] > 0:
                heapq.heappush(heap, (claims[-i] / (2 * own[-i] - 1), i))
    return own


def mix(docs: DataFrame, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, repeats: int = REPEATS, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """What the mix takes of every row: doc_id, source, size, source_size, target, taken.

    Null and empty texts have size 0 and are never taken; null sources form the last source;
    rows repeating an id are rows of their own; an empty table gives an empty result. Only
    sums per source (one row each) and per shard meet in a task."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("__h"))
    rows = materialize(rows, "mix-rows")

    def by_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", key=lambda s: s.map(lambda x: (x is None, "" if x is None else x))).reset_index(drop=True)
        weight = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(pdf))], dtype=np.float64)
        pdf["target"] = targets(pdf["source_size"].to_numpy(), weight, repeats)
        pdf["blocks"] = sainte_lague(pdf["target"].to_numpy(), round(pdf["source_size"].sum() / block))
        pdf["shards"] = np.maximum(1, np.maximum(-(-pdf["source_size"] // shard_tokens), -(-pdf["n"] // shard_rows)))
        return pdf[["source", "source_size", "target", "blocks", "shards"]]

    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = sums.groupBy(F.lit("all")).applyInPandas(by_source, "source string, source_size long, target double, blocks long, shards long")
    plan = materialize(plan, "mix-sources")
    planned = rows.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    planned = planned.withColumn("shard", F.pmod(F.xxhash64("__h", F.lit(1)), F.col("shards")))
    planned = materialize(planned.select("doc_id", "source", "size", "__h", "source_size", "target", "blocks", "shard"), "mix-planned")

    def by_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        pdf["quota"] = sainte_lague(pdf["shard_size"].to_numpy(), int(pdf["blocks"].iloc[0])) * block
        return pdf[["source", "shard", "shard_size", "quota"]]

    shards = planned.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"))
    quota = materialize(shards.groupBy("source").applyInPandas(by_shard, "source string, shard long, shard_size long, quota long"), "mix-shards")
    quota = quota.withColumnsRenamed({"source": "__source", "shard": "__shard"})
    over = Window.partitionBy("source", "shard").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = planned.withColumn("__before", F.sum("size").over(over) - F.col("size"))
    out = out.join(quota, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard")))
    size = F.col("size")
    passes = F.when(F.col("shard_size") > 0, F.expr("quota div greatest(shard_size, 1)")).otherwise(F.lit(0))
    rest = F.col("quota") - passes * F.col("shard_size") - F.col("__before")
    taken = F.least(size * repeats, passes * size + F.greatest(F.lit(0), F.least(size, rest)))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it (a partly taken document comes
    whole), with the columns of ``docs``. Rows that repeat an id share its decision. What is taken
    above the quota is less than one document for each shard."""
    got = mix(docs, **params).groupBy("doc_id", "source").agg(F.max(F.expr("ceil(try_divide(taken, size))")).alias("times")).where("times > 0")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that no name can clash
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("from"), own)
    out = rows.join(got.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source")
