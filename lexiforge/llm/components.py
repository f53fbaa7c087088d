"""Connected components of an edge table: local contraction, then alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import forget, materialize

#: Edges that a task contracts at a time: there are as many tasks as these take.
EDGES = 1 << 20


class Forest:
    """Union-find over 0..n-1; a root is the least of its elements."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def labels(self) -> np.ndarray:
        """The root of every element."""
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up

    def join(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Tie the elements pairwise; returns the roots that were tied, an edge each."""
        label = self.labels()
        a, b = label[left], label[right]
        keys = np.unique(np.minimum(a, b)[a != b] * len(label) + np.maximum(a, b)[a != b])
        tied = []
        for i, j in zip((keys // len(label)).tolist(), (keys % len(label)).tolist()):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                tied.append((i, j))
        return tied


def _contract(most: int) -> Callable:
    """Edges, about ``most`` at a time, as the stars of their own components."""

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        nodes, at = np.unique(pd.concat(held)[["a", "b"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        forest = Forest(len(nodes))
        forest.join(at[:, 0], at[:, 1])
        label = forest.labels()
        leaf = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[label[leaf]], "b": nodes[leaf]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= most:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return run


def _stars(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One contraction: each node's neighbours are tied to the least id round it. Large stars
    look at both directions and tie the larger neighbours, small stars tie the smaller ones and
    the node itself. A node's minimum is pre-aggregated and written, so no neighbourhood meets in
    a task and the join that brings it back can split a hub."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("a_"), F.least("a", "m").alias("m"))
        tied = both.where("b > a").join(materialize(least, name), F.col("a") == F.col("a_"))
        return tied.where("b <> m").select(F.col("m").alias("a"), "b").distinct()
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = materialize(down.groupBy(F.col("b").alias("b_")).agg(F.min("a").alias("m")), name)
    tied = down.join(least, (F.col("b") == F.col("b_")) & (F.col("a") != F.col("m"))).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return least.select(F.col("m").alias("a"), F.col("b_").alias("b")).unionByName(tied).distinct()


def _open(edges: DataFrame, name: str) -> DataFrame:
    """``edges`` with ``open``: whether the star of a touches another one, because a or one of its
    leaves has a second root or is both a root and a leaf. Other stars are whole components."""
    end = lambda c, leaf: F.struct(F.col(c).alias("n"), F.lit(leaf).alias("leaf"))
    ends = edges.select(F.explode(F.array(end("a", 0), end("b", 1))).alias("x")).groupBy("x.n")
    met = ends.agg(F.sum("x.leaf").alias("leaves"), F.count(F.lit(1)).alias("ends")).where("leaves > 0 and ends > 1").select("n")
    met = materialize(met, f"{name}-met")
    roots = edges.join(met, F.col("b") == F.col("n")).select("a").unionByName(met.select(F.col("n").alias("a"))).distinct()
    roots = materialize(roots.select(F.col("a").alias("a_")), f"{name}-open")
    return materialize(edges.join(roots, F.col("a") == F.col("a_"), "left").select("a", "b", F.col("a_").isNotNull().alias("open")), name)


def components(edges: DataFrame, name: str = "components", most: int = EDGES) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b): root is the least id it reaches.

    Tasks of about ``most`` edges contract them to stars. While there is more than one task, a large
    and a small star tie the stars that touch others, and what comes of these is contracted
    again. Each round is written to the shared folder. The files are the caller's to forget."""
    edges = materialize(edges.where("a <> b").select("a", "b"), name)
    done = edges.sparkSession.createDataFrame([], "a long, b long")
    while True:
        tasks = max(1, -(-edges.count() // most))
        stars = edges.coalesce(tasks).mapInPandas(_contract(most), "a long, b long")
        if tasks == 1:
            done = done.unionByName(materialize(stars, name))
            break
        stars = materialize(stars.distinct(), name)
        forget(edges)
        seen = _open(stars, name)
        forget(stars)
        done = done.unionByName(seen.where("not open").select("a", "b"))
        left = seen.where("open").select("a", "b")
        edges = materialize(_stars(materialize(_stars(left, True, name), name), False, name), name)
    return done.select(F.col("b").alias("node"), F.col("a").alias("root"))
