"""Substring dedup: seed and extend on winnowed anchors.

Seeds. A window is LENGTH consecutive words. Of its LENGTH - ANCHOR + 1 runs of ANCHOR words
the one with the least hash is its anchor (leftmost on ties), so equal windows have equal
anchors and about two in forty runs are anchors at all. The windows with one anchor occurrence
lie side by side; together they are a segment: the anchor extended both ways as far as any
repeat through it can matter.

Join. Anchors that occur in one document only drop out by a pre-aggregated minimum and
maximum of ids per anchor. Among the rest, equal segments are matched whole: every
occurrence with a larger id than the segment's first is a repeat. What is left are first
occurrences of differing segments round a shared anchor; those alone are extended step by step,
window by window, each against the window's first occurrence. No pairs are formed, so a
passage that a third of all documents share costs as much per document as any other.

Overlapping and touching repeats merge to maximal ones. A word is known by a 128-bit BLAKE2b
digest under a key drawn for the run; hashes of runs of words are 64-bit per anchor, 128-bit per segment and 96-bit
per window. Rows that share an id are told apart by 128 bits of their text's SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import documents, forget, materialize, new_key, rank_id, rolling, text_words, window_hash, word_digests

LENGTH = 50
ANCHOR = 10
#: What names a document row: its id's rank, and its text for rows that share an id.
ROW = ("rid", "f1", "f2")


def _rolls(text: str | None, key: bytes = b"") -> tuple[int, tuple, tuple]:
    words = word_digests(text_words(text), key)
    return len(words), rolling(words[:, 0], 0), rolling(words[:, 1], 1)


def segments_of(text: str | None, length: int, anchor: int, key: bytes = b"") -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, windows, two segment hashes) of each anchor occurrence."""
    n, roll, other = _rolls(text, key)
    if n < length:
        return (np.zeros(0, np.uint64),) * 5
    at = np.arange(n - anchor + 1)
    hashes = window_hash(roll, at, at + anchor)
    span = length - anchor + 1
    place = np.empty(n - length + 1, np.int64)
    for i in range(0, len(place), 1 << 16):  # in blocks, for very long texts
        view = np.lib.stride_tricks.sliding_window_view(hashes[i : i + (1 << 16) + span - 1], span)
        place[i : i + len(view)] = view.argmin(1) + np.arange(i, i + len(view))
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, len(place)))
    end = first + count - 1 + length
    return hashes[place[first]], first, count, window_hash(roll, first, end), window_hash(other, first, end)


def _marks() -> list[Column]:
    """Two halves of 128 bits that tell rows of one id apart by their text; null is like empty."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def _keyed(docs: DataFrame) -> DataFrame:
    """rid: rank of the id (null last); f1 and f2 tell rows apart that share an id."""
    f1, f2 = _marks()
    return docs.select(rank_id(F.col("doc_id")).alias("rid"), f1.alias("f1"), f2.alias("f2"), "text")


def _same(left: Iterable[str], right: Iterable[str]) -> Column:
    return reduce(Column.__and__, (F.col(a) == F.col(b) for a, b in zip(left, right)))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Repeated windows by document row: rid, f1, f2, runs array<struct<start, windows>>.

    A run says that ``windows`` windows from word ``start`` on also start in a document
    with a smaller id. Rows without repeats are absent. Null and short texts have none;
    repeated rows of one id don't repeat each other."""
    keyed, key = _keyed(docs), new_key()

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, rows = [], []
            for i, text in enumerate(pdf["text"]):
                got = segments_of(text, length, anchor, key)
                if len(got[0]):
                    parts.append(got)
                    rows.append(np.full(len(got[0]), i))
            if not rows:
                continue
            row = np.concatenate(rows)
            h, lo, m, c1, c2 = (np.concatenate(x) for x in zip(*parts))
            yield pd.DataFrame({"h": h.view(np.int64), "rid": pdf["rid"].to_numpy()[row], "f1": pdf["f1"].to_numpy()[row], "f2": pdf["f2"].to_numpy()[row], "lo": lo.astype(np.int32), "m": m.astype(np.int32), "c1": c1.view(np.int64), "c2": c2.view(np.int64)})

    segments = materialize(keyed.mapInPandas(seeds, "h long, rid long, f1 long, f2 long, lo int, m int, c1 long, c2 long"), "repeat-segments")
    shared = segments.groupBy("h").agg(F.min("rid").alias("a"), F.max("rid").alias("z"), F.min("c1").alias("ca"), F.max("c1").alias("cz"))
    shared = shared.where("a < z").select(F.col("h").alias("h_"), (F.col("ca") < F.col("cz")).alias("varied"))
    # aggregates are written before they are joined back: then either side of the join is a plain
    # exchange, and an anchor or segment that very many documents have can be split
    shared = materialize(shared, "repeat-shared")
    members = materialize(segments.join(shared, F.col("h") == F.col("h_")).drop("h_", "h"), "repeat-members")
    forget(segments)
    first = members.groupBy("c1", "c2").agg(F.min("rid").alias("first")).withColumnsRenamed({"c1": "c1_", "c2": "c2_"})
    first = materialize(first, "repeat-first")
    known = members.join(first, (F.col("c1") == F.col("c1_")) & (F.col("c2") == F.col("c2_")))
    known = materialize(known.select(*ROW, "lo", "m", "varied", (F.col("rid") > F.col("first")).alias("whole")).where("whole or varied"), "repeat-known")
    forget(members)
    whole = known.where("whole").select(*ROW, F.col("lo").alias("start"), F.col("m").alias("windows"))
    todo = known.where("not whole").groupBy(*ROW).agg(F.collect_set(F.struct("lo", "m")).alias("todo")).withColumnsRenamed({c: f"{c}_" for c in ROW})

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, f1, f2, text, todo in zip(pdf["rid"], pdf["f1"], pdf["f2"], pdf["text"], pdf["todo"]):
                _, roll, other = _rolls(text, key)
                start = np.concatenate([np.arange(x["lo"], x["lo"] + x["m"]) for x in todo])
                w1, w2 = window_hash(roll, start, start + length), window_hash(other, start, start + length)
                yield pd.DataFrame({"w1": w1.view(np.int64), "w2": (w2 >> np.uint64(32)).astype(np.uint32).view(np.int32), "rid": rid, "f1": f1, "f2": f2, "start": start.astype(np.int32)})

    texts = keyed.join(todo.hint("merge"), _same(ROW, [f"{c}_" for c in ROW])).select(*ROW, "text", "todo")
    windows = materialize(texts.mapInPandas(extend, "w1 long, w2 int, rid long, f1 long, f2 long, start int"), "repeat-windows")
    least = windows.groupBy("w1", "w2").agg(F.min("rid").alias("a"), F.max("rid").alias("z")).where("a < z")
    least = least.select(F.col("w1").alias("w1_"), F.col("w2").alias("w2_"), "a")
    least = materialize(least, "repeat-least")
    single = windows.join(least, (F.col("w1") == F.col("w1_")) & (F.col("w2") == F.col("w2_")) & (F.col("rid") > F.col("a")))
    runs = whole.unionByName(single.select(*ROW, "start", F.lit(1).alias("windows")))
    return runs.groupBy(*ROW).agg(F.collect_set(F.struct("start", "windows")).alias("runs"))


def covered(n: int, runs, length: int) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    if runs is not None and len(runs):
        start = np.array([r["start"] for r in runs])
        end = start + np.array([r["windows"] for r in runs]) - 1 + length
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
    return np.cumsum(edge)[:n] > 0


def _with_runs(docs: DataFrame, length: int, anchor: int, *columns: Column | str) -> DataFrame:
    theirs, own = [f"__{c}" for c in ROW], [f"__own_{c}" for c in ROW]
    runs = repeats(docs, length, anchor).withColumnsRenamed(dict(zip(ROW, theirs)))
    marks = [c.alias(n) for c, n in zip((rank_id(F.col("doc_id")), *_marks()), own)]
    keyed = docs.select(*columns, "text", *marks)
    return keyed.join(runs.hint("merge"), _same(own, theirs), "left").drop(*own, *theirs)


def maximal_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, start_word, n_words of every maximal repeat of at least ``length`` words."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"]):
                n = len(text_words(text))
                edge = np.diff(np.concatenate(([0], covered(n, runs, length).astype(np.int8), [0])))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                yield pd.DataFrame({"doc_id": pd.array([doc] * len(start), "Int64"), "start_word": start, "n_words": end - start})

    return _with_runs(docs, length, anchor, "doc_id").where("runs is not null").mapInPandas(spans, "doc_id long, start_word long, n_words long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document's kept words joined by one space."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, runs in zip(pdf["text"], pdf["runs"]):
                words, removed = text_words(text), 0
                n = len(words)
                if runs is not None:
                    gone = covered(n, runs, length)
                    words, removed = list(compress(words, (~gone).tolist())), int(gone.sum())
                rows.append((n, removed, b" ".join(words).decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    return _with_runs(docs, length, anchor, "doc_id").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the words left when its repeats of earlier documents go.

    A null or empty text has no words and the digest of the empty text. Rows of one id don't repeat each other,
    whatever their texts; null ids rank last, together. Repeated rows are rows of their own with equal values; an
    empty table gives no rows. Further columns are ignored. Texts of any length are cut whole."""
    kept = remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
