"""MinHash near-dedup with odd sketches, exact in its links.

1. A document's set of word shingles becomes 128-bit fingerprints, made from keyed digests of the words
   (the key is drawn for the run, so no text can be written to clash). Equal sets are one class,
   pre-aggregated by a 128-bit set hash over both halves; only class representatives (least id) go on.
2. Representatives get SAMPLES minhashes. The first BANDS * ROWS of them form band keys; all
   of them are folded into an odd sketch: a parity bitmap of BITS bits, whose XOR with another
   one has a population count that tells high similarities precisely.
3. In a band bucket, pairs whose sketches and set sizes allow the similarity become
   candidate edges. Connected candidates form a block, which wholly contains every true group.
4. In a block links are confirmed on the full sets, by both halves of their fingerprints.

Buckets and blocks of every size are compared by one rule (``_links``): the first of the
group's members in a seeded order, all of them in a small group, are held against the whole group; then every member
outside the group's largest component so far is. So no link between components can be missing, what a large
group of near copies costs grows with its size, and no pairs are emitted but those that connect.
Queries and rows meet in cells of bounded rows and bytes, so a group is spread over tasks.

With ROWS = 4 and BANDS = 26 a pair at similarity 0.8 shares no bucket with probability 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import NULL_ID, documents, forget, materialize, mix, new_key, rank_id, rolling, text_words, window_hash, word_digests
from lexiforge.llm.components import Forest, components

SHINGLE = 5
PERCENT = 80
ROWS, BANDS = 4, 26
SAMPLES = 256
BITS = 256
#: Standard errors by which a sketch may fall short of the threshold.
MARGIN = 4.75
SEED = 5
#: Pairs of sketches compared in one numpy step, and texts held as Python objects at a time.
PAIRS, TEXTS = 1 << 18, 128


@dataclass(frozen=True)
class Cell:
    """Bounds of the comparison: members of a group asked at first, and rows and bytes of
    queries, or of rows that they are held against, in one cell."""

    sample: int
    rows: int
    size: int


BUCKET_CELL = Cell(64, 4096, 1 << 20)
BLOCK_CELL = Cell(32, 512, 8 << 20)

_ODD = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(SEED << 20)) | np.uint64(1)


def shingles(text: str | None, k: int, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of the k-word shingles, A-Z lower-cased: their first halves, sorted,
    and their second halves. A shorter text is one shingle, a text without words has none."""
    words = word_digests(text_words(text, lower=True), key)
    if not len(words):
        return (np.zeros(0, np.uint64),) * 2
    k = min(k, len(words))
    at = np.arange(len(words) - k + 1)
    one, two = (window_hash(rolling(words[:, i], i), at, at + k) for i in (0, 1))
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    new = np.concatenate(([True], one[1:] != one[:-1]))
    if not np.array_equal(two, two[new][np.cumsum(new) - 1]):  # first halves clash: both decide
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    return one[new], two[new]


def minhashes(items: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    room = np.empty((min(len(items), 128), SAMPLES), np.uint64)  # small enough to stay in the cache
    for i in range(0, len(items), 128):
        part = items[i : i + 128, None]
        np.minimum(least, np.multiply(part, _ODD, out=room[: len(part)]).min(0), out=least)
    return mix(least + np.arange(SAMPLES, dtype=np.uint64))


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit."""
    bits = np.bincount((samples % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def similarity(differing: np.ndarray) -> np.ndarray:
    """Estimate from the population count of two sketches' XOR."""
    part = np.minimum(differing / BITS, 0.4999)
    return 1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * part)


def most_differing(percent: int = PERCENT, margin: float = MARGIN) -> int:
    """Population count up to which a pair at the threshold must be kept: the expectation plus
    ``margin`` standard errors of the sampling and of the folding."""
    j = percent / 100
    j -= margin * np.sqrt(j * (1 - j) / SAMPLES)
    p = (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - j))) / 2
    return int(np.ceil(BITS * p + margin / 2 * np.sqrt(BITS * p * (1 - p))))


class Block:
    """Shingle sets of a block with postings: how many shingles a set shares with each."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(s) for s, _ in sets])
        one, two = (np.concatenate(x) for x in zip(*sets)) if sets else (np.zeros(0, np.uint64),) * 2
        values, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        self.one, self.two, self.clashes = values, two[first], 0
        if not np.array_equal(self.two[inverse], two):  # first halves clash: both decide
            order = np.lexsort((two, one))
            new = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
            inverse = np.empty(len(one), np.int64)
            inverse[order] = np.cumsum(new) - 1
            self.one, self.two = one[order][new], two[order][new]
            self.clashes = int(np.unique(self.one, return_counts=True)[1].max()) - 1
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(inverse, kind="stable")
        self.posting = owner[order].astype(np.int32)
        self.at = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(self.one)))))
        self.items = np.split(inverse, np.cumsum(self.sizes)[:-1]) if sets else []

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Items of the block among the fingerprints of another set."""
        last = len(self.one) - 1
        at = np.minimum(np.searchsorted(self.one, one), last)
        for _ in range(self.clashes):
            at = np.minimum(at + ((self.one[at] == one) & (self.two[at] != two)), last)
        return at[(self.one[at] == one) & (self.two[at] == two)]

    def shared(self, items: np.ndarray) -> np.ndarray:
        start, stop = self.at[items], self.at[items + 1]
        n = stop - start
        where = np.repeat(stop - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(self.posting[where], minlength=len(self.sizes))

    def linked(self, items: np.ndarray, size: int, percent: int) -> np.ndarray:
        both = self.shared(items)
        return np.flatnonzero((100 * both >= percent * (size + self.sizes - both)) & (both > 0))

    def groups(self, percent: int) -> np.ndarray:
        """Component of each set: one set outside the largest component after another is
        compared with all, until each of those has been."""
        forest, asked = Forest(len(self.sizes)), np.zeros(len(self.sizes), bool)
        while True:
            label = forest.labels()
            outside = np.flatnonzero(~asked & (label != np.bincount(label).argmax()))
            if not len(outside):
                return label
            i = int(outside[0])
            asked[i] = True
            hits = self.linked(self.items[i], self.sizes[i], percent)
            forest.join(np.full(len(hits), i), hits)


_FEATURES = pa.schema([("rid", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64())), ("bytes", pa.int64())])


def _features(docs: DataFrame, k: int, key: bytes) -> DataFrame:
    def features(rid: int, text: str | None) -> tuple:
        items, other = shingles(text, k, key)
        if not len(items):
            return rid, 0, 0, 0, b"", [], 0
        samples = minhashes(items)
        keys = window_hash(rolling(samples[: ROWS * BANDS]), np.arange(0, ROWS * BANDS, ROWS), np.arange(ROWS, ROWS * BANDS + 1, ROWS))
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
        s1, s2 = (int(mix(x).sum(dtype=np.uint64).astype(np.int64)) for x in (items, other))
        return rid, len(items), s1, s2, odd_sketch(samples).tobytes(), keys.view(np.int64), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = [features(rid, text) for rid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FEATURES.types)], schema=_FEATURES)

    keyed = docs.select(rank_id(F.col("doc_id")).alias("rid"), "text")
    return keyed.mapInArrow(run, "rid long, n int, s1 long, s2 long, sketch binary, keys array<long>, bytes long")


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells of rows that are sorted by cell: a cell never spans two frames."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        same = pdf["cell"].to_numpy() == pdf["cell"].iloc[-1] if len(pdf) else np.zeros(0, bool)
        if same.all():
            if held and len(pdf) and held[0]["cell"].iloc[-1] != pdf["cell"].iloc[-1]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf)
            continue
        yield pd.concat([*held, pdf[~same]], ignore_index=True)
        held = [pdf[same]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _ends(cell: np.ndarray) -> np.ndarray:
    """Where each row's cell ends."""
    last = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
    return np.repeat(last, np.diff(np.concatenate(([0], last))))


def sketch_edges(percent: int) -> Callable:
    """Comparer of band buckets: candidate edges (a, b) of the queries with their cells."""
    most = most_differing(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _streams(batches):
            rid, n = pdf["rid"].to_numpy(), pdf["n"].to_numpy().astype(np.int64)
            sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), -1)
            end = _ends(pdf["cell"].to_numpy())
            query = np.flatnonzero(pdf["query"].to_numpy())
            count = end[query] - query - 1  # a query meets what follows it in its cell
            upto = np.cumsum(count)
            forest, edges = Forest(len(pdf)), []
            at = 0
            while at < len(query):
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                own = count[at:stop]
                i = np.repeat(query[at:stop], own)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
                fit = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[fit], j[fit]
                near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= most
                edges += forest.join(i[near], j[near])
                at = stop
            a, b = np.array(edges, dtype=np.int64).reshape(-1, 2).T
            yield pd.DataFrame({"a": rid[a], "b": rid[b]})

    return run


def set_edges(k: int, percent: int, key: bytes = b"") -> Callable:
    """Comparer of blocks: links on full sets (a, b) of the queries with their cells, one for
    each component of the queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, ask, block, label, ids = None, [], None, None, None
        left: list[int] = []
        right: list[int] = []

        def close() -> None:
            nonlocal block, label, ids, ask
            block = Block([s for _, s in ask])
            ids, label = np.array([r for r, _ in ask], dtype=np.int64), block.groups(percent)
            left.extend(ids[label].tolist())
            right.extend(ids.tolist())
            ask = []

        for pdf in batches:
            for own_cell, rid, query, text in zip(pdf["cell"], pdf["rid"], pdf["query"], pdf["text"]):
                if own_cell != cell:
                    if ask:
                        close()
                    cell, block = own_cell, None
                own = shingles(text, k, key)
                if query:
                    ask.append((rid, own))
                    continue
                if ask:
                    close()
                if block is None or not len(block.one):
                    continue  # nothing with words is asked in this cell
                for j in {label[h]: h for h in block.linked(block.find(*own), len(own[0]), percent)}.values():
                    left.append(int(ids[j]))
                    right.append(rid)
            yield pd.DataFrame({"a": left, "b": right}, dtype="int64").query("a != b")
            left, right = [], []
        if ask:
            close()
            yield pd.DataFrame({"a": left, "b": right}, dtype="int64").query("a != b")

    return run


def _pieces(count: Column, size: Column, cell: Cell) -> Column:
    """Cells' worth of ``count`` rows with ``size`` bytes."""
    return F.greatest(F.lit(1), F.ceil(count / cell.rows), F.ceil(size / cell.size)).cast("int")


def _seeded() -> Column:
    """A row's place from 0 to below 1 in the order that samples are taken in. It is the row's in every
    group, so the bands of near copies tie them to the same row and their edges are the same."""
    return F.shiftrightunsigned(F.xxhash64("rid", F.lit(1)), 32) / F.lit(float(1 << 32))


def _in_cells(rows: DataFrame, payload: list[str], query: Column, n_queries: Column, n_rows: Column, compare: Callable, name: str) -> DataFrame:
    """Edges of the queries with all rows of their group g. The queries are dealt into ``n_queries``
    pieces, all rows into ``n_rows`` pieces; each pair of pieces is a cell. A query goes to the
    cells of its piece as one, and to those of the other pieces as a row."""
    piece = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), n).cast("int")
    rows = rows.select("g", "rid", *payload, query.alias("asks"), n_queries.alias("nq"), n_rows.alias("nr"))
    rows = rows.withColumns({"q": piece(F.col("nq"), 2), "r": piece(F.col("nr"), 3)})
    place = lambda q, r, asks: F.struct(q.alias("q"), r.alias("r"), F.lit(asks).alias("query"))
    none = F.array().cast("array<struct<q:int,r:int,query:boolean>>")
    asked = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: place(F.col("q"), r, True))
    others = F.filter(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: ~F.col("asks") | (q != F.col("q")))
    places = F.concat(F.when(F.col("asks"), asked).otherwise(none), F.transform(others, lambda q: place(q, F.col("r"), False)))
    dealt = rows.withColumn("at", F.explode(places)).select(F.xxhash64("g", "at.q", "at.r").alias("cell"), "at.query", "rid", *payload)
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", F.desc("query"), _seeded(), "rid")
    return materialize(dealt.mapInPandas(compare, "a long, b long").distinct(), name)


def _links(rows: DataFrame, payload: list[str], cell: Cell, compare: Callable, name: str) -> DataFrame:
    """Edges (a, b) whose components, inside each group, are those of all pairs that match.

    ``rows`` (materialised): g (group), rid, bytes, the group's rows gn and bytes gs, and the
    ``payload`` that ``compare`` reads."""
    share = F.least(F.lit(1.0), cell.sample / F.col("gn"))
    first = _seeded() < share
    n_rows = _pieces(F.col("gn"), F.col("gs"), cell)
    found = _in_cells(rows, payload, first, _pieces(F.col("gn") * share, F.col("gs") * share, cell), n_rows, compare, f"{name}-first")
    # groups that weren't asked whole: their members outside the largest component
    large = rows.where(F.col("gn") > cell.sample)
    if large.isEmpty():
        return found
    of = components(found, f"{name}-components")
    stars = of.select(F.col("root").alias("a"), F.col("node").alias("b"))
    placed = large.select("g", "rid", "bytes", first.alias("asked")).join(of, F.col("rid") == F.col("node"), "left")
    placed = materialize(placed.select("g", "rid", "bytes", "asked", F.coalesce("root", "rid").alias("comp")), f"{name}-placed")
    sizes = placed.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(F.col("g").alias("g_")).agg(F.max(F.struct("n", "comp")).alias("main")).select("g_", "main.comp")
    main = materialize(main.withColumnRenamed("comp", "main"), f"{name}-main")
    outside = placed.join(main, F.col("g") == F.col("g_")).where((F.col("comp") != F.col("main")) & ~F.col("asked"))
    outside = materialize(outside.select("g", "rid", "bytes"), f"{name}-outside")
    if outside.isEmpty():
        return stars
    left = outside.groupBy(F.col("g").alias("g_")).agg(F.count(F.lit(1)).alias("on"), F.sum("bytes").alias("os"))
    ids = outside.select(F.col("g").alias("g2_"), F.col("rid").alias("rid_")).distinct()
    again = large.join(materialize(left, f"{name}-left"), F.col("g") == F.col("g_"))
    again = again.join(ids.hint("merge"), (F.col("g") == F.col("g2_")) & (F.col("rid") == F.col("rid_")), "left")
    more = _in_cells(again, payload, F.col("rid_").isNotNull(), _pieces(F.col("on"), F.col("os"), cell), n_rows, compare, f"{name}-again")
    return stars.unionByName(more)


def _sized(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of the groups (g) with more than one row, with the rows gn and bytes gs of their group.
    The sums are written first, so a hot group can be split where it is joined."""
    sums = rows.groupBy(F.col("g").alias("g_")).agg(F.count(F.lit(1)).alias("gn"), F.sum("bytes").alias("gs")).where("gn > 1")
    return materialize(rows.join(materialize(sums, f"{name}-sums"), F.col("g") == F.col("g_")).drop("g_"), name)


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bucket: Cell = BUCKET_CELL, block: Cell = BLOCK_CELL) -> DataFrame:
    """rid, n_shingles, component per row: the least id reachable over links of at least
    ``percent``; texts without words are linked with nothing. Rows that share an id count
    as one document with all their links; null ids rank last, together. The cells' bounds
    change how the work is cut, never the result."""
    key = new_key()
    rows = materialize(_features(docs, k, key), "near-features")
    # aggregates are written before they are joined back: then either side of the join is a plain
    # exchange, and a hot class or bucket can be split
    classes = materialize(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("rid").alias("rep")), "near-classes")
    of_class = classes.withColumnsRenamed({"s1": "s1_", "s2": "s2_"})
    placed = rows.where("n > 0").join(of_class, (F.col("s1") == F.col("s1_")) & (F.col("s2") == F.col("s2_")))
    member = materialize(placed.select("rid", "rep"), "near-members")
    reps = placed.where("rid = rep").select("rid", "n", "sketch", "s1", "keys").dropDuplicates(["rid", "s1"])
    banded = materialize(reps.select(F.explode("keys").alias("g"), "rid", "n", "sketch", F.lit(48).alias("bytes")), "near-bands")
    shared = _sized(banded, "near-buckets")
    forget(banded)
    edges = _links(shared, ["n", "sketch"], bucket, sketch_edges(percent), "near-buckets")
    # rows of one id are one document
    edges = edges.unionByName(member.where("rid <> rep").groupBy("rid").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b"))
    blocks = components(edges, "near-blocks")
    forget(shared)
    nodes = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct())
    nodes = _sized(nodes.join(rows.select("rid", "bytes"), F.col("rid") == F.col("node")).select(F.col("root").alias("g"), "rid", "bytes"), "near-nodes")
    nodes = nodes.select("g", F.col("rid").alias("node"), "gn", "gs").distinct()
    # always a merge join: the plan is the same at every size
    texts = docs.select(rank_id(F.col("doc_id")).alias("rid"), "text").join(nodes.hint("merge"), F.col("rid") == F.col("node"))
    texts = materialize(texts.select("g", "rid", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), "gn", "gs"), "near-texts")
    links = _links(texts, ["text"], block, set_edges(k, percent, key), "near-links")
    links = links.unionByName(member.where("rid <> rep").select(F.col("rep").alias("a"), F.col("rid").alias("b")))
    group = components(links, "near-groups").withColumnsRenamed({"node": "node_", "root": "root_"})
    forget(texts)
    out = rows.select("rid", "n").join(group, F.col("rid") == F.col("node_"), "left")
    return out.select("rid", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root_", "rid").alias("component"))


def first_of_group(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` whose document has the least id of its group. Rows that share an id stay
    or go together; texts without words stay."""
    gone = near_groups(docs, k, percent).where("component <> rid").select("rid").distinct()
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that no name can clash
    keyed = docs.select(rank_id(F.col("doc_id")).alias("id"), own)
    return keyed.join(gone.hint("merge"), F.col("id") == F.col("rid"), "left_anti").select("row.*")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it is kept, on two-word shingles.

    A null text, or one without words, has size 0 and is its own component. Rows of one id count as one document with all
    their links, each with its own size; null ids too, after every other id. Repeated rows have equal values; an empty
    table gives no rows. Further columns are ignored."""
    got = near_groups(documents(spark, sf_dir), k=2)
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return got.select(known("rid").alias("doc_id"), "n_shingles", known("component").alias("component_id"), (F.col("rid") == F.col("component")).alias("kept"))
