"""op1 and op3 against brute force: copies, ties, nulls, empty and odd tables."""

import random

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import near_dedup as near
from lexiforge.llm import substring_dedup as sub
from lexiforge.llm.common import NULL_ID
from lexiforge.llm.components import components

SCHEMA = "doc_id long, text string, rid long, n int, before long, source string"


def table(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, 1, 2, 3, "s") for d, t in rows], SCHEMA)


def odd_rows(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "solo"), (5, "Solo"), (6, "und " * 40), (7, "und " * 40)]
    for i in range(8, 60):
        body = [rng.choice(vocab) for _ in range(rng.randint(1, 50))]
        at = rng.randint(0, len(body))
        kind = i % 4
        if kind == 0:
            body[at:at] = passage
        elif kind == 1:
            body[at:at] = passage[rng.randint(0, 10) : rng.randint(15, 30)]
        elif kind == 2:
            body = list(passage) + body[:2]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(body)))
    return rows


@pytest.mark.parametrize("length, anchor", [(12, 4), (5, 2)])
def test_repeats(spark, length, anchor):
    rows = odd_rows()
    got = sub.remove_repeats(table(spark, rows), length, anchor)
    assert sorted(map(tuple, got.collect())) == brute.repeats(rows, length)


def test_repeats_of_copies_and_ids(spark):
    text = " ".join(f"x{i}" for i in range(15))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, "a " + text)]
    got = sorted((r.doc_id if r.doc_id is not None else NULL_ID, r.n_removed) for r in sub.remove_repeats(table(spark, rows), 10, 4).collect())
    assert got == [(1, 0), (1, 0), (2, 15), (3, 15), (NULL_ID, 15)]
    spans = {tuple(r) for r in sub.maximal_repeats(table(spark, rows), 10, 4).collect()}
    assert (3, 1, 15) in spans and (2, 0, 15) in spans


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sub.remove_repeats(none).count() == 0
    assert near.near_groups(none).count() == 0


LEAST, GREATEST = near.Cell(1, 1, 1 << 10), near.Cell(1 << 20, 1 << 20, 1 << 40)


@pytest.mark.parametrize("how", [{"bucket": LEAST, "block": LEAST}, {"bucket": GREATEST, "block": GREATEST}])
def test_near_groups(spark, how):
    rng = random.Random(3)
    rows = odd_rows(2)
    base = [f"b{i}" for i in range(60)]
    for i in range(100, 140):  # a large group whose members differ from each other more than from the base
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(60)] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    got = {r.rid: (r.n_shingles, r.component) for r in near.near_groups(table(spark, rows), 2, **how).collect()}
    assert got == brute.groups(rows, 2)


def test_near_groups_odd_ids(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (2, "q r s t u v"), (9, "a b c d e f"), (None, "q r s t u v"), (7, None)]
    got = {(r.rid, r.component) for r in near.near_groups(table(spark, rows), 2).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (NULL_ID, 2), (7, 7)}
    kept = near.first_of_group(table(spark, rows), 2)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7] and kept.columns == table(spark, rows).columns


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for share in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(40):
            x = rng.integers(0, 1 << 62, 400).astype(np.uint64)
            k = int(400 * 2 * share / (1 + share))
            y = np.concatenate([x[:k], rng.integers(0, 1 << 62, 400 - k).astype(np.uint64)])
            true = k / (800 - k)
            a, b = (near.odd_sketch(near.minhashes(np.unique(s))) for s in (x, y))
            differing = np.bitwise_count(a ^ b).sum()
            errors.append(float(near.similarity(np.array([differing]))[0]) - true)
            assert share > 0.85 or differing <= near.most_differing()
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_components(spark, most):
    """The same components whether one task contracts all edges or rounds of stars tie many tasks'."""
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 41), (60, 60), (41, 50)]
    pairs += [(200, i) for i in range(100, 120)] + [(300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(25)]
    rng.shuffle(pairs)
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(8)
    got = [(r.node, r.root) for r in components(edges, most=most).collect()]
    assert sorted(got) == sorted((n, r) for n, r in root.items() if n != r)


def test_queries_whole(spark, sf):
    from lexiforge.llm.queries import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, queries()["op1_substring_dedup"](spark, sf).collect()))
    assert got == [(d, n, k, brute.sha(t)) for d, n, k, t in brute.repeats(docs, 50)]
    want = brute.groups(docs, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries()["op3_near_dedup"](spark, sf).collect()} == {d: (n, c, d == c) for d, (n, c) in want.items()}


def test_cells_span_batches():
    sketch = near.odd_sketch(near.minhashes(np.arange(1, 50, dtype=np.uint64))).tobytes()
    pdf = pd.DataFrame({"cell": [1, 1, 1, 2], "query": [True, False, False, True], "rid": [5, 6, 7, 8], "n": [9] * 4, "sketch": [sketch] * 4})
    edges = pd.concat(near.sketch_edges(80)(iter([pdf[:1], pdf[1:3], pdf[3:]])))
    assert sorted(zip(edges["a"], edges["b"])) == [(5, 6), (5, 7)]
    texts = pd.DataFrame({"cell": [1, 1, 2, 2], "query": [True, False, True, True], "rid": [5, 6, 7, 8], "text": ["a b c", "a  b c", "a b c", "d e"]})
    for cut in range(5):
        edges = pd.concat(near.set_edges(2, 80)(iter([texts[:cut], texts[cut:]])))
        assert list(zip(edges["a"], edges["b"])) == [(5, 6)]


def test_words_that_polynomials_confuse(spark):
    """Two long words that differ as a Thue-Morse word from its complement are different words."""
    twist = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = twist.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"x{i}" for i in range(49))
    for a, b in ((f"{rest} {twist}", f"{rest} {other}"), (twist, other)):
        rows = [(1, a), (2, b)]
        assert sorted(map(tuple, sub.remove_repeats(table(spark, rows)).collect())) == brute.repeats(rows, 50)
        assert {r.rid: (r.n_shingles, r.component) for r in near.near_groups(table(spark, [(1, twist), (2, other)]), 2).collect()} == {1: (1, 1), 2: (1, 2)}


def test_very_long_texts(spark):
    rng = random.Random(4)
    long = [rng.choice("abcdefgh") + str(rng.randrange(5000)) for _ in range(120_000)]
    near_copy = list(long)
    near_copy[7] = "other"
    rows = [(1, " ".join(long)), (2, " ".join(near_copy)), (3, " ".join(long[40_000:40_080])), (4, "q" * 300_000)]
    assert sorted(map(tuple, sub.remove_repeats(table(spark, rows)).collect())) == brute.repeats(rows, 50)
    assert {r.rid: r.component for r in near.near_groups(table(spark, rows), 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_first_columns_kept(spark):
    df = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, component string")
    assert near.first_of_group(df).select(F.col("component")).first().component == "x"


def test_rows_of_an_id_whose_short_hashes_clash(spark):
    """Two rows of one id, with equal 32-bit hashes of their texts; only one repeats a passage."""
    passage, plain = (" ".join(f"{c}{i}" for i in range(50)) for c in "pq")
    text = F.concat(F.when(F.col("id") % 2 == 0, passage).otherwise(plain), F.lit(" "), F.col("id").cast("string"))
    found = spark.range(400_000).groupBy(F.hash(text).alias("h")).agg(F.min(F.struct(F.col("id") % 2, "id")).alias("a"), F.max(F.struct(F.col("id") % 2, "id")).alias("b"))
    a, b = (r.id for r in found.where("a.col1 < b.col1").select("a", "b").first())
    rows = [(1, passage), (7, f"{passage} {a}"), (7, f"{plain} {b}"), (None, f"{passage} {a}"), (None, f"{plain} {b}")]
    docs = table(spark, rows)
    assert docs.where("doc_id = 7").select(F.hash("text")).distinct().count() == 1
    key = lambda r: tuple(map(repr, r))
    assert sorted(((NULL_ID if r[0] is None else r[0], *r[1:]) for r in sub.remove_repeats(docs).collect()), key=key) == sorted(brute.repeats([(NULL_ID if d is None else d, t) for d, t in rows], 50), key=key)


def test_shingles_whose_first_halves_clash(spark):
    """Two texts whose only shingles share 64 bits under the digests without a key."""
    texts = "ac27f5 b363fe", "a1f5aa5 b1d200f"
    one, two = (near.shingles(t, 2) for t in texts)
    assert one[0] == two[0] and one[1] != two[1]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[0].upper())]
    assert {r.rid: r.component for r in near.near_groups(table(spark, rows), 2).collect()} == {1: 1, 2: 2, 3: 1}
    edges = near.set_edges(2, 80)  # without a key: both halves decide
    pdf = pd.DataFrame({"cell": [1] * 5, "query": [True, True, False, False, False], "rid": range(5, 10), "text": [texts[0], texts[1], texts[1], texts[0], "x y"]})
    got = {frozenset(e) for e in pd.concat(edges(iter([pdf]))).itertuples(index=False)}
    assert got == {frozenset((6, 7)), frozenset((5, 8))}
    both = near.Block([one, two])
    assert len(both.one) == 2 and both.groups(80).tolist() == [0, 1]
    assert [both.find(*x).tolist() for x in (one, two)] == [both.items[0].tolist(), both.items[1].tolist()]
