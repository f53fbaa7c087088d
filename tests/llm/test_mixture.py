"""op11, op12 and op13: against plain Python, their SQL, and round trips."""

import glob
import hashlib
import os
import re
from math import floor, log
from random import Random
from zlib import crc32

import numpy as np
import pytest

from lexiforge.llm import fill_in_middle as fim
from lexiforge.llm import importance, packing
from lexiforge.llm.bpe_codec import TOKENIZER, tokenizer_path
from lexiforge.llm.queries import oracle_sql, queries

CLASH = "doc_id long, text string, n long, form string, row string, n_words long, ids binary, length long, piece int"
ODD = [(1, None), (2, ""), (None, "x y z"), (None, "x y z"), (3, "a <P> b"), (3, "tie"), (3, "tie"), (5, "long " * 60000), (6, "é\n\x00\x01<\n>" * 40), (7, "<" * 50), (8, "Ab cd! " * 60), (9, "<|endoftext|> in " * 9)]


def table(spark, rows=ODD):
    return spark.createDataFrame([(d, t, 1, "x", "r", 2, b"i", 3, 4) for d, t in rows], CLASH)


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_importance_resampling"])
def test_sql(spark, sf, duck, name):
    got = queries()[name](spark, sf)
    want = duck.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


# ---------------------------------------------------------------- fill-in-the-middle


def cut(doc_id, text, seed=1, rate=90, spm=20):
    x = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", x)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not x or any(k in x for k in fim.MARKS) or h[2] % 100 >= rate:
        return len(w), "plain", None, None, x
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(w), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("draws", [(1, 90, 20), (7, 100, 100), (7, 100, 0), (7, 0, 50)])
def test_fill_in_middle(spark, monkeypatch, draws):
    rows = ODD + [(i, "".join(Random(i).choices("abAB<>PSM \n9é😀", k=i))) for i in range(20, 120)]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t in rows:
        n, form, p, m, out = cut(d, t, *draws)
        want.append((d, n, form, p, m, out, digest(out), digest(t or "")))
    got = fim.fill_in_middle(table(spark, rows), *draws)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert fim.fill_in_middle(table(spark).limit(0)).count() == 0
    assert {r.output for r in fim.fill_in_middle(table(spark), texts=False).collect()} == {None}


def test_batches_are_parted_whole():
    import pyarrow as pa

    texts = [None, "", "x" * (fim.BYTES + 1), "y", "z" * fim.BYTES] + ["w"] * (2 * fim.ROWS)
    parts = list(fim._slices(pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or p.num_rows <= fim.ROWS and sum(map(len, filter(None, p.column("text").to_pylist()))) <= fim.BYTES for p in parts)


# ---------------------------------------------------------------- importance resampling


def drawn(docs, target, order, buckets, min_words, percent, seed):
    cut_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]
    hashed = lambda t: [crc32(g.encode()) % buckets for g in grams(cut_words(t))]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in docs:
        np.add.at(s, hashed(x), 1)
    for x in target:
        np.add.at(t, hashed(x), 1)
    gain = [floor(1000 * log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out = []
    for d, x in docs:
        f = hashed(x)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(cut_words(x))))
    able = sorted((-r[3], 1 << 63 if r[0] is None else r[0], i) for i, r in enumerate(out) if r[4] >= min_words)
    ranks = {i: k + 1 for k, (_, _, i) in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], ranks.get(i)) for i, r in enumerate(out)]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_resample(spark, order):
    rng = Random(order)
    rows = [r for r in ODD if r != (3, "tie")] + [(i, " ".join(rng.choices(["ab", "Cd", "é", "x-y", "9", "I"], k=i % 50))) for i in range(20, 140)]
    target = ["ab cd ab", None, "é é Cd ab"]
    settings = (order, 97, 3, 30, 5)
    got = importance.resample(table(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, row int"), *settings)
    key = lambda r: tuple(map(repr, r))
    got = [(r.row.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()]
    assert sorted(got, key=key) == sorted(drawn(rows, target, *settings), key=key)
    assert sum(r[4] is not None for r in got) > 20


def test_resample_ties_and_empties(spark):
    target = spark.createDataFrame([("w w",)], "text string")
    got = importance.resample(table(spark, [(4, "w " * 30)] * 50), target, percent=30).select("row.*", "weight", "score", "rank").collect()
    assert sorted(r.rank for r in got if r["rank"]) == list(range(1, 16)) and len({(r.weight, r.score) for r in got}) == 1
    assert importance.resample(table(spark).limit(0), target).count() == 0
    bare = importance.resample(table(spark), target.limit(0))
    assert bare.count() == len(ODD) and bare.where("n_features = 0 and weight <> 0").count() == 0


# ---------------------------------------------------------------- packing


def random_lengths(rng, capacity, most):
    return {rng.randint(1, capacity): rng.choice([1, 2, 3, most]) for _ in range(rng.randint(1, 60))}


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_length(seed):
    rng = Random(seed)
    capacity = rng.choice([1, 7, 64, 256])
    lengths = random_lengths(rng, capacity, 10**9)
    sequences, bound = packing.plan(lengths, capacity)
    held: dict = {}
    for count, filling in sequences:
        assert count > 0 and sum(length * n for length, n in filling) <= capacity
        for length, n in filling:
            held[length] = held.get(length, 0) + n * count
    assert held == lengths
    n = sum(count for count, _ in sequences)
    assert bound <= n and -(-sum(k * v for k, v in lengths.items()) // capacity) <= n
    assert len(sequences) < 60 * 60 * 4  # as many entries as lengths and phases make, not as pieces


def test_plan_beats_best_fit_where_pairs_must_match():
    lengths = {n: 1000 for n in (600, 601, 602, 503, 504, 505, 423, 424, 300, 301, 274, 275)}
    have = np.zeros(1025, np.int64)
    have[list(lengths)] = list(lengths.values())
    solved, bound = packing.plan(lengths, 1024)
    assert bound <= sum(n for n, _ in solved) <= sum(n for n, _ in packing.best_fit(have, {}, 1024))


def test_knapsack_is_exact():
    rng = Random(3)
    value = np.full(31, -np.inf)
    for length in (3, 4, 7, 11):
        value[length] = rng.random() * length
    best, _ = packing.knapsack(value, 30)
    for c in range(31):
        assert best[c] == pytest.approx(max(sum(k * value[x] for k, x in zip(ks, (3, 4, 7, 11))) for ks in np.ndindex(11, 8, 5, 3) if sum(k * x for k, x in zip(ks, (3, 4, 7, 11))) <= c))


def check_packed(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_odd_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    want = []
    for d, t in ODD:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, i // 128, i, min(128, len(ids) - i), np.array(ids[i : i + 128], "<u4").tobytes()) for i in range(0, len(ids), 128)]
    packed = packing.pack(packing.pieces(table(spark), 128), 128).cache()
    assert packed.where("crc32(ids) <> ids_crc32").count() == 0
    rows = packed.collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows), key=key) == sorted(want, key=key)
    assert check_packed(rows, 128) == -(-sum(r.length for r in rows) // 128)
    again = {(r.doc_id, r.piece, r.sequence_id, r.offset) for r in packing.pack(packing.pieces(table(spark).repartition(3), 128), 128).collect()}
    assert again == {(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack(packing.pieces(table(spark).limit(0))).count() == 0


def test_packing_query(spark, sf):
    """The whole table against the library, and as few sequences as the volume allows."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    library.no_truncation()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(r.doc_id, i // 4096, i, len(ids[i : i + 4096]), crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)}
    rows = queries()["op13_best_fit_packing"](spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_packed(rows, 4096) == -(-sum(r.length for r in rows) // 4096)
