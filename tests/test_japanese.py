"""The Japanese rules on edge cases, against the SQL of their queries."""

import japanese_rows as rows
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import scoring as S
from lexiforge.functions.profiles import ngram_chars
from lexiforge.operators import userdict
from lexiforge.plans import oracle, queries

q = oracle.q


def values(columns, rows):
    return f"(values {', '.join(rows)}) as t({columns})"


def texts(items):
    return f"[{', '.join(map(q, items))}]::varchar[]"


SENTENCES = values("id, text", [f"({i}, {q(s)})" for i, s in enumerate(rows.SENTENCES)])
MARKS = values("id, pri", [f"({i}, {texts(m)})" for i, m in enumerate(rows.MARKS)])
POS = values("id, pos", [f"({i}, {texts(p)})" for i, p in enumerate(rows.POS_LISTS)])
LEMMAS = values("id, lemma, p1, p2", [f"({i}, {', '.join(map(q, m))})" for i, m in enumerate(rows.LEMMAS)])

CASES = {
    "split": (lambda s: queries.split_pieces(rows.sentences(s)), oracle.split_pieces(SENTENCES)),
    "fold": (lambda s: queries.folded(rows.sentences(s)), oracle.kana_fold(SENTENCES)),
    "quality": (lambda s: queries.quality_ja(rows.sentences(s)), oracle.quality_ja(SENTENCES)),
    "priority": (lambda s: rows.marks(s).select("id", S.priority_score(F.col("pri")).alias("points")), oracle.priority_scores(MARKS)),
    "pos": (lambda s: queries.resolved_pos(rows.pos_lists(s)), oracle.resolved_pos(POS)),
    "cost": (lambda s: queries.costs(rows.sentences(s)), oracle.costs(SENTENCES)),
    "useless": (lambda s: queries.useless(rows.lemmas(s)), oracle.useless(LEMMAS)),
    "ngrams": (lambda s: userdict.candidate_ngrams(rows.sentences(s)), oracle.GRAMS.format(low=2, high=20, members=ngram_chars(), source=SENTENCES)),
}


@pytest.mark.parametrize("name", CASES)
def test_edge_cases(spark, name):
    import duckdb

    frame, sql = CASES[name]
    got, want = frame(spark), duckdb.sql(sql)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    shown = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_tables_reach_every_branch(spark, sf):
    """The tables in Japanese script reach both sides of every rule."""
    quality = queries.sentence_quality_ja(spark, sf).agg(*(F.count_distinct(c).alias(c) for c in ("valid", "keep", "penalty")), F.count_if(F.col("key").contains(">")).alias("marked")).first()
    assert quality["valid"] == quality["keep"] == 2 and quality["penalty"] > 100 and quality["marked"] > 0
    assert {r["useless"] for r in queries.useless_lemmas(spark, sf).distinct().select("useless").collect()} == {True, False}
    costs = queries.userdict_cost(spark, sf).groupBy("e", "hiragana").count().collect()
    assert {(r["e"], r["hiragana"]) for r in costs} == {(a, b) for a in (True, False) for b in (True, False)}
    resolved = queries.pos_resolution(spark, sf)
    for c in ("nouns", "verbs_or_nouns", "expression"):
        assert resolved.select(c).distinct().count() == 2
    assert resolved.where("resolved is null").count() and resolved.select("resolved").distinct().count() > 5
    assert queries.priority_scores(spark, sf).select("points").distinct().count() > 5
