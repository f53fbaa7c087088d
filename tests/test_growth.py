"""What the plans' cost hangs on: arrays made once, texts dealt by file, classes that cost little per character."""

import re

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text
from lexiforge.functions.profiles import INVISIBLE, JA, LATIN, SCRIPT_MARKS, WS, quick
from lexiforge.functions.text import running_sum
from lexiforge.operators import examples, layout, lexicon
from lexiforge.plans import queries

CLASSES = {WS, INVISIBLE + SCRIPT_MARKS, *(getattr(p, c) for p in (JA, LATIN) for c in ("script", "broad", "narrow", "core"))}


def plan(df, name="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), name)().toString()


@pytest.mark.parametrize("members", sorted(CLASSES))
def test_quick_classes_have_the_same_members(spark, members):
    codes = spark.createDataFrame([(chr(c),) for c in range(1, 0x10400) if not 0xD800 <= c < 0xE000], "c string")
    seen = codes.agg(F.count_if(F.col("c").rlike(f"[{members}]") != F.col("c").rlike(quick(members))), F.count_if(F.col("c").rlike(quick(members)))).first()
    assert seen[0] == 0 and seen[1] > 0


def test_sentences_are_made_once(spark, sf):
    """A filter on the size of an array that is made from the text would make it twice, on the table's splits."""
    for df in (queries.extract_sentences(spark, sf), queries._counted(spark, sf)):
        assert not re.search(r"Filter .*size\((transform|filter|get)\(", plan(df))


def test_files_are_counted_where_they_are_dealt(spark, sf):
    """Texts move once, by file; of (file, lemma) nothing is shuffled, only lemmas are."""
    made = plan(lexicon.lexicon(queries._useful(spark, sf)), "executedPlan")
    assert made.count("Exchange") == 2 and "hashpartitioning(file_id" not in made


def test_empty_files_have_no_sentence(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "a", None), (3, "a", "Some words here. And more!")], "file_id long, tag string, text string")
    assert sorted(r.file_id for r in layout.extract_sentences(df).collect()) == [3, 3]


def test_running_sums_of_any_length(spark):
    rows = spark.createDataFrame([(n, [i % 7 for i in range(n)]) for n in (0, 1, 8, 9, 1000, 5003)], "n int, x array<int>")
    for r in rows.select("n", "x", running_sum(F.col("x")).alias("sums")).collect():
        assert r.sums == [sum(r.x[: i + 1]) for i in range(r.n)]


def test_sentences_are_judged_without_comparing_all_lemmas_with_all(spark):
    """Last surfaces and harder words come from places in arrays, not from a lambda per pair of lemmas."""
    words = [("b", "B"), ("a", "A"), ("b", "b"), ("c", "c"), ("a", "a"), ("b", "Bb")]
    useful = [(i, s, w, w, ["x"]) for i, (w, s) in enumerate(words)]
    schema = "file_id long, tag string, sent_ord int, text string, upto long, n_file long, useful array<struct<tok_ord:int,surface:string,lemma:string,reading:string,pos:array<string>>>"
    lists = spark.createDataFrame([(1, "t", 0, "A sentence that is long enough.", 6, 6, useful)], schema)
    of_segments = lexicon.segment_lists(lists, LATIN)
    assert [tuple(e) for e in of_segments.first().entries] == [("b", "Bb"), ("a", "a"), ("c", "c")]
    scores = spark.createDataFrame([("a", 5.0), ("b", 7.0)], "lemma string, score double")
    stats = examples.sentence_statistics(examples.featured(of_segments, LATIN), scores, unknown=True)
    assert {r.lemma: r.too_hard for r in stats.collect()} == {"b": 0, "a": 1, "c": 2}
    assert not re.search(r"transform\(array_distinct.*lambdafunction\(.*filter\(useful", plan(of_segments))


def test_what_is_asked_for_alone_is_counted_without_files(spark, sf):
    """Frequencies and tags come from the tokens: no row per (file, lemma), and what the lexicon has."""
    useful = queries._useful(spark, sf)
    words = lexicon.lexicon(useful)
    assert sorted(map(tuple, lexicon.frequencies(useful).collect())) == sorted(map(tuple, words.select("lemma", "frequency").collect()))
    assert sorted((r.lemma, *r.tags) for r in lexicon.tag_sets(useful).collect()) == sorted((r.lemma, *r.tags) for r in words.collect())
    for df in (lexicon.frequencies(useful), lexicon.tag_sets(useful)):
        assert not re.search(r"Aggregate \[file_id", plan(df))


def test_patterns_stay_off_texts_that_have_nothing_for_them(spark):
    """Single blanks are replaced without a pattern, and what stands between is made once, however often it is read."""
    texts = ["a b", "a  b", "a\tb", "\ta b \n", "", "a!  b? c", "!?", "!a", "あ！い", "x . y", " a", "b\n　c", "b\n\n\n\nc"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    marked = rows.select("text", text._even_blanks(F.col("text")).alias("even"), layout._may_be_indented(F.col("text")).alias("indented"), text._marked_stops(F.col("text")).alias("m"))
    for r in marked.collect():
        assert r.even == re.sub(r"[ \t]+", "　", r.text)
        assert r.indented == bool(re.search(r"(?:\A|\n)[ \t　]", r.text))
        assert [p.strip() for p in r.m.split(text.MARK)] == [p.strip() for p in re.split(r"(?<=[。．！？!?])\s*(?=[^\s。．！？!?])", r.text)]
    assert plan(rows.select(text.marked_paragraphs(F.col("text")).alias("m"))).count("regexp_replace") == 3


def test_tokens_travel_without_their_sentences_features(spark):
    """Digests and numbers of a sentence join its row; files without an id, or with the same one, stay apart."""
    rows = [(f, "t", 0, text, [(w, w) for w in lemmas]) for f, text, lemmas in ((None, "x y", "ab"), (0, "x y", "ab"), (1, "one", "ab"), (1, "two", "c"), (2, "none", "d"))]
    of_segments = spark.createDataFrame(rows, "file_id long, tag string, sent_ord int, text string, entries array<struct<lemma:string,surface:string>>")
    scores = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", 1.0)], "lemma string, score double")
    stats = examples.sentence_statistics(examples.featured(of_segments, LATIN), scores)
    got = sorted((r.file_id if r.file_id is not None else -1, r.lemma, r.surface, r.n_known, r.n_total, r.n_chars, r["mean"], r.too_hard) for r in stats.collect())
    two = lambda f: [(f, "a", "a", 2, 2, 3, 6.0, 1), (f, "b", "b", 2, 2, 3, 6.0, 0)]
    assert got == [*two(-1), *two(0), *two(1), (1, "c", "c", 1, 1, 3, 1.0, 0)]
    assert not re.search(r"text_key.*collect_list|collect_list.*text_key", plan(stats))


def test_words_that_need_more_examples_are_known_before_they_meet_all_tokens(spark):
    rows = [(1, "t", i, f"text {i}", [(w, w) for w in "ab"]) for i in range(5)]
    of_segments = examples.featured(spark.createDataFrame(rows, "file_id long, tag string, sent_ord int, text string, entries array<struct<lemma:string,surface:string>>"), LATIN)
    scores = spark.createDataFrame([("a", 5.0), ("b", 7.0)], "lemma string, score double")
    primary = examples.best_examples(examples.candidates(examples.sentence_statistics(of_segments, scores), 7.0)).where("lemma = 'a' or pos = 1")
    more = examples.fallback_examples(of_segments, scores, primary)
    assert [(r.lemma, r.pos, r.score) for r in more.orderBy("pos").collect()] == [("b", 2, -7.0), ("b", 3, -7.0)]
    assert "LeftOuter" not in plan(more)
