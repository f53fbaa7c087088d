"""Example sentences where their file was dealt: the same words and examples, and little that moves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.profiles import LATIN
from lexiforge.operators import examples, layout, lexicon, lexicon_state
from lexiforge.operators.tokenizers import RegexTokenizer
from lexiforge.plans import queries
from lexiforge.sources import files

SEGMENT = "file_id long, sent_ord int, tag string, text string, entries array<struct<lemma:string,surface:string>>"


def moved(spark):
    """Bytes that all stages so far have shuffled, spilled or written."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size())))


@pytest.mark.parametrize("name, most", [("attach_examples", 18), ("attach_fallback", 24), ("kept_rows", 30), ("mined_words", 30)])
def test_little_is_shuffled_and_staged(spark, name, most):
    """Against the stored size of the documents. Tokens in rows of their own were 35 times of it and more."""
    sf = "/root/testdata/sf0.01"
    before = moved(spark)
    queries.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    assert 0 < moved(spark) - before < most * os.path.getsize(f"{sf}/documents.parquet")


def test_deals_are_even(spark):
    dealt = files.dealt(spark.range(20000).withColumnRenamed("id", "file_id"), "file_id")
    numbers = dealt.schema["deal"].metadata["numbers"]
    rows = dealt.select(F.spark_partition_id().alias("p"), "deal").distinct().collect()
    assert len(rows) == len({r.p for r in rows}) == len({r.deal for r in rows}) == len(numbers) == dealt.rdd.getNumPartitions()


def test_lexicon_of_deals(spark, sf):
    """The same words as of tokens that aren't dealt, and the deals they are in."""
    docs = queries.table(spark, sf, "documents").select("doc_id", "source", "text")
    lists = [layout.sentence_lists(files.from_documents(d)) for d in (docs, files.dealt(docs, "doc_id"))]
    plain, dealt = (lexicon.file_tokens(x, RegexTokenizer(), LATIN) for x in lists)
    shown = lambda df: sorted(map(str, df.withColumn("index", F.round("index", 9)).collect()))
    words = lexicon.lexicon(dealt, RegexTokenizer.pos)
    assert shown(words.drop("deals")) == shown(lexicon.lexicon(plain, RegexTokenizer.pos))
    where = {(r.lemma, r.deal) for r in dealt.select("lemma", "deal").distinct().collect()}
    assert {(r.lemma, d) for r in words.collect() for d in r.deals} == where and len({d for _, d in where}) > 1


@pytest.mark.parametrize("seed", range(3))
def test_what_deals_choose_is_the_choice_of_all(spark, seed):
    """Copies of texts over many files, texts that share a key under speakers' marks, and many ties."""
    rng, lemmas = random.Random(seed), "岬港船灯"
    said = [("".join(rng.choices(lemmas, k=2)) + "が見える" * rng.randint(1, 2)) for _ in range(12)]
    rows = []
    for f in range(60):
        for s in range(4):
            text = rng.choice(said)
            text = (rng.choice(["", "", "甲>", "港の乙>"]) if text in said[:5] else "") + text
            rows.append((rng.choice([None, f, f, f]), s, "t", text, [(w, w) for w in lemmas if w in text]))
    rows = list({(f, s): (f, s, *r) for f, s, *r in rows}.values())
    plain = examples.featured(spark.createDataFrame(rows, SEGMENT))
    words = spark.createDataFrame([(w, float(10 * i)) for i, w in enumerate(lemmas)], "lemma string, score double")
    dealt = examples.with_variants(files.dealt(plain, "file_id"), examples.odd_keys(plain))
    assert {r.variants for r in dealt.select("variants").collect()} == {True, False}
    best = [examples.best_examples(examples.candidates(examples.sentence_statistics(s, words), 30.0, 1)) for s in (plain, dealt)]
    got = [sorted(map(str, b.collect())) for b in best]
    assert got[0] == got[1] and len(got[0]) == 12
    first = examples.staged(best[1].where("pos = 1"), "first")
    more = [sorted(map(str, examples.fallback_examples(s, words, first).collect())) for s in (plain, dealt)]
    assert more[0] == more[1] and len(more[0]) == 8
    named = examples.with_texts(best[1], dealt.select("deal", "file_id", "sent_ord", "text", "tag")).collect()
    texts = {(r[0], r[1]): r[3] for r in rows}
    assert len(named) == 12 and all(texts[r.file_id, r.sent_ord] == r.text and r.lemma in r.text for r in named)


def test_equal_ids_and_texts_of_two_tags_stay_apart(spark):
    """Their tokens are not those of one sentence."""
    rows = [(1, 0, t, "x y", [("a", "a"), ("b", "b")]) for t in ("s", "t")]
    scores = spark.createDataFrame([("a", 5.0), ("b", 7.0)], "lemma string, score double")
    stats = examples.sentence_statistics(examples.featured(spark.createDataFrame(rows, SEGMENT), LATIN), scores).collect()
    assert len(stats) == 4 and {r.n_known for r in stats} == {2}


def test_firsts_move_with_the_sums(spark):
    """A state comes from one pass over its partials, and no join."""
    schema = "file_id long, lemma string, frequency long, place long, first struct<at:struct<file_id:long,sent_ord:int,tok_ord:int>,tag:string>, tag string"
    parts = spark.createDataFrame([(f, "w", 2, 10, ((f, 0, 1), t), t) for f, t in ((3, "b"), (1, "a"), (2, "b"))], schema)
    state = lexicon_state.state_of(parts)
    assert "Join" not in state._jdf.queryExecution().executedPlan().toString()
    r = state.first()
    assert (r.frequency, r.n_files, int(r.place_sum), r.tag_files, r.first.at.file_id) == (6, 3, 30, {"a": 1, "b": 2}, 1)
