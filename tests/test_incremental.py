"""Token cache and retractable lexicon: what a run finds, what a killed one leaves, and full recomputation."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions.profiles import LATIN
from lexiforge.operators import layout, lexicon
from lexiforge.operators import lexicon_state as states
from lexiforge.operators.token_cache import Run, TokenCache
from lexiforge.operators.tokenizers import RegexTokenizer

DAY = datetime.datetime(2024, 5, 1)
LISTS = "file_id long, path string, mtime timestamp, tag string, sentences array<struct<sent_ord:int,text:string>>"
TOKENIZER = RegexTokenizer()


def files(spark, rows):
    return spark.createDataFrame([(i, f"/c/{p}", DAY + datetime.timedelta(hours=h), "t", [(3 * k, s) for k, s in enumerate(own)]) for i, (p, h, own) in enumerate(rows)], LISTS)


def shown(cache, lists, keys):
    return sorted((r.file_id, r.sent_ord, r.text, [t.surface for t in r.tokens]) for r in cache.lists(lists, keys).collect())


def plain(lists):
    return sorted((r.file_id, s.sent_ord, s.text, s.text.split()) for r in lists.collect() for s in r.sentences)


def test_two_levels(spark, tmp_path):
    cache = TokenCache(spark, str(tmp_path), "fp")
    old = files(spark, [("a", 0, ["x y", "z"]), ("b", 0, ["u v"]), ("copy", 0, ["x y", "z"]), ("none", 0, [])])
    keys, run = cache.add(old, TOKENIZER)
    assert run == Run(0, 0, 4, 3, 5) and shown(cache, old, keys) == plain(old) and len(cache.commits()) == 1
    keys, run = cache.add(old, TOKENIZER)
    assert run == Run(4, 0, 0) and shown(cache, old, keys) == plain(old) and len(cache.commits()) == 1
    # touched, moved, changed, and unknown files
    new = files(spark, [("a", 5, ["x y", "z"]), ("moved", 0, ["u v"]), ("copy", 7, ["x y", "w w"]), ("none", 0, [])])
    keys, run = cache.add(new, TOKENIZER)
    assert run == Run(1, 2, 1, 2, 4) and shown(cache, new, keys) == plain(new) and len(cache.commits()) == 2
    assert cache.add(new, TOKENIZER)[1] == Run(4, 0, 0)
    other = TokenCache(spark, str(tmp_path), "other tokeniser")
    assert other.add(new, TOKENIZER)[1].fresh == 4 and len(cache.commits()) == 2
    assert cache.add(new.drop("path", "mtime"), TOKENIZER)[1] == Run(0, 4, 0)
    assert cache.add(new.limit(0), TOKENIZER)[1] == Run(0, 0, 0)


def test_time_alone_is_no_content(spark, tmp_path):
    """A path and time whose content never got committed is hashed and tokenised."""
    cache = TokenCache(spark, str(tmp_path), "fp")
    lists = files(spark, [("a", 0, ["x y"])])
    cache.add(lists, TOKENIZER)
    for folder in (tmp_path / cache.root.rsplit("/", 1)[1] / "contents").iterdir():
        for f in folder.iterdir():
            f.unlink()
    keys, run = cache.add(lists, TOKENIZER)
    assert run.fresh == 1 and shown(cache, lists, keys) == plain(lists)


def test_killed_commit(spark, tmp_path, monkeypatch):
    """A run that dies before its marker leaves nothing that counts, and its retry doubles nothing."""
    cache = TokenCache(spark, str(tmp_path), "fp")
    lists = files(spark, [("a", 0, ["x y", "z"]), ("b", 0, ["u v"])])

    def killed(self, commit):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(TokenCache, "_finish", killed)
        with pytest.raises(KeyboardInterrupt):
            cache.add(lists, TOKENIZER)
    assert cache.commits() == [] and cache.tokens().count() == 0
    keys, run = cache.add(lists, TOKENIZER)
    assert run == Run(0, 0, 2, 3, 5) and shown(cache, lists, keys) == plain(lists)
    assert cache.vacuum() == 1 and cache.vacuum() == 0 and shown(cache, lists, keys) == plain(lists)


def test_two_runs_commit_the_same(spark, tmp_path, monkeypatch):
    cache = TokenCache(spark, str(tmp_path), "fp")
    lists = files(spark, [("a", 0, ["x y", "z"])])
    nothing = cache.contents().limit(0)
    cache.add(lists, TOKENIZER)
    with monkeypatch.context() as m:
        m.setattr(TokenCache, "contents", lambda self: nothing)  # what a run sees that began at the same time
        assert cache.add(lists, TOKENIZER)[1].fresh == 1
    assert len(cache.commits()) == 2
    keys, run = cache.add(lists, TOKENIZER)
    assert run.fresh == 0 and shown(cache, lists, keys) == plain(lists)


# ---------------------------------------------------------------- the lexicon


def parts_of(spark, corpus):
    df = spark.createDataFrame([(i, tag, text) for i, (tag, text) in corpus.items()], "file_id long, tag string, text string")
    lists = lexicon.useful_lists(lexicon.counted_sentences(layout.sentence_lists(df), TOKENIZER, LATIN), TOKENIZER, LATIN)
    return df, states.partials(lexicon.numbered_tokens(lists)).cache(), lexicon.lexicon(lexicon.numbered_tokens(lists))


def rows_of(words):
    return sorted((r.lemma, round(r["index"], 12), r.index_count, r.frequency, r.reading, r.tags, r.pos, r.first_seen) for r in words.collect())


def test_files_come_change_and_go(spark):
    rng = random.Random(9)
    text = lambda: ". ".join(" ".join(rng.choices(["copper", "lantern", "bridge", "winter", "Meadow", "the"], k=rng.randint(1, 9))) for _ in range(rng.randint(1, 5)))
    corpus = {i: (rng.choice("ab"), text()) for i in range(12)} | {50: ("only", "unique words here")}
    df, parts, words = parts_of(spark, corpus)
    state = states.state_of(parts)
    assert rows_of(states.lexicon_of(state)) == rows_of(words)
    for _ in range(3):
        then = {i: v for i, v in corpus.items() if rng.random() > 0.3 and i != 50}
        then |= {i: (v[0], text()) for i, v in then.items() if rng.random() < 0.3} | {rng.randint(-9, -1): ("c", text())}
        df_then, parts_then, words = parts_of(spark, then)
        change = states.changed_files(df, df_then)
        gone, new = parts.join(change.gone, "file_id", "left_semi"), parts_then.join(change.new, "file_id", "left_semi")
        current = parts.join(change.gone, "file_id", "left_anti").unionByName(new)
        assert new.count() < parts_then.count()
        state = states.updated(state, gone, new, current).cache()
        assert rows_of(states.lexicon_of(state)) == rows_of(words)
        corpus, df, parts = then, df_then, parts_then
    assert states.updated(state, parts, parts.limit(0), parts.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_running_sum(spark, n):
    values = [(i * 7) % 5 for i in range(n)]
    got = spark.createDataFrame([(values,)], "v array<int>").select(T.running_sum(F.col("v")).alias("s")).first().s
    assert got == [sum(values[: i + 1]) for i in range(n)]


def test_one_large_file(spark):
    """A million useful tokens of one file are numbered without a window over it."""
    df = spark.range(1).select(F.lit(1).cast("long").alias("file_id"), F.lit("t").alias("tag"), F.repeat(F.lit("copper lantern bridge winter. "), 250_000).alias("text"))
    tokens = lexicon.numbered_tokens(lexicon.useful_lists(lexicon.counted_sentences(layout.sentence_lists(df), TOKENIZER, LATIN), TOKENIZER, LATIN))
    plan = tokens._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan
    r = tokens.agg(F.count("*").alias("n"), F.max("pos_no").alias("top"), F.sum("pos_no").alias("s"), F.max("n_file").alias("all")).first()
    assert (r.n, r.top, r.s, r["all"]) == (10**6, 10**6, 10**6 * (10**6 + 1) // 2, 10**6)
