"""Tokens that follow from their surfaces carry nothing else, and are counted without sorting."""

from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions.profiles import JA, LATIN, quick
from lexiforge.operators import layout, lexicon
from lexiforge.operators.token_cache import TokenCache
from lexiforge.operators.tokenizers import JAPANESE_RUNS, RegexTokenizer

TOKENIZER = RegexTokenizer()
TEXT = "Copper bridges!  Copper? the LANTERN.\n\nAnd copper; once more.Then the bridge . x\nof it"


def corpus(spark):
    rows = [(1, "a", TEXT), (2, "b", ""), (3, "b", "the and of"), (4, "c", "a short line.\n" * 6 + "Lanterns! and more")]
    return spark.createDataFrame(rows, "file_id long, tag string, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_file_tokens_are_the_numbered_tokens(spark):
    lists = layout.sentence_lists(corpus(spark))
    got = lexicon.file_tokens(lists, TOKENIZER, LATIN)
    want = lexicon.numbered_tokens(lexicon.useful_lists(lexicon.counted_sentences(lists, TOKENIZER, LATIN), TOKENIZER, LATIN))
    assert "pos" not in got.columns and "reading" not in got.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows and rows == sorted(tuple(r) for r in want.select(*got.columns).collect())


def test_tokens_are_counted_by_hash(spark):
    made = plan(lexicon.file_positions(lexicon.file_tokens(layout.sentence_lists(corpus(spark)), TOKENIZER, LATIN)))
    assert "HashAggregate" in made and "SortAggregate" not in made and "ObjectHash" not in made


def test_tokens_with_attributes_keep_those_of_the_first(spark):
    rows = [(1, "a", 0, 1, "w", "late", ["x"], 2, 3), (1, "a", 0, 0, "w", "early", ["y"], 1, 3), (1, "a", 1, 0, "w", "alas", ["a"], 3, 3)]
    useful = spark.createDataFrame(rows, "file_id long, tag string, sent_ord int, tok_ord int, lemma string, reading string, pos array<string>, pos_no long, n_file long")
    r = lexicon.lexicon(useful).first()
    assert (r.frequency, r.reading, r.pos, tuple(r.first_seen), round(r["index"], 9)) == (3, "early", ["y"], (1, 0, 0), round(1 / 3, 9))


def test_sentences_of_the_whole_text_are_those_of_its_pieces(spark):
    texts = [TEXT, "", " . x", "a.b!\n\n\n ?c。 d", "x. \n\ny", "e.\t \n\n", "。。あ！ い\n？う", "no end", "a.\n\n.b", "1.  2。\n3", "「あ。」い!?  う"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    pieces = F.flatten(F.transform(T.paragraphs(F.col("text")), T.split_after_terminator))
    for mode, parts in ((layout.PARAGRAPH, pieces), (layout.LIST, T.full_lines(F.col("text"))), (layout.INDENTED, layout.join_indented(T.lines(F.col("text"))))):
        got = layout.sentences_of(F.col("text"), F.lit(mode))
        want = F.flatten(F.transform(parts, T.split_on_punctuation))
        for r in rows.select("text", got.alias("got"), want.alias("want")).collect():
            assert r.got == r.want, (mode, r.text)
    assert layout.sentences_of(F.col("text"), F.lit(layout.PARAGRAPH))._jc.toString().count("lambdafunction") <= 2


def test_useless_lemmas_by_one_pattern(spark):
    words = ["", "12", "１２", "abc", "é-'", "×", "っ", "言っ", "言う", "あ", "ア", "アイー", "あい", "漢", "ー", "a漢", "漢\n"]
    pos = F.array(F.lit("名詞"), F.lit("一般"))
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    useful = {r.w for r in rows.where(~lexicon.is_useless(F.col("w"), pos, JA)).collect()}
    assert useful == {"言う", "あい", "漢", "a漢", "漢\n"}
    assert lexicon.is_useless(F.col("w"), pos, JA)._jc.toString().lower().count("rlike") <= 1


def test_what_a_tokeniser_is_made_of():
    assert TOKENIZER.only_of(LATIN.script) and not JAPANESE_RUNS.only_of(JA.script) and not RegexTokenizer("[a-z0-9]+").only_of(LATIN.script)
    assert "&&" not in quick(LATIN.script) and "&&" in quick(JA.script + "a")


def test_cached_tokens_move_only_as_what_is_made_of_them(spark, tmp_path):
    cache = TokenCache(spark, str(tmp_path), TOKENIZER.fingerprint)
    lists = layout.sentence_lists(corpus(spark))
    keys, run = cache.add(lists, TOKENIZER)
    sizes = cache.lists(lists, keys, F.size("tokens").alias("n")).select("file_id", "sent_ord", "n")
    want = cache.lists(lists, keys).select("file_id", "sent_ord", F.size("tokens").alias("n"))
    rows = sorted(tuple(r) for r in sizes.collect())
    assert rows and rows == sorted(tuple(r) for r in want.collect())
    assert (run.sentences, run.tokens) == (len(rows), sum(n for *_, n in rows))
    above_scan = plan(sizes).split("Scan parquet")[0]
    assert "tokens#" not in "".join(line for line in above_scan.split("\n") if "Join" in line or "Exchange" in line or "Sort" in line)
