"""User dictionary and the text operators it stands on: classes, splits, brackets, forms in runs, commands."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexiforge import userdict_cli
from lexiforge.functions import normalize
from lexiforge.functions import text as T
from lexiforge.functions.profiles import LATIN_LETTERS, ngram_chars
from lexiforge.operators import layout, userdict
from lexiforge.operators.tokenizers import RegexTokenizer


def test_class_of_ngrams(spark):
    """Every code point against its name, in all planes."""
    codes = spark.range(0x80, 0x110000).where("id < 55296 or id > 57343")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    got = {r.id for r in codes.where(char.rlike(f"^[{ngram_chars()}]$")).collect()}
    named = {c for c in range(0x80, 0x110000) if any(n in unicodedata.name(chr(c), "") for n in ("HIRAGANA", "KATAKANA", "CJK UNIFIED IDEOGRAPH"))}
    assert got == named | {ord(c) for c in "ー々〆ヵヶ"}


def test_control_characters_part_nothing(spark):
    df = spark.createDataFrame([("ab\u0001cd. e\u0001f!? g。h", "ab\u0001cd\n  ef\n  gh\nij")], "t string, lines string")
    r = df.select(T.split_after_terminator(F.col("t")).alias("a"), T.split_on_punctuation(F.col("t")).alias("b"), layout.join_indented(T.lines(F.col("lines"))).alias("c")).first()
    assert r.a == ["ab\u0001cd.", "e\u0001f!?", "g。h"] and r.b == ["ab\u0001cd. e\u0001f!?", "g。", "h"] and r.c == ["ab\u0001cdefgh", "ij"]


def repaired(text):
    while True:
        before = text
        for left, right in normalize.PAIRS:
            first, last = text.startswith(left), text.endswith(right)
            opened, closed = text.count(left), text.count(right)
            wrapped = first and last and opened == 1 and closed == 1
            text = text[1 if wrapped or first and not closed else 0 :]
            text = text[:-1] if wrapped or last and not opened else text
        if text == before:
            return text


def test_brackets(spark):
    rng = random.Random(8)
    stock = "「」『』（）()\"'“”xy"
    texts = ["", "\"", "''", "「」", "(a", "a)", "「(a)」", None] + ["".join(rng.choices(stock, k=rng.randint(1, 12))) for _ in range(1500)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", normalize.repaired(F.col("t")).alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: t if t is None else repaired(t) for i, t in enumerate(texts)}


def test_many_brackets_cost_their_number(spark):
    def seconds(n):
        df = spark.createDataFrame([("(" * n + "x",)], "t string").select(normalize.repaired(F.col("t")).alias("r"))
        began = time.monotonic()
        assert df.first().r == "x"
        return time.monotonic() - began

    seconds(10)
    assert seconds(20_000) < 30


@pytest.mark.parametrize("seed", range(3))
def test_forms_in_runs(spark, seed):
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choices("abcX", k=rng.randint(1, most)))
    texts = [None, "", "a" * 50, *(" 1,".join(word(30) for _ in range(6)) for _ in range(40))]
    forms = [None, "a" * 20, "a" * 21, "a", "a b", *(word(9) for _ in range(200)), *(t[i : i + k] for t in texts[3:20] for i, k in [(rng.randint(0, 20), rng.randint(2, 22))])]
    lines = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.candidate for r in userdict.forms_in(lines, spark.createDataFrame([(f,) for f in forms], "form string"), members=LATIN_LETTERS).collect()]
    found = {r for t in texts for r in re.findall("[a-zA-Z]+", t or "")}
    assert len(got) == len(set(got)) and set(got) == {f for f in forms if f and 2 <= len(f) <= 20 and re.fullmatch("[a-zA-Z]+", f) and any(f in r for r in found)}
    grams = {r.candidate for r in userdict.candidate_ngrams(lines, members=LATIN_LETTERS).collect()}
    assert grams == {r[i : i + k] for r in found for i in range(len(r)) for k in range(2, 21) if i + k <= len(r)}


def test_unsegmented(spark):
    rows = spark.createDataFrame([("abc",), ("abcdefg",), ("",), ("---",)], "candidate string")
    assert sorted(r.candidate for r in userdict.unsegmented(rows, RegexTokenizer("[a-z]{1,3}")).collect()) == ["", "---", "abcdefg"]


def test_commands(spark, tmp_path):
    entry = lambda w, pos: f"<entry><ent_seq>1</ent_seq><k_ele><keb>{w}</keb></k_ele><r_ele><reb>{w}R</reb></r_ele><sense><pos>{pos}</pos><gloss>x</gloss></sense></entry>"
    (tmp_path / "d.xml").write_text("<w>" + entry("猫が好き", "Ichidan verb") + entry("犬小屋", "noun (common) (futsuumeishi)") + entry("鳥籠", "noun (common) (futsuumeishi)") + "</w>")
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.txt").write_text("\n 猫が好き、犬小屋 \n")
    (tmp_path / "in/b.md").write_text("鳥籠")
    run = lambda *a: userdict_cli.main([str(x) for x in a])
    run("compile", "-i", tmp_path / "d.xml", "-o", tmp_path / "d")
    run("candidates", "-i", tmp_path / "in", "-o", tmp_path / "grams")
    assert {r.value for r in spark.read.text(str(tmp_path / "grams")).collect()} == {"猫が", "猫が好", "猫が好き", "が好", "が好き", "好き", "犬小", "犬小屋", "小屋"}
    run("build", "-i", tmp_path / "in", "-o", tmp_path / "rows", "--dictionary", tmp_path / "d")
    rows = sorted(tuple(r)[:6] for r in spark.read.csv(str(tmp_path / "rows")).collect())
    assert rows == [("犬小屋", "0", "0", "5250", "犬小屋", "名詞"), ("猫が好き", "0", "0", "7000", "猫が好き", "動詞")]
