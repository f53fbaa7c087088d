"""Text functions and normalisation on inline Japanese rows."""

from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions.normalize import normalise_column
from lexiforge.functions.profiles import JA
from lexiforge.operators import layout


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


NORMALISED = {
    "「こんにちは」": "こんにちは", "「こんにちは": "こんにちは", "こんにちは」": "こんにちは", "「あ」と「い」": "「あ」と「い」", "すごいいいいい！": "すごいいい！", "そうか・・・。": "そうか…", "→→次": "次",
    "・・・はい": "はい", "か\u3099": "が", "…・・・": "……", "あ　い う": "あいう", "": "", "「「「": "", '"': "", "（「『深い』」）": "深い", "[a(b)": "a(b)", "x" * 9: "xxx", None: None,
}


def test_normalise(spark):
    df = spark.createDataFrame([(k,) for k in NORMALISED], "t string")
    got = {r.t: (r.x, r.y) for r in df.select("t", normalise_column(F.col("t")).alias("x"), normalise_column(F.col("t"), True).alias("y")).collect()}
    assert {k: v[0] for k, v in got.items()} == NORMALISED and got["あ　い う"][1] == "あ い う"


def test_splits(spark):
    assert one(spark, "猫だ。犬！？　鳥! ?a", T.split_on_punctuation) == ["猫だ。", "犬！？", "鳥! ?", "a"]
    assert one(spark, "そうだ。」と", T.split_on_punctuation) == ["そうだ。", "」と"]
    assert one(spark, "a. b.c! d", T.split_after_terminator) == ["a.", "b.c!", "d"]
    assert one(spark, "x y\n\n\n\nz", T.paragraphs) == ["x　y", "z"]
    assert one(spark, None, T.split_on_punctuation) is None


def test_strip_and_indent(spark):
    assert one(spark, "　 猫 \n", T.strip) == "猫"
    assert one(spark, " \t　x", T.indent) == 7
    assert one(spark, "﻿ぱ{x}>", T.clean) == "はx"


def test_kana_and_counts(spark):
    assert one(spark, "カタカナー", T.kana_fold) == "かたかなー"
    assert one(spark, None, T.kana_fold) == ""
    assert one(spark, "[...]a[...]", lambda c: T.occurrences(c, "[...]")) == 2


def test_keep_filter(spark):
    keep = lambda c: T.keep_normalised(c, JA)
    assert one(spark, "今日は雨だ", keep) and not one(spark, "東京大学前は", keep)


def test_highlight_first_only(spark):
    df = spark.createDataFrame([("猫と猫", "猫", "t", 2.0), ("猫", "犬", None, 1.0)], "a string, b string, c string, d double")
    got = [r.x for r in df.select(T.highlight(*map(F.col, "abcd")).alias("x")).collect()]
    assert got[0] == "<span class='highlight'>猫</span>と猫<br><span class='tag sentence-tag'>t - 2.0</span>"
    assert got[1].startswith("猫<br>")


def test_source_tag(spark):
    assert one(spark, "file:/a/[t1]/x[t2].txt", T.source_tag) == "t1"
    assert one(spark, "/a/b.txt", T.source_tag) == "[no tag]"


def test_layout(spark):
    assert one(spark, "A\n  B\n  C\nD", layout.layout_mode) == "indented_continuation"
    assert one(spark, "A\n  B\n  C\nD", lambda c: layout.join_indented(T.lines(c))) == ["ABC", "D"]
    assert one(spark, "\n".join(["はい"] * 5), layout.layout_mode) == "line_dialogue"
    assert one(spark, "\n".join(["はい。"] * 4), layout.layout_mode) == "sentence_list"
    assert one(spark, "短い", layout.layout_mode) == "paragraph"
    assert one(spark, "", layout.layout_mode) == "paragraph"
