"""Edge cases of the Japanese rules, row by row; the queries run the same rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENTENCES = (
    "猫だ。犬！？　鳥! ?a", "そうだ。」と", "今日は雨だ", "東京大学前は", "カタカナー", "ヴィラ", "「彼は学校へ行った。」[...]", "名前>駅へ行く。", "名前>かな",
    "全然わからない", "やった", "ね", "abc。DEF", "行き方", "これは十文字以上の文章です。", "ｱｲｳ半角のカナです", "猫が、犬", "",
)
MARKS = (("nf01",), ("nf48",), ("ichi1",), ("nfxx", "news1"), ("ichi2", "spec2", "gai1"), ("unknown",), ())
POS_LISTS = (
    ("noun (common) (futsuumeishi)", "Suru verb"), ("adverb (fukushi)",), ("particle",), ("expressions (phrases, clauses, etc.)",),
    ("pre-noun adjectival (rentaishi)", "numeric"), ("something else",), (), ("transitive verb", "Ichidan verb"),
)
LEMMAS = (
    ("は", "助詞", "係助詞"), ("東京", "名詞", "固有名詞"), ("あ", "感動詞", "一般"), ("スーパー", "名詞", "普通名詞"), ("言っ", "動詞", "一般"), ("言葉", "名詞", "普通名詞"),
    ("２０２４", "名詞", "数詞"), ("ABC", "名詞", "普通名詞"), ("テレビ", "名詞", "普通名詞"), ("ヴィラ", "名詞", "普通名詞"), ("である", "助動詞", "*"), ("...", "記号", "*"), ("彼", "代名詞", "*"),
)


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SENTENCES)), "id int, text string")


def marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, list(m)) for i, m in enumerate(MARKS)], "id int, pri array<string>")


def pos_lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(POS_LISTS)], "id int, pos array<string>")


def lemmas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m, [a, b, "一般", "*"]) for i, (m, a, b) in enumerate(LEMMAS)], "id int, lemma string, pos array<string>")
