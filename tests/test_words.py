"""Lexicon, thresholds, scores, dictionary, examples."""

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import scoring as S
from lexiforge.functions.profiles import JA
from lexiforge.operators import dictionary, examples, lexicon, ranking
from lexiforge.operators.tokenizers import Pretokenized
from lexiforge.sources.dictionary_xml import entry_records, read_dictionary, write_dictionary

NOUN = ["名詞", "普通名詞", "一般", "*"]


@pytest.mark.parametrize("low, keep", [(1, 75), (3, 98), (2, 0), (5, 100)])
def test_threshold(spark, low, keep):
    rng = random.Random(low * 101 + keep)
    rows = [(f"w{i}", rng.choice((1, 1, 2, 3, 3, 8, 40))) for i in range(57)]
    order = sorted(f for _, f in rows)
    want = max(low, order[min(len(order) * (100 - keep) // 100, len(order) - 1)])
    words = spark.createDataFrame(rows, "lemma string, frequency long")
    if keep:
        assert ranking.frequency_threshold(words, low, keep).first().threshold == want
        assert {r.lemma for r in ranking.filter_frequency(words, low, keep).collect()} == {w for w, f in rows if f >= want}
    assert ranking.filter_frequency(words.limit(0), low).count() == 0


def test_scores(spark):
    words = spark.createDataFrame([("a", 0.1, 10, ["x", "y", "z"]), ("b", 0.9, 2, ["x"])], "lemma string, index double, frequency long, tags array<string>")
    assert {r.lemma: r.score for r in ranking.score_words(words).collect()} == {"a": 1000.0, "b": 115.11}
    tags = spark.createDataFrame([(1,), (10,), (20,)], "n int").select(S.tag_diversity(F.col("n")).alias("x"))
    assert [r.x for r in tags.collect()] == pytest.approx([0.1, 1.0, 1.0])


def test_nearest_rank(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([],)], "v array<double>").select(S.nearest_rank(F.col("v"), 0.5).alias("x"))
    assert [r.x for r in df.collect()] == [2.0, 3000.0]


XML = """<?xml version="1.0"?><!DOCTYPE words [<!ENTITY n "noun (common) (futsuumeishi)"><!ENTITY amp2 "x">]>
<words><entry><ent_seq>1</ent_seq><k_ele><keb>猫</keb><ke_pri>nf01</ke_pri></k_ele><r_ele><reb>ねこ</reb><re_pri>ichi1</re_pri></r_ele>
<sense><pos>&n;</pos><gloss>cat</gloss></sense><sense><gloss g_type="lit">feline</gloss></sense></entry>
<entry><ent_seq>2</ent_seq><k_ele><keb>猫</keb><ke_pri>nf48</ke_pri></k_ele><r_ele><reb>ねこ</reb></r_ele><sense><gloss>other &amp; more</gloss></sense></entry></words>"""


@pytest.fixture
def entries(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML, encoding="utf-8")
    return read_dictionary(spark, str(tmp_path / "d.xml")).cache()


def test_dictionary(spark, entries):
    assert entries.count() == 2
    first = entries.orderBy("entry_ord").first()
    assert first.senses[0].pos == ["noun (common) (futsuumeishi)"] and first.senses[1].gloss == ["feline"]
    assert dictionary.lookup(entries, "猫").count() == 2 and dictionary.lookup(entries, "犬").count() == 0
    best = {r.form: r for r in dictionary.definitions(entries).collect()}
    assert best["猫"].definition == "1. cat<br>2. feline" and best["猫"].priority == 4800 and best["ねこ"].priority == 1000
    assert best["猫"].first_reading == "ねこ"
    with pytest.raises(ValueError):
        dictionary.ranked_entries(entries, "none")
    words = spark.createDataFrame([("猫",), ("犬",)], "lemma string")
    got = {r.lemma: (r.definition, r.invalid) for r in dictionary.add_definitions(words, entries).collect()}
    assert got == {"猫": ("1. cat<br>2. feline", False), "犬": (None, True)}


def test_dictionary_files(spark, tmp_path):
    """Several files of several splits, each with entities of its own: one entry a row, in document order."""
    for f, value in (("a.xml", "first"), ("b.xml", "second")):
        entry = lambda i: f"<entry><ent_seq>{i}</ent_seq><k_ele><keb>{f[0]}{i}</keb></k_ele>\n<sense><pos>&x;</pos><gloss>&lt;{'é' * 50}&gt; &amp;</gloss></sense></entry>\n"
        (tmp_path / f).write_text(f'<!DOCTYPE w [<!ENTITY x "{value} one">]>\n<w>' + "".join(map(entry, range(200))) + "</w>\n", encoding="utf-8")
    (tmp_path / "c.xml").write_text("<w></w>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        records = entry_records(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 8 and records.where("size(split(record, '<entry>')) > 2").count() == 0
        got = read_dictionary(spark, str(tmp_path)).orderBy("entry_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.entry_ord, r.kanji[0].form, r.senses[0].pos) for r in got] == [(i + 200 * k, f"{f}{i}", [f"{v} one"]) for k, (f, v) in enumerate((("a", "first"), ("b", "second"))) for i in range(200)]
    assert {r.senses[0].gloss[0] for r in got} == {f"<{'é' * 50}> &"}
    read_dictionary(spark, str(tmp_path)).createOrReplaceTempView("once")
    write_dictionary(spark.table("once"), str(tmp_path / "again"), {"y": "first one"}, 150)
    assert len(list((tmp_path / "again").glob("part=*/*.txt"))) == 3 and "&y;" in next((tmp_path / "again").glob("part=000000000/*.txt")).read_text()
    assert read_dictionary(spark, str(tmp_path / "again")).orderBy("entry_ord").collect() == got


def test_useless(spark):
    rows = [("は", ["助詞", "係助詞"]), ("東京", ["名詞", "固有名詞"]), ("あ", NOUN), ("スーパー", NOUN), ("言っ", ["動詞", "一般"]), ("２０２４", NOUN), ("ABC", NOUN), ("テレビ", NOUN), ("言葉", NOUN), ("ヴィラ", NOUN)]
    df = spark.createDataFrame(rows, "lemma string, pos array<string>").select("lemma", lexicon.is_useless(F.col("lemma"), F.col("pos"), JA).alias("u"))
    assert [r.lemma for r in df.where("not u").collect()] == ["言葉", "ヴィラ"]


def test_lexicon(spark):
    """Against plain Python, over random sentences of two files."""
    rng, stock = random.Random(6), ["山道", "白い", "歩く", "灯台", "静か"]
    rows, sentences = [], []
    for f in (3, 8):
        for s in range(6):
            words = [rng.choice(stock) for _ in range(rng.randint(3, 6))]
            sentences.append((f, f"tag{f}", s, "".join(words) + "という長い道のりだった。"))
            rows += [(f, s, i, w + "ッ" * (i % 2), w, "ミチ", NOUN) for i, w in enumerate(words)] + [(f, s, 9, "を", "を", "ヲ", ["助詞", "格助詞"])]
    tokens = spark.createDataFrame(rows, "file_id long, sent_ord int, tok_ord int, surface string, lemma string, reading string, pos array<string>")
    valid = spark.createDataFrame(sentences, "file_id long, tag string, sent_ord int, text string")
    useful = lexicon.useful_tokens(Pretokenized(tokens).tokens(valid), JA)
    want = {}
    for w in {r[4] for r in rows} - {"を"}:
        per_file = [[r[4] for r in rows if r[0] == f and r[4] != "を"] for f in (3, 8)]
        places = [(x.index(w) + 1) / len(x) for x in per_file if w in x]
        want[w] = (sum(x.count(w) for x in per_file), round(sum(places) / len(places), 6), [f"tag{f}" for f, x in zip((3, 8), per_file) if w in x])
    got = {r.lemma: (r.frequency, round(r["index"], 6), r.tags) for r in lexicon.lexicon(useful).collect()}
    assert got == want and {r.reading for r in lexicon.lexicon(useful).collect()} == {"みち"}
    lists = lexicon.useful_lists(valid, Pretokenized(tokens), JA)
    assert sorted(map(repr, lexicon.numbered_tokens(lists).select(*useful.columns).collect())) == sorted(map(repr, useful.collect()))
    of_segments = lexicon.segment_lists(lists, JA)
    assert lexicon.segment_lemmas(of_segments).count() == len({(r[0], r[1], r[4]) for r in rows if r[4] != "を"})
    maps = {(r.file_id, r.sent_ord): r.lemma_surfaces for r in lexicon.lemma_surfaces(of_segments).collect()}
    assert maps == {(f, s): {r[4]: r[3] for r in rows if r[:2] == (f, s) and r[4] != "を"} for f, _, s, _ in sentences}


def attach(spark, words, segments):
    w = spark.createDataFrame(words, "lemma string, score double")
    rows = [(0, i, "t", text, [(lemma, lemma) for lemma in lemmas]) for i, (text, lemmas) in enumerate(segments)]
    s = spark.createDataFrame(rows, "file_id long, sent_ord int, tag string, text string, entries array<struct<lemma:string,surface:string>>")
    return {r.lemma: r.sentences for r in examples.attach_examples(w, examples.featured(s)).collect()}


def test_top_three(spark):
    """Against plain Python: the penalty's terms, ranks and ties of random sentences."""
    rng = random.Random(12)
    scores = {w: float(rng.randint(1, 900)) for w in ("岬", "港", "汽笛", "波止場", "朝霧")}
    segments = [("".join(own) + "が見えるとき、" + "遠く" * rng.randint(1, 9) + "なる。", own) for own in (rng.sample([*scores, "未知"], rng.randint(1, 4)) for _ in range(40))]
    plain = {}
    for i, (text, own) in enumerate(segments):
        known = [scores[w] for w in own if w in scores]
        mean = sum(known) / len(known) if known else 0.0
        spread = sum((x - mean) ** 2 for x in known) / len(known) if known else 0.0
        foreign = sum(not ("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff") for c in text) / len(text)
        for w in own:
            if w in scores:
                harder = sum(x > scores[w] for x in known)
                cost = spread / 100_000 + (len(own) - len(known)) / len(own) * 0.9 + abs(len(text) - 25) / 15 + max(0, 6 - len(known)) * 0.5 + foreign + abs(mean - scores[w]) / max(scores.values()) * 1.5 + harder / len(own) * 0.9
                plain.setdefault(w, {}).setdefault(text, (round(cost, 9), i, round(mean, 2)))
    got = attach(spark, list(scores.items()), segments)
    for w in scores:
        best = sorted((c, i, t, m) for t, (c, i, m) in plain.get(w, {}).items())[:3]
        assert [(s.text, s.score) for s in got[w]] == [(t, pytest.approx(m)) for _, _, t, m in best]


def test_two_decimals(spark):
    values = [0.125, 0.155, 0.165, 0.375, 0.005, 0.0049, 1 / 3, 0.995, 1.0, 0.29, 0.0, 12.345]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(S.two_decimals(F.col("x")).alias("s")).collect()
    assert [r.s for r in got[:-1]] == [f"{v:.2f}" for v in values[:-1]] and got[-1].s.startswith("12.3")


def test_copies_and_fallback(spark):
    got = attach(spark, [("目標", 500.0)], [("目標です。", ["目標"]), ("目標です。", ["目標"]), ("次の目標。", ["目標"])])
    assert len(got["目標"]) == 2
    prefixed = attach(spark, [("駅", 10.0)], [("甲>駅へ。", ["駅"]), ("乙>駅へ。", ["駅"]), ("丙>駅へ。", ["駅"])])
    assert [s.text[0] for s in prefixed["駅"]] == ["甲", "乙", "丙"] and prefixed["駅"][1].score == -10.0


def test_statistics_by_any_row_order(spark):
    """A mean that ties at the second decimal is the same whatever the order of its words' rows, and the
    correctly rounded quotient of the exact sum."""
    from fractions import Fraction

    rng, rows = random.Random(5), []
    words = [(f"w{i}", rng.randrange(1, 9999) / 10) for i in range(40)]
    for f in range(30):
        chosen = rng.sample(range(40), 20)
        rows += [(2 * f + k, 0, "src", f"text {f} {k}.", [(f"w{i}", f"w{i}") for i in order]) for k, order in enumerate((chosen, chosen[::-1]))]
    of = spark.createDataFrame(rows, "file_id long, sent_ord int, tag string, text string, entries array<struct<lemma:string,surface:string>>")
    scores = spark.createDataFrame(words, "lemma string, score double")
    got = {r.file_id: (r.mean, r.variance) for r in examples.sentence_statistics(examples.featured(of), scores).collect()}
    exact = {w: Fraction(str(s)) for w, s in words}
    for file_id, _, _, _, entries in rows:
        assert got[file_id][0] == float(sum(exact[w] for w, _ in entries) / len(entries))
        assert got[file_id] == got[file_id ^ 1]
