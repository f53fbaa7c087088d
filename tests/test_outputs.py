"""Sources, sinks, change-sets, user dictionary, cache, whole runs."""

import csv
import json
import re

import pytest
from pyspark.sql import functions as F

from lexiforge import cli
from lexiforge.functions.profiles import LATIN
from lexiforge.operators import lexicon, sync, token_cache, tokenizers, userdict
from lexiforge.operators.tokenizers import RegexTokenizer
from lexiforge.plans import mining
from lexiforge.plans.mining import Config, Pipeline, mine, observed
from lexiforge.plans.queries import queries
from lexiforge.sources import files, sinks
from lexiforge.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "nested").mkdir()
    for name, data in {"a.txt": b"x\r\ny\rz", "b.md": b"-", "nested/c.srt": b"c", "d[t1].TXT": "猫".encode()}.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_gather(spark, folder):
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(files.gather(spark, str(folder))) == ["a.txt", "d[t1].TXT"]
    assert names(files.gather(spark, str(folder), True)) == ["a.txt", "c.srt", "d[t1].TXT"]
    assert names(files.gather(spark, str(folder / "b.md"))) == ["b.md"]
    with pytest.raises(FileNotFoundError):
        files.gather(spark, str(folder / "none"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_corpus(spark, str(folder)).collect()}
    assert rows["a.txt"].text == "x\ny\nz" and rows["d[t1].TXT"].tag == "t1" and rows["a.txt"].file_id == 0


def test_bad_bytes_raise(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe\xff")
    with pytest.raises(Exception):
        files.read_corpus(spark, str(tmp_path)).collect()


def words_table(spark):
    kind = "lemma string, index double, frequency long, score double, reading string, definition string, tags array<string>, sentences array<struct<text:string,tag:string,origin:string,surface_form:string,score:double>>, invalid boolean, first_seen struct<f:int>"
    rows = [("low", 0.5, 3, 10.0, "r", "d", ["b", "a"], [], False, (0,)), ("drop", 0.5, 3, 999.0, "r", None, ["a"], [], True, (1,)), ("high", 0.25, 9, 100.0, "r", 'say "x"', ["a"], [("猫がいる", "t", None, "猫", 1.5)], False, (2,))]
    return spark.createDataFrame(rows, kind)


def test_word_files(spark, tmp_path):
    out = tmp_path / "out.csv"
    assert sinks.write_words(words_table(spark), out) == {"kept": 2, "dropped": 1, "sentences": 1}
    kept = list(csv.reader(out.open(encoding="utf-8")))
    assert [r[1] for r in kept] == ["high", "low"] and kept[1][6] == "a b" and kept[0][5] == 'say "x"' and kept[0][3] == "0.25"
    assert "highlight" in kept[0][8] and kept[1][8] == "no sentences :("
    assert list(csv.reader((tmp_path / "out.dropped.csv").open()))[0][1] == "drop"
    assert list(csv.reader((tmp_path / "out.sentence.csv").open(encoding="utf-8")))[1][:4] == ["kept", "high", "100.0", "猫がいる"]


def test_word_tables(spark, tmp_path):
    """The same rows as folders of sorted parts."""
    assert sinks.write_word_tables(words_table(spark), str(tmp_path)) == {"kept": 2, "dropped": 1, "sentence": 1}
    kept = [r for f in sorted((tmp_path / "kept").glob("*.csv")) for r in csv.reader(f.open(encoding="utf-8"))]
    assert [r[1] for r in kept] == ["high", "low"] and kept[0][5] == 'say "x"' and kept[1][8] == "no sentences :("


def test_output_paths(tmp_path):
    assert sinks.resolve_output(str(tmp_path), None) == tmp_path / f"{tmp_path.name}.csv"
    assert sinks.resolve_output(str(tmp_path), str(tmp_path / "new")) == tmp_path / "new" / f"{tmp_path.name}.csv"
    assert sinks.resolve_output(str(tmp_path), str(tmp_path / "p/q.csv")) == tmp_path / "p/q.csv"


def test_change_set(spark):
    kind = "map<string,string>"
    notes = spark.createDataFrame([(1, "猫", ["old"], {"Meaning": "old definition"}), (2, "古い", [], {})], f"note_id long, expression string, tags array<string>, fields {kind}")
    desired = spark.createDataFrame([("猫", ["new"], {"Meaning": "cat"}), ("犬", ["new"], {"Meaning": "dog"})], f"expression string, tags array<string>, fields {kind}")
    changes = sync.change_set(desired, notes).cache()
    assert sorted((r.op, r.note_id) for r in changes.select("op", "note_id").collect() if r.note_id) == [("addTags", 1), ("delete", 2), ("removeTags", 1), ("updateFields", 1)]
    assert tuple(sync.summary(changes).first()) == (1, 1, 1)
    sent = []

    def send(body):
        sent.append(json.loads(body))
        return json.dumps({"result": [], "error": None}).encode()

    assert sinks.NoteStore(send=send).apply(changes, "d", "m") == (1, 1, 1)
    assert [s["action"] for s in sent] == ["deleteNotes", "multi", "addNotes"]
    with pytest.raises(sinks.NoteStoreError):
        sinks.NoteStore(send=lambda b: b'{"error": "no", "result": null}').call("x")


def test_note_fields(spark):
    got = sync.note_fields(words_table(spark).withColumn("index", F.lit(0.0005))).where("expression = 'low'").first()
    assert got.fields["Index"] == "0.0005" and got.fields["Score"] == "10.0" and got.fields["Sentence"] == ""


def test_user_dictionary(spark):
    lines = spark.createDataFrame([("猫が、犬",), (None,)], "text string")
    assert [r.candidate for r in userdict.candidate_ngrams(lines).collect()] == ["猫が"]
    long_run = spark.createDataFrame([("あ" * 25,)], "text string")
    assert userdict.candidate_ngrams(long_run).count() == 19
    costs = spark.createDataFrame([("ひらが", True), ("漢字四字", False), ("ひら", True)], "w string, e boolean").select(userdict.cost(F.col("w"), F.col("e")).alias("c"))
    assert [r.c for r in costs.collect()] == [1000, 7000, 1000]
    entries = spark.createDataFrame(
        [(0, [("猫が", [])], [("ねこが", [])], [(["x"], ["noun (common) (futsuumeishi)", "Suru verb"], [], [], [])])],
        "entry_ord long, kanji array<struct<form:string,pri:array<string>>>, reading array<struct<form:string,pri:array<string>>>, senses array<struct<gloss:array<string>,pos:array<string>,misc:array<string>,field:array<string>,dialect:array<string>>>",
    )
    row = userdict.build(spark.createDataFrame([("猫が",), ("犬",)], "candidate string"), entries).collect()
    assert len(row) == 1 and row[0].c5 == "動詞" and row[0].c3 == 3500 and row[0].c11 == "ねこが" and row[0].c14 == "C"


def brute_grams(texts):
    runs = {r for t in texts for r in re.findall("[a-zA-ZÀ-ÖØ-öø-ÿ]+", t or "")}
    return {r[i : i + k] for r in runs for i in range(len(r)) for k in range(2, 21) if i + k <= len(r)}


def test_latin_candidates(spark, sf, tmp_path):
    """Every letter counts, in its case, also where no accented one stands beside another."""
    texts = [None, "", "Ab a ABC-ab\nÀé×ùs fÿ÷ß", "x" * 23, "Plain english words, plain English words"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.candidate for r in queries()["ngram_candidates_latin"](spark, str(tmp_path)).collect()]
    assert set(got) == brute_grams(texts) and len(got) == len(set(got)) and {"AB", "ab", "ng", "Àé"} <= set(got)
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [r.candidate for r in queries()["ngram_candidates_latin"](spark, sf).collect()]
    assert set(got) == brute_grams(docs) and len(got) == len(set(got))


def test_pipeline_skips_none(spark):
    seen = []
    run = Pipeline([None, lambda d: d.where("id > 1"), lambda d: d.limit(3)], seen.append, count=True)
    assert run.run(spark.range(10)).count() == 3 and [p.rows for p in seen] == [8, 3]


def test_counters(spark):
    df, watch = observed(spark.range(5), largest=F.max("id"))
    assert df.where("id > 1").count() == 3 and watch.get == {"rows": 5, "largest": 4}


def test_mine_end_to_end(spark, sf):
    docs = files.from_documents(spark.read.parquet(f"{sf}/documents.parquet").limit(20))
    got = mine(docs, None, Config(LATIN, RegexTokenizer(), 2))
    rows = got.words.where("size(sentences) > 0").collect()
    assert rows and all(len(r.sentences) <= 3 for r in rows)


def test_mined_rows(spark, tmp_path):
    """The registered queries over the whole plan carry sentences of the texts."""
    said = [f"The copper {w} lies beside another lantern today." for w in ("kettle", "button", "needle", "basket", "hammer")]
    docs = [(1, " ".join(said[:3]), "a"), (2, " ".join(said[3:]), "b"), (3, None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "copper metal word here"), (1, "few words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = {r.word: r for r in queries()["mined_words"](spark, str(tmp_path)).collect()}
    rows = queries()["mined_sentences"](spark, str(tmp_path)).collect()
    assert {w for w, r in words.items() if r.status == "kept"} == {"copper"} and words["lantern"].status == "dropped"
    for word, r in words.items():
        own = sorted((x.pos, x.sentence) for x in rows if x.word == word)
        assert [p for p, _ in own] == [0, 1, 2] and len({t for _, t in own}) == 3 and r.n_sentences == "sentences: 3"
        assert all(t in said and word in t for _, t in own) and r.html.count("highlight") >= 3
    assert {x.status for x in rows} == {"kept", "dropped"} and all(x.surface_form == x.word and x.tag == ("a" if x.sentence in said[:3] else "b") for x in rows)


def test_mine_counts_and_reads(spark, tmp_path):
    """Counters of every step, readings from the dictionary, and the same words with and without a cache."""
    docs = spark.createDataFrame([(1, "x", "A copper kettle stands here. The copper lamp is over there now."), (2, "y", None), (3, "y", "Copper again, and nothing else at all today.")], "file_id long, tag string, text string")
    entries = spark.createDataFrame([(0, [("copper", [])], [("KOPA", [])], [(["metal"], [], [], [], [])])], "entry_ord long, kanji array<struct<form:string,pri:array<string>>>, reading array<struct<form:string,pri:array<string>>>, senses array<struct<gloss:array<string>,pos:array<string>,misc:array<string>,field:array<string>,dialect:array<string>>>")
    config = Config(LATIN, RegexTokenizer(), 1)
    plain = mine(docs, entries, config)
    rows = {r.lemma: r for r in plain.words.collect()}
    assert rows["copper"].reading == "KOPA" and rows["copper"].definition == "metal" and rows["copper"].frequency == 3 and rows["kettle"].reading == "kettle"
    tokens = plain.useful.selectExpr("sum(size(useful)) n").first().n
    assert plain.counters == {"files": 2, "sentences": plain.sentences.count(), "useful_tokens": tokens, "segments": plain.segments.count(), "lemmas": len(rows), "kept": 1, "dropped": len(rows) - 1}
    cache = token_cache.TokenCache(spark, str(tmp_path / "cache"), "t")
    first, second = (mine(docs, entries, config, cache) for _ in range(2))
    assert first.cached == token_cache.Run(0, 0, 2, 3, 20) and second.cached == token_cache.Run(0, 2, 0)
    for got in (first, second):
        assert {r.lemma: r for r in got.words.collect()} == rows


def test_readings_of_lemmas(spark):
    """Lemmas are analysed once each; tokens take their lemma's reading, and lose their place with an empty one."""
    sentences = spark.createDataFrame([(1, "t", 0, "copper lamp copper"), (1, "t", 1, "lamp night")], "file_id long, tag string, sent_ord int, text string")
    lists = RegexTokenizer().lists(sentences)
    lemmas = tokenizers.exploded(lists)
    own = tokenizers.lemma_readings(lemmas, RegexTokenizer())
    assert sorted(map(tuple, own.collect())) == [("copper", "copper"), ("lamp", "lamp"), ("night", "night")]
    given = spark.createDataFrame([("copper", "カパ"), ("lamp", ""), ("lamp", ""), (None, "x"), ("night", None)], "lemma string, reading string")
    got = tokenizers.exploded(tokenizers.lists_with_readings(lists, given)).orderBy("sent_ord", "tok_ord").collect()
    assert [r.reading for r in got] == ["かぱ", "", "かぱ", "", "night"]
    useful, _ = mining.useful_rows(spark.createDataFrame([(1, "t", [(0, "copper lamp copper"), (1, "lamp night")])], "file_id long, tag string, sentences array<struct<sent_ord:int,text:string>>"), Config(LATIN, RegexTokenizer(), readings=given))
    assert sorted((r.lemma, r.pos_no, r.n_file) for r in lexicon.numbered_tokens(useful).collect()) == [("copper", 1, 3), ("copper", 2, 3), ("night", 3, 3)]


def test_cli(spark, tmp_path, caplog):
    """The second run over the same files tokenises nothing and writes the same words."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the quick brown fox runs over the green hill today. " * 6)
    (tmp_path / "in" / "b.txt").write_text("another quick animal sleeps under the old bridge. " * 3)
    words, runs = [], []
    for name in ("o.csv", "p.csv"):
        caplog.clear()
        with caplog.at_level("INFO"):
            cli.main(["-i", str(tmp_path / "in"), "-o", str(tmp_path / name), "-f", "2", "--tokenizer", "latin", "--cache", str(tmp_path / "cache")])
        words.append(list(csv.reader((tmp_path / name).open())))
        runs.append([r.args[0] for r in caplog.records if isinstance(r.args, tuple) and r.args and isinstance(r.args[0], token_cache.Run)])
        assert any(isinstance(r.args, dict) and r.args["files"] == 2 for r in caplog.records)
    assert any(r[1] == "quick" for r in words[0]) and words[0] == words[1]
    assert [(r.by_time, r.by_content, r.fresh) for x in runs for r in x] == [(0, 0, 2), (2, 0, 0)] and runs[0][0].tokens == 84 and runs[1][0].tokens == 0


def test_streaming(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(10).write.parquet(str(tmp_path / "in"))
    query = ingest.start(ingest.running_counts(ingest.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
