"""Queries over the driver's tables, one per operator, each with its SQL in plans.oracle.

Documents are the corpus (LATIN profile, tag = source), benchmark items make a dictionary and
an existing note store, conversations a dialogue corpus. Japanese rules run on the same tables in
Japanese script (plans.japanese).
Doubles are rounded so that both engines hash alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.functions import scoring as S
from lexiforge.functions import text as T
from lexiforge.functions.normalize import normalise_column
from lexiforge.functions.profiles import JA, LATIN, LATIN_LETTERS
from lexiforge.operators import dictionary, examples, layout, lexicon, lexicon_state, ranking, sync, token_cache, userdict
from lexiforge.operators.staging import new_folder, staged
from lexiforge.operators.tokenizers import JAPANESE_RUNS, RegexTokenizer
from lexiforge.plans import japanese, mining
from lexiforge.sources import files, sinks
from lexiforge.sources.dictionary_xml import read_dictionary, write_dictionary

FINGERPRINT = "regex-v1"
WORD = "[a-zà-öø-ÿ]+"
PROFILE_MIN = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_documents(files.spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"))


def dealt_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_documents(files.dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"))


def plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, tag, tok_ord, word: letters of the lower-cased text."""
    found = F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("tok_ord", "word")
    return corpus(spark, sf_dir).select("file_id", "tag", found)


def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = plain_words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"), F.count_distinct("tag").alias("n_sources"))
    return words


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: corpus words over the frequency threshold with their scaled scores."""
    return ranking.ranked_words(_lexicon(spark, sf_dir)).select(F.col("lemma").alias("word"), "frequency", F.size("tags").alias("n_tags"), F.round("index", 6).alias("mean_index"), F.round("score", 1).alias("score"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("﻿{"), F.col("text"), F.lit("​>‒\u0007⋯"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(marked).alias("cleaned"))


def _pieces(spark: SparkSession, sf_dir: str, name: str, column) -> DataFrame:
    return corpus(spark, sf_dir).select("file_id", F.posexplode(column).alias("ord", name))


def line_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "line", T.full_lines(F.col("text")))


def paragraph_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "piece", F.flatten(F.transform(T.paragraphs(F.col("text")), T.split_after_terminator)))


def punct_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, "piece", T.split_on_punctuation(F.col("text")))


def japanese_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(F.col("file_id").alias("id"), japanese.text(F.col("file_id"), F.col("text")).alias("text"))


def japanese_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return japanese.words(corpus(spark, sf_dir), WORD)


def split_pieces(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.posexplode(T.split_on_punctuation(F.col("text"))).alias("ord", "piece"))


def punct_split_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pieces(japanese_corpus(spark, sf_dir))


def folded(rows: DataFrame) -> DataFrame:
    return rows.select("id", T.kana_fold(F.col("text")).alias("folded"))


def kana_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(japanese_corpus(spark, sf_dir))


def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/corpus/["), F.col("source"), F.lit("]/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise("[x].srt"))
    bare = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace(path, r"[\[\]]", "")).otherwise(path)
    return table(spark, sf_dir, "documents").select("doc_id", T.source_tag(bare).alias("tag"))


def sentence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extract_sentences(corpus(spark, sf_dir)).select("file_id", "sent_ord", F.round(T.quality_penalty(F.col("text"), LATIN), 6).alias("penalty"), F.length("text").alias("n_chars"))


def quality_ja(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    return rows.select(*(c for c in rows.columns if c != "text"), F.round(T.quality_penalty(text, JA), 6).alias("penalty"), T.is_valid_sentence(text, JA).alias("valid"), T.keep_normalised(text, JA).alias("keep"), T.dedupe_key(text).alias("key"))


def sentence_quality_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every sentence in Japanese script, with speakers, guides, gaps and cuts by its place."""
    pieces = punct_split_ja(spark, sf_dir)
    return quality_ja(pieces.select("id", "ord", japanese.marked(F.col("id"), F.col("ord"), F.col("piece")).alias("text")))


def layout_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three layouts: as they are, a word run per line, and indented."""
    return _laid_out(spark, sf_dir).select("doc_id", layout.layout_mode(F.col("text")).alias("mode"))


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document with a line per sentence, every third with its lines indented by turns."""
    spaced = F.regexp_replace("text", r"[.] ", ".\n")
    lines = F.filter(F.split(spaced, "\n", -1), lambda x: x != "")
    indented = F.array_join(F.transform(lines, lambda x, i: F.concat(F.repeat(F.lit(" "), (i % 3).cast("int")), x)), "\n")
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, spaced).otherwise(indented)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def indent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = _laid_out(spark, sf_dir)
    return laid.select("doc_id", F.posexplode(layout.join_indented(T.lines(F.col("text")))).alias("ord", "sentence"))


def dialogue_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = files.from_conversations(table(spark, sf_dir, "conversations"))
    return talks.select(F.col("file_id").alias("conv_id"), layout.layout_mode(F.col("text")).alias("mode"), F.size(T.full_lines(F.col("text"))).alias("n_lines"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw markup as text: every extension is read verbatim."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(T.full_lines(T.clean(F.col("html")))).alias("n_lines"), F.length(T.clean(F.col("html"))).alias("n_chars"))


def extract_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extract_sentences(corpus(spark, sf_dir)).select("file_id", "sent_ord", "text")


def normalise_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.extract_sentences(corpus(spark, sf_dir)).withColumn("text", normalise_column(F.col("text")))
    return out.where(T.keep_normalised(F.col("text"), LATIN)).select("file_id", "sent_ord", "text")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extract_sentences(corpus(spark, sf_dir))


def valid_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.segments(_sentences(spark, sf_dir), LATIN).select("file_id", "sent_ord", "tag")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.counted_sentences(layout.sentence_lists(corpus(spark, sf_dir)), RegexTokenizer(), LATIN)


def _useful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.file_tokens(layout.sentence_lists(corpus(spark, sf_dir)), RegexTokenizer(), LATIN)


def useful_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _useful(spark, sf_dir)
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_useful"), F.sum("pos_no").alias("pos_sum"), F.count_distinct("lemma").alias("n_lemmas"))


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged: thresholds and maxima read it again."""
    return staged(lexicon.lexicon(_useful(spark, sf_dir), RegexTokenizer.pos), "lexicon")


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas with their frequency, staged."""
    return staged(lexicon.frequencies(_useful(spark, sf_dir)), "frequencies")


def build_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexicon.lexicon(_useful(spark, sf_dir), RegexTokenizer.pos)
    return words.select("lemma", "frequency", "index_count", F.round("index", 6).alias("mean_index"), "reading", F.col("first_seen.file_id").alias("first_file"), F.col("first_seen.sent_ord").alias("first_sent"))


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.tag_sets(_useful(spark, sf_dir)).select("lemma", F.array_join("tags", " ").alias("tags"))


def token_position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.file_positions(_useful(spark, sf_dir)).select("file_id", "lemma", "frequency", F.round("place", 9).alias("place"))


def sentence_lemma_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = lexicon.useful_lists(_counted(spark, sf_dir), RegexTokenizer(), LATIN)
    maps = lexicon.lemma_surfaces(lexicon.segment_lists(lists, LATIN))
    shown = F.transform(F.map_entries("lemma_surfaces"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("file_id", "sent_ord", F.array_join(shown, " ").alias("lemma_surfaces"))


def frequency_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _frequencies(spark, sf_dir).select("frequency")
    parts = [ranking.frequency_threshold(words, low, keep).select(F.lit(keep).alias("keep_percent"), "threshold") for low, keep in ((4, 98), (1, 50), (1, 10))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def filter_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.filter_frequency(_frequencies(spark, sf_dir), 1, 10).select("lemma", "frequency")


def tag_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.tag_sets(_useful(spark, sf_dir)).select("lemma", F.round(S.tag_diversity(F.size("tags")), 6).alias("factor"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_words(_lexicon(spark, sf_dir), PROFILE_MIN, 98)


def priority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = japanese.picked(F.col("item_id"), japanese.PRIORITY_MARKS)
    return table(spark, sf_dir, "benchmark").select("item_id", S.priority_score(marks).alias("points"))


def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the text length at the nearest rank of 90 %, from a histogram of lengths
    (one row per distinct length), so no source's documents meet in a task."""
    docs = table(spark, sf_dir, "documents")
    lengths = docs.groupBy("source", F.length("text").cast("double").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("source")
    upto = lengths.select("source", "len", F.sum("n").over(own.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(own).alias("all"))
    at = F.least(F.expr("`all` * 9 div 10"), F.col("all") - 1)
    return upto.where(F.col("upto") > at).groupBy("source").agg(F.min("len").alias("p90"))


def entries(spark: SparkSession, sf_dir: str, words: Column | None = None) -> DataFrame:
    """A dictionary from benchmark items: each item's first four words, the third and fourth as
    readings; priority marks by its number; its first word as gloss of one to three senses."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)) if words is None else words
    none = F.array().cast("array<string>")
    i = F.col("item_id")
    mark = F.array(F.concat(F.lit("nf"), F.lpad((i % 48 + 1).cast("string"), 2, "0")), F.when(i % 2 == 0, "ichi1").otherwise("news2"))
    element = lambda w, pri: F.struct(w.alias("form"), pri.alias("pri"))
    sense = lambda k: F.struct(F.when(k % 2 == 0, F.array(F.concat(F.get("w", 0), k.cast("string")), F.get("w", 1))).otherwise(none).alias("gloss"), none.alias("pos"), none.alias("misc"), none.alias("field"), none.alias("dialect"))
    items = table(spark, sf_dir, "benchmark").withColumn("w", words).where("size(w) >= 4")
    return items.select(
        i.cast("long").alias("entry_ord"),
        F.array(element(F.get("w", 0), mark), element(F.get("w", 1), none)).alias("kanji"),
        F.array(element(F.get("w", 2), F.slice(mark, 2, 1)), element(F.get("w", 3), none)).alias("reading"),
        F.transform(F.sequence(F.lit(0), (i % 3).cast("int")), sense).alias("senses"),
    )


#: Entities of the dictionary that ``dictionary_scan`` writes.
ENTITIES = {"n": "noun (common) (futsuumeishi)", "v1": "Ichidan verb", "uk": "word usually written using kana alone"}


def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries, with a part of speech and a mark as entities and a gloss to escape, written as
    dictionary XML in several files and read back by record."""
    k = F.col("entry_ord")
    pos = F.when(k % 2 == 0, F.array(F.lit(ENTITIES["n"]), F.lit(ENTITIES["v1"]))).otherwise(F.array(F.lit("a & b <c>")))
    misc = F.when(k % 5 == 0, F.array(F.lit(ENTITIES["uk"]))).otherwise(F.array().cast("array<string>"))
    marked = F.transform("senses", lambda s: s.withField("pos", pos).withField("misc", misc))
    folder = new_folder(spark, "dictionary-xml")
    write_dictionary(entries(spark, sf_dir).withColumn("senses", marked), folder, ENTITIES, 50)
    joined = lambda values: F.array_join(values, "|")
    element = lambda e: F.concat(e["form"], F.lit(":"), joined(e["pri"]))
    sense = lambda s: F.concat(joined(s["gloss"]), F.lit("/"), joined(s["pos"]), F.lit("/"), joined(s["misc"]))
    return read_dictionary(spark, folder).select("entry_ord", joined(F.transform("kanji", element)).alias("kanji"), joined(F.transform("reading", element)).alias("reading"), joined(F.transform("senses", sense)).alias("senses"), joined(dictionary.all_pos(F.col("senses"))).alias("pos"))


def dictionary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.inverted_index(entries(spark, sf_dir)).groupBy("form").agg(F.count(F.lit(1)).alias("n_entries"))


def dictionary_best_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.definitions(entries(spark, sf_dir))


def dictionary_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of a form's highest priority and most senses, where marks and senses are fewer than words."""
    flat = entries(spark, sf_dir).select("entry_ord", *(F.transform(c, lambda e: e.withField("pri", F.array().cast("array<string>"))).alias(c) for c in ("kanji", "reading")), F.slice("senses", 1, 2).alias("senses"))
    return dictionary.ranked_entries(flat, "all").select("form", "entry_ord", "n_senses")


def _defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.add_definitions(_words(spark, sf_dir), entries(spark, sf_dir))


def definitions_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defined(spark, sf_dir).select("lemma", "definition", "invalid", F.round("score", 1).alias("score"))


def invalid_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.invalid_words(_defined(spark, sf_dir))


def _coarse(words: DataFrame) -> DataFrame:
    """Scores of one decimal: the same in both engines whatever the order of their sums."""
    return words.withColumn("score", F.round("score", 1))


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored words, staged; valid sentences with their lemmas; and without these. Sentences are made from the documents
    wherever they are read: nothing of their size is staged, and texts are all that moves."""
    lists = layout.sentence_lists(dealt_corpus(spark, sf_dir))
    words = staged(lexicon.lexicon(lexicon.file_tokens(lists, RegexTokenizer(), LATIN), RegexTokenizer.pos), "lexicon")
    scored = staged(_coarse(ranking.ranked_words(words, PROFILE_MIN, 98)), "words")
    marked = files.from_documents(table(spark, sf_dir, "documents").where(F.contains("text", F.lit(">"))))
    odd = examples.odd_keys(lexicon.segments(layout.extract_sentences(marked), LATIN))
    of_segments = examples.featured(lexicon.segment_lists(lexicon.sentence_tokens(lists, RegexTokenizer(), LATIN), LATIN), LATIN)
    texts = lexicon.segments(layout.inlined(lists, F.col("sentences"), "file_id", "tag", "deal"), LATIN)
    return scored, examples.with_variants(of_segments, odd), texts


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, of_segments, _ = _prepared(spark, sf_dir)
    stats = examples.sentence_statistics(of_segments, words, unknown=True)
    return stats.select("file_id", "sent_ord", "lemma", "score", "n_known", "n_total", "too_hard", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def _examples(of_segments: DataFrame, words: DataFrame) -> DataFrame:
    return examples.candidates(examples.sentence_statistics(of_segments, words), examples.highest_score(words), 6)


def attach_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, of_segments, texts = _prepared(spark, sf_dir)
    best = examples.with_texts(examples.best_examples(_examples(of_segments, words)), texts)
    return best.select("lemma", "pos", "text", "tag", "surface_form", F.round("score", 1).alias("score"))


def attach_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback where only one example per word is attached at first."""
    words, of_segments, texts = _prepared(spark, sf_dir)
    primary = staged(examples.best_examples(_examples(of_segments, words), 1), "primary")
    more = examples.with_texts(examples.fallback_examples(of_segments, words, primary), texts)
    return more.select("lemma", "pos", "text", "surface_form", "score")


def _finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined words with their attached sentences; scores of one decimal."""
    words, of_segments, texts = _prepared(spark, sf_dir)
    words = dictionary.add_definitions(words, entries(spark, sf_dir))
    done = examples.attach_examples(staged(words, "defined"), of_segments, places=6, texts=texts)
    return done.withColumn("sentences", F.transform("sentences", lambda s: s.withField("score", F.round(s["score"], 1))))


def kept_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.word_rows(_finished(spark, sf_dir)).where("not invalid")
    return rows.select("word", "score", "reading", "index", "frequency", "definition", "tags", "n_sentences", "html")


def dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.word_rows(_finished(spark, sf_dir)).where("invalid")
    return rows.select("word", "score", "reading", "index", "frequency", "tags", "n_sentences", "html")


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sentence_rows(_finished(spark, sf_dir)).select("status", "word", "score", "sentence", "tag", "surface_form", "pos")


def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = mining.Config(LATIN, RegexTokenizer(), PROFILE_MIN, 98, score_places=1, places=6)
    words = mining.mine(corpus(spark, sf_dir), entries(spark, sf_dir), config).words
    return words.withColumn("sentences", F.transform("sentences", lambda s: s.withField("score", F.round(s["score"], 1))))


def mined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mining plan: kept and dropped words as the word files have them, with the
    attached sentences. Unlike kept_rows and dropped_rows, with normalised sentences and readings of the dictionary."""
    status = F.when(F.col("invalid"), "dropped").otherwise("kept")
    return sinks.word_rows(_mined(spark, sf_dir)).select(status.alias("status"), "word", "score", "reading", "index", "frequency", "definition", "tags", "n_sentences", "html")


def mined_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that the whole mining plan attaches, a row each, by their place (pos)."""
    return sinks.sentence_rows(_mined(spark, sf_dir)).select(*sinks.SENTENCE_HEADER, "pos")


def _mined_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default plan (Japanese profile and runs) over the documents in Japanese script, with the benchmark items in
    it as dictionary."""
    files = corpus(spark, sf_dir).withColumn("text", japanese.text(F.col("file_id"), F.col("text")))
    words = F.regexp_extract_all(F.translate("text", japanese.LETTERS, japanese.TEXTS[2]), F.lit(JAPANESE_RUNS.pattern), F.lit(0))
    done = mining.mine(files, entries(spark, sf_dir, words), mining.Config(min_frequency=PROFILE_MIN, score_places=1, places=6)).words
    return done.withColumn("sentences", F.transform("sentences", lambda s: s.withField("score", F.round(s["score"], 1))))


def mined_words_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("invalid"), "dropped").otherwise("kept")
    return sinks.word_rows(_mined_ja(spark, sf_dir)).select(status.alias("status"), "word", "score", "reading", "index", "frequency", "definition", "tags", "n_sentences", "html")


def mined_sentences_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sentence_rows(_mined_ja(spark, sf_dir)).select(*sinks.SENTENCE_HEADER, "pos")


def highlight_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    word = F.regexp_extract(F.col("text"), "[A-Za-z]{4,}", 0)
    return docs.select("doc_id", T.highlight(F.col("text"), word, F.col("source"), F.lit(1.5)).alias("html"))


def _desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with letters and frequency as a note's fields."""
    words = word_frequency(spark, sf_dir).where("frequency >= 4")
    fields = F.create_map(F.lit("Expression"), F.col("word"), F.lit("Frequency"), F.col("frequency").cast("string"), F.lit("Reading"), F.col("word"))
    tags = F.array(F.lit("new"), F.concat(F.lit("s"), F.col("n_sources").cast("string")))
    return words.select(F.col("word").alias("expression"), tags.alias("tags"), fields.alias("fields"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words as existing notes; of equal ones the last counts."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words).alias("i", "w"))
    fields = F.create_map(F.lit("Expression"), F.col("w"), F.lit("Frequency"), (F.col("item_id") % 7).cast("string"), F.lit("Reading"), F.col("w"))
    return each.select((F.col("item_id") * 100000 + F.col("i")).alias("note_id"), F.col("w").alias("expression"), F.array(F.lit("old"), F.lit("s20")).alias("tags"), fields.alias("fields"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.change_set(_desired(spark, sf_dir), _notes(spark, sf_dir))


def sync_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("op", "note_id", "expression", F.array_join(F.array_sort("tags"), " ").alias("tags"), F.try_element_at("fields", F.lit("Frequency")).alias("frequency"))


def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.summary(_changes(spark, sf_dir))


def sync_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.batches(_changes(spark, sf_dir)).groupBy("op", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("expression").alias("first_expression"))


def note_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From mined words, with definitions and attached sentences, through their note fields to the
    change-set. The notes that exist are of an earlier state of the same words (some as they are, some with another
    meaning, some with another sentence and tag, some missing) and of benchmark words that aren't mined."""
    words = _finished(spark, sf_dir).withColumn("index", F.round("index", 4))
    desired = staged(sync.note_fields(words), "desired-notes")
    kind = F.col("fields")["Frequency"].cast("long") % 4
    number = F.conv(F.substring(F.md5("expression"), 1, 8), 16, 10).cast("long")
    field = lambda name, value: F.map_concat(F.map_filter("fields", lambda k, v: k != name), F.create_map(F.lit(name), value))
    fields = F.when(kind == 1, field("Meaning", F.lit("old meaning"))).when(kind == 2, field("Sentence", F.concat(F.col("fields")["Sentence"], F.lit("!")))).otherwise(F.col("fields"))
    tags = F.when(kind == 2, F.concat(F.array(F.lit("extra")), F.slice("tags", 2, 100))).otherwise(F.col("tags"))
    mined = desired.where(kind != 3).select(number.alias("note_id"), "expression", tags.alias("tags"), fields.alias("fields"))
    others = _notes(spark, sf_dir).join(desired.select("expression"), "expression", "left_anti").select(*mined.columns)
    changes = sync.change_set(desired, mined.unionByName(others))
    shown = [F.try_element_at("fields", F.lit(f)).alias(f.lower()) for f in ("Reading", "Meaning", "Index", "Frequency", "Score")]
    return changes.select("op", "note_id", "expression", F.array_join(F.array_sort("tags"), " ").alias("tags"), *shown, F.md5(F.try_element_at("fields", F.lit("Sentence"))).alias("sentence_md5"))


ACCENTED = "à-öø-ÿ"


def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return userdict.candidate_ngrams(corpus(spark, sf_dir).select("text"), members=ACCENTED)


def ngram_candidates_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all Latin letters of the whole texts, in the case they stand in; ngram_candidates is
    of the accented lower-case ones only. Brute force: see tests.test_outputs."""
    return userdict.candidate_ngrams(corpus(spark, sf_dir).select("text"), members=LATIN_LETTERS)


def ngram_candidates_ja(spark: SparkSession, sf_dir: str) -> DataFrame:
    return userdict.candidate_ngrams(japanese_corpus(spark, sf_dir))


def user_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-dictionary rows of the dictionary's forms that stand in the documents and are more than one
    token to a tokeniser of six letters. Parts of speech by the entry's number; every fourth entry has none that is known."""
    k = F.col("entry_ord")
    pos = F.when(k % 4 == 3, F.array(F.lit("something else"))).when(k % 3 == 0, F.array(F.lit(ENTITIES["n"]))).when(k % 3 == 1, F.array(F.lit(ENTITIES["n"]), F.lit(ENTITIES["v1"]))).otherwise(F.array(F.lit("expressions (phrases, clauses, etc.)")))
    known = entries(spark, sf_dir).withColumn("senses", F.transform("senses", lambda s: s.withField("pos", pos)))
    rows = userdict.user_dictionary(corpus(spark, sf_dir), known, RegexTokenizer(f"[{LATIN_LETTERS}]{{1,6}}"), LATIN_LETTERS)
    return rows.select(F.col("c0").alias("word"), F.col("c3").alias("cost"), F.col("c5").alias("p0"), F.col("c6").alias("p1"), F.col("c11").alias("reading"))


def pos_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lists of parts of speech that benchmark items pick by their number."""
    return resolved_pos(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), japanese.picked(F.col("item_id"), japanese.POS_NAMES).alias("pos")))


def resolved_pos(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.array_join(userdict.resolve_pos(F.col("pos")), ",").alias("resolved"), userdict.only_nouns(F.col("pos")).alias("nouns"), userdict.only_verbs_or_nouns(F.col("pos")).alias("verbs_or_nouns"), userdict.is_expression(F.col("pos")).alias("expression"))


def userdict_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs(japanese_words(spark, sf_dir).select(F.col("latin").alias("id"), F.col("word").alias("text")))


def costs(rows: DataFrame) -> DataFrame:
    words = rows.withColumn("e", F.explode(F.array(F.lit(True), F.lit(False))))
    return words.select("id", "e", userdict.cost(F.col("text"), F.col("e")).alias("cost"), userdict.is_all_hiragana(F.col("text")).alias("hiragana"))


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_sentences(spark, sf_dir).select("file_id", F.col("ord").alias("sent_ord"), F.col("line").alias("text"))
    return token_cache.content_keys(lines, FINGERPRINT)


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where labelled documents were tokenised before, the contents that are left."""
    keys = content_keys(spark, sf_dir)
    seen = keys.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi")
    return token_cache.misses(keys, seen.select("content_key").distinct()).select("file_id", "content_key")


def token_cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one cache: the labelled documents, then all of them. Per document the tokens that the
    cache holds at last, and whether the second run had to tokenise it."""
    lists = staged(layout.sentence_lists(corpus(spark, sf_dir)), "cache-lists")
    tokenizer = RegexTokenizer()
    cache = token_cache.TokenCache(spark, new_folder(spark, "token-cache"), tokenizer.fingerprint)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id")).distinct()
    cache.add(lists.join(labelled, "file_id", "left_semi"), tokenizer)
    keys, _ = cache.add(lists, tokenizer)
    sizes = cache.lists(lists, keys, F.size("tokens").alias("n")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n").alias("n_tokens"))
    return keys.join(sizes, "file_id", "left").select("file_id", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "fresh")


def lexicon_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of the documents, reached from an earlier state of the corpus: then every third document
    wasn't there yet, every seventh had another text, and the benchmark items were files as well."""
    after = corpus(spark, sf_dir)
    other = F.when(F.col("file_id") % 7 == 2, F.concat(F.lit("Early draft. "), F.upper("text"))).otherwise(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("file_id"), F.lit("bench").alias("tag"), "text").where("text is not null")
    docs = files.from_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    before = files.spread(docs.where("file_id % 3 <> 1").withColumn("text", other).unionByName(items), "file_id")  # once, as one table
    parts = lambda corpus: lexicon_state.partials(lexicon.file_tokens(layout.sentence_lists(corpus), RegexTokenizer(), LATIN))
    old = staged(parts(before), "partials-before")
    state = staged(lexicon_state.state_of(old), "lexicon-before")
    change = lexicon_state.changed_files(before, after)
    new = staged(parts(after.join(change.new, "file_id", "left_semi")), "partials-new")
    current = old.join(change.gone, "file_id", "left_anti").unionByName(new)
    words = lexicon_state.lexicon_of(lexicon_state.updated(state, old.join(change.gone, "file_id", "left_semi"), new, current))
    return words.select("lemma", "frequency", "index_count", F.round("index", 6).alias("mean_index"), F.array_join("tags", " ").alias("tags"), F.col("first_seen.file_id").alias("first_file"), F.col("first_seen.sent_ord").alias("first_sent"))


def useless_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = japanese_words(spark, sf_dir)
    return useless(words.select(F.col("latin").alias("id"), F.col("word").alias("lemma"), japanese.pos_pair(F.col("latin")).alias("pos")))


def useless(rows: DataFrame) -> DataFrame:
    return rows.select("id", lexicon.is_useless(F.col("lemma"), F.col("pos"), JA).alias("useless"))


NAMES = (
    "word_frequency", "word_scores", "clean_text", "line_sentences", "paragraph_sentences", "punct_split", "punct_split_ja", "kana_fold",
    "source_tags", "sentence_quality", "sentence_quality_ja", "layout_mode", "indent_join", "dialogue_mode", "page_lines", "extract_sentences",
    "normalise_sentences", "valid_sentences", "useful_tokens", "build_lexicon", "tag_sets", "token_position_index", "sentence_lemma_map",
    "frequency_threshold", "filter_frequency", "tag_diversity", "priority_scores", "nearest_rank", "dictionary_scan", "dictionary_index", "dictionary_best_entry", "dictionary_ties",
    "definitions_join", "invalid_words", "sentence_stats", "attach_examples", "attach_fallback", "kept_rows", "dropped_rows", "sentence_rows",
    "mined_words", "mined_sentences", "mined_words_ja", "mined_sentences_ja", "highlight_html", "sync_changes", "note_changes", "sync_summary", "sync_batches", "ngram_candidates", "ngram_candidates_latin", "ngram_candidates_ja", "user_dictionary",
    "pos_resolution", "userdict_cost", "content_keys", "cache_misses", "token_cache_runs", "lexicon_update", "useless_lemmas",
)


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
