"""Document layout: which kind of text a file is, and its sentences.

A document's lines are classified by array expressions, one row per document, so nothing is
shuffled: sentences come from one explode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as T

# Limits of the classifiers.
INDENT_LINES, INDENT_RISE = 4, 0.25
DIALOGUE_LINES, DIALOGUE_MEAN, DIALOGUE_SHORT, DIALOGUE_SHARE, DIALOGUE_CLOSED = 5, 45, 40, 0.7, 0.4
LIST_LINES, LIST_MEAN, LIST_SHORT, LIST_SHARE = 3, 50, 40, 0.8

INDENTED, DIALOGUE, LIST, PARAGRAPH = "indented_continuation", "line_dialogue", "sentence_list", "paragraph"


def _mean(values: Column) -> Column:
    n = F.size(values)
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x) / F.when(n > 0, n)


def _share(values: Column, test) -> Column:
    n = F.size(values)
    return F.size(F.filter(values, test)) / F.when(n > 0, n)


def _not_blank(raw: Column) -> Column:
    return F.filter(raw, lambda x: T.strip(x) != "")


def _before(values: Column) -> Column:
    """Each element but the last; zipped with the array from its second element on, it is the one before."""
    return F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))


def is_indented(raw: Column) -> Column:
    """At least four full lines, of two indents or more, a quarter of the steps going inwards."""

    def judge(width: Column) -> Column:
        n = F.size(width)
        rises = F.size(F.filter(F.zip_with(_before(width), F.slice(width, 2, n), lambda a, b: b > a), lambda x: x))
        return (n >= INDENT_LINES) & (F.size(F.array_distinct(width)) >= 2) & F.coalesce(rises / F.when(n > 1, n - 1) >= INDENT_RISE, F.lit(False))

    return T.let(F.transform(_not_blank(raw), T.indent), judge)


def _may_be_indented(text: Column) -> Column:
    """Whether any line begins with a blank: without one there is one width only, which is_indented rules out."""
    blanks = (" ", "\t", "　")
    return reduce(lambda a, b: a | b, (F.startswith(text, F.lit(c)) | F.contains(text, F.lit(f"\n{c}")) for c in blanks))


def is_dialogue(full: Column) -> Column:
    closed = _share(full, lambda x: x.rlike(r"[。！？]\z"))
    short = lambda length: (_mean(length) <= DIALOGUE_MEAN) & (_share(length, lambda n: n <= DIALOGUE_SHORT) > DIALOGUE_SHARE)
    return (F.size(full) >= DIALOGUE_LINES) & F.coalesce(T.let(F.transform(full, F.length), short) & (closed < DIALOGUE_CLOSED), F.lit(False))


def is_list(full: Column) -> Column:
    short = lambda length: (_mean(length) <= LIST_MEAN) & (_share(length, lambda n: n <= LIST_SHORT) > LIST_SHARE)
    return (F.size(full) >= LIST_LINES) & F.coalesce(T.let(F.transform(full, F.length), short), F.lit(False))


def layout_mode(text: Column) -> Column:
    flat = lambda full: F.when(is_dialogue(full), DIALOGUE).when(is_list(full), LIST).otherwise(PARAGRAPH)
    return F.when(_may_be_indented(text) & is_indented(T.lines(text)), INDENTED).otherwise(T.let(T.full_lines(text), flat))


def join_indented(raw: Column) -> Column:
    """Lines put together without separator; a line less indented than the one before it
    starts a new sentence, one of equal indent goes on. A newline, which no line has, sets sentences apart."""

    def joined(full: Column, width: Column) -> Column:
        marked = lambda x, i: F.concat(F.when(F.get(width, i) < F.get(width, i - 1), "\n").otherwise(""), T.strip(x))
        return F.filter(F.split(F.array_join(F.transform(full, marked), ""), "\n", -1), lambda x: x != "")

    return T.let(_not_blank(raw), lambda full: T.let(F.transform(full, T.indent), lambda width: joined(full, width)))


def sentences_of(text: Column, mode: Column) -> Column:
    """Raw sentences of a cleaned text in its layout, all split at punctuation at last. Their ends are marked in the whole
    text, which is split once: no pattern runs piece by piece."""
    marked = F.when(mode == PARAGRAPH, T.marked_paragraphs(text)).when(mode == INDENTED, F.array_join(join_indented(T.lines(text)), T.MARK))
    return T.split_marked(marked.otherwise(F.translate(text, "\n", T.MARK)))


def sentence_lists(corpus: DataFrame) -> DataFrame:
    """A corpus (file_id, tag, text and any others) with mode and sentences, an array of
    struct<sent_ord, text>, in place of its text. One row per file; null texts drop out."""
    others = [c for c in corpus.columns if c != "text"]
    cleaned = corpus.where("text is not null").select(*others, T.clean(F.col("text")).alias("text"))
    known = cleaned.withColumn("mode", layout_mode(F.col("text")))
    found = F.transform(sentences_of(F.col("text"), F.col("mode")), lambda s, i: F.struct(i.alias("sent_ord"), s.alias("text")))
    return known.select(*others, "mode", found.alias("sentences"))


def extract_sentences(corpus: DataFrame) -> DataFrame:
    """file_id, tag, mode, sent_ord, text of every sentence of a corpus (file_id, tag, text)."""
    return inlined(sentence_lists(corpus.select("file_id", "tag", "text")), F.col("sentences"), "file_id", "tag", "mode")


def inlined(lists: DataFrame, sentences: Column, *others: str) -> DataFrame:
    """``others`` and a row per element of ``sentences``, an array of structs with a sent_ord. By the outer form: under
    a plain explode the planner puts a filter on the array's size, moves it below everything down to the
    table's own splits, and makes the whole array there once more."""
    return lists.select(*others, F.inline_outer(sentences)).where("sent_ord is not null")


# ------------------------------------------------ classifiers kept for direct use only


def punctuation_ratio(full: Column) -> Column:
    """Share of the full lines that end in a full-width terminator."""
    return F.coalesce(_share(full, lambda x: x.rlike(r"[。！？]\z")), F.lit(0.0))


def merge_hard_wrap(text: Column) -> Column:
    """Lines of a hard-wrapped text: every newline separates, blanks become ideographic spaces."""
    joined = F.regexp_replace(F.regexp_replace(text, r"\n{2,}", "\n\n"), r"[ \t]+", "　")
    return F.filter(F.split(joined, "\n", -1), lambda x: x != "")
