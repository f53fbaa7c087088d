"""Tokenisers: sentences (file_id, tag, sent_ord, text) to tokens.

A tokeniser is anything with ``fingerprint`` and ``lists(sentences)``, which adds ``tokens``: an array of
struct<surface, lemma, reading, pos> per sentence, in order. One whose tokens are an expression of the text
has ``column(text)`` as well; one with ``surfaces(text)`` and ``pos`` has tokens that follow from their surfaces. ``exploded`` makes rows of them: file_id, tag, sent_ord, tok_ord and the token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.profiles import quick
from lexiforge.functions.text import kana_fold

TOKEN = "array<struct<surface:string,lemma:string,reading:string,pos:array<string>>>"


@dataclass(frozen=True)
class RegexTokenizer:
    """Runs of letters, by built-in functions only: lemma and reading are the lower-cased
    surface. ``pattern`` for Japanese splits at script changes, an approximation."""

    pattern: str = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
    pos: tuple[str, ...] = ("名詞", "普通名詞", "一般", "*")

    @property
    def fingerprint(self) -> str:
        return f"regex:{self.pattern}"

    def surfaces(self, text: Column) -> Column:
        """The surfaces alone: lemma and reading follow from them, parts of speech are the same for all."""
        pattern = re.sub(r"\[([^][^&\\]+)\]", lambda m: quick(m[1]), self.pattern)
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def only_of(self, members: str) -> bool:
        """Whether every lemma has a character of a regex class, because the pattern is one class of some of them."""
        one = re.fullmatch(r"\[([^][^&\\]+)\]\+", self.pattern)
        if not one or max(one[1]) > "\u00ff":
            return False
        own, whole = re.compile(one[0][:-1]), re.compile(f"[{members}]") if "\\" not in members else None
        return whole is not None and all(whole.fullmatch(chr(c).lower()) for c in range(256) if own.match(chr(c)))

    def column(self, text: Column) -> Column:
        pos = F.array(*map(F.lit, self.pos))
        token = lambda s: F.struct(s.alias("surface"), F.lower(s).alias("lemma"), F.lower(s).alias("reading"), pos.alias("pos"))
        return F.transform(self.surfaces(text), token)

    def lists(self, sentences: DataFrame) -> DataFrame:
        return sentences.withColumn("tokens", self.column(F.col("text")))

    def tokens(self, sentences: DataFrame) -> DataFrame:
        return exploded(self.lists(sentences))


#: Script runs: kanji with okurigana, katakana, hiragana.
JAPANESE_RUNS = RegexTokenizer("[一-龯々]+[ぁ-ん]*|[ァ-ンー]+|[ぁ-ん]+")


@dataclass(frozen=True)
class Pretokenized:
    """Tokens that exist already, as a DataFrame with file_id, sent_ord, tok_ord and the rest."""

    table: DataFrame
    fingerprint: str = "pretokenized"

    def lists(self, sentences: DataFrame) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("tok_ord", "surface", "lemma", "reading", "pos")))
        lists = self.table.groupBy("file_id", "sent_ord").agg(F.transform(own, lambda t: t.dropFields("tok_ord")).alias("tokens"))
        return sentences.join(lists, ["file_id", "sent_ord"])

    def tokens(self, sentences: DataFrame) -> DataFrame:
        return self.table.join(sentences.select("file_id", "tag", "sent_ord"), ["file_id", "sent_ord"])


@dataclass(frozen=True)
class MorphologicalTokenizer:
    """A morphological analyser in an Arrow-batched UDF, imported where it runs: longest units,
    lemma by dictionary form. The analyser is made once per Python worker."""

    dictionary: str = "full"
    config: str | None = None

    @property
    def fingerprint(self) -> str:
        return f"sudachi:{self.dictionary}:{self.config}"

    def lists(self, sentences: DataFrame) -> DataFrame:
        dictionary, config = self.dictionary, self.config

        @F.pandas_udf(TOKEN)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sudachipy import dictionary as source
            from sudachipy import tokenizer as modes

            own = source.Dictionary(dict=dictionary, config_path=config).create()
            for texts in batches:
                yield texts.map(lambda t: [
                    {"surface": m.surface(), "lemma": m.dictionary_form() or m.surface(), "reading": m.reading_form(), "pos": list(m.part_of_speech())}
                    for m in own.tokenize(t or "", modes.Tokenizer.SplitMode.C)
                ])

        return sentences.withColumn("tokens", run("text"))

    def tokens(self, sentences: DataFrame) -> DataFrame:
        return exploded(self.lists(sentences))


def exploded(lists: DataFrame) -> DataFrame:
    """A row per token, tok_ord counting from 0 in the sentence."""
    return lists.select("file_id", "tag", "sent_ord", F.posexplode("tokens").alias("tok_ord", "t")).select("file_id", "tag", "sent_ord", "tok_ord", "t.*")


class _AsIs:
    """For sentences that have their ``tokens`` already."""

    fingerprint = "as-is"

    def lists(self, sentences: DataFrame) -> DataFrame:
        return sentences


ASIS = _AsIs()


def lemma_readings(lemmas: DataFrame, tokenizer) -> DataFrame:
    """lemma, reading of the distinct lemmas of a table, each analysed once on its own: the reading of its
    first token, folded to hiragana."""
    once = lemmas.select("lemma").where("lemma <> ''").distinct()
    own = tokenizer.lists(once.withColumn("text", F.col("lemma")))
    return own.select("lemma", kana_fold(F.get("tokens", 0)["reading"]).alias("reading"))


def lists_with_readings(lists: DataFrame, readings: DataFrame) -> DataFrame:
    """Sentences whose tokens' readings are those of their lemmas, from a table (lemma, reading), folded
    to hiragana; a lemma that isn't there keeps its own. The table meets the distinct lemmas of a
    sentence, which go back to it as one map."""
    each = lists.select("file_id", "sent_ord", F.explode(F.array_distinct(F.transform("tokens", lambda t: t["lemma"]))).alias("lemma"))
    found = each.join(readings.select("lemma", "reading").where("reading is not null").dropDuplicates(["lemma"]), "lemma")
    maps = found.groupBy("file_id", "sent_ord").agg(F.map_from_entries(F.collect_list(F.struct("lemma", kana_fold(F.col("reading")).alias("reading")))).alias("own"))
    own = lambda t: F.coalesce(F.try_element_at("own", t["lemma"]), kana_fold(t["reading"]))
    return lists.join(maps, ["file_id", "sent_ord"], "left").withColumn("tokens", F.transform("tokens", lambda t: t.withField("reading", own(t)))).drop("own")
