"""The driver's tables in Japanese script, letter for letter, so that the Japanese rules run over whole tables.

Every letter has one hiragana, katakana, half-width and kanji character each, by rule; which of them stands for it
depends on the document (texts) or the word (words). Marks of speakers, guides and headings go by the sentence's place.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.profiles import SKIP_POS1, SKIP_POS12
from lexiforge.functions.scoring import PRIORITY
from lexiforge.operators.userdict import POS_MAP

HIRAGANA = "".join(chr(0x3041 + 3 * i) for i in range(26))
KATAKANA = "".join(chr(0x30A1 + 3 * i) for i in range(26))
HALF_WIDTH = "".join(chr(0xFF71 + i) for i in range(26))
KANJI = "".join(chr(0x4E00 + 97 * i) for i in range(26))
DIGITS = "".join(chr(0xFF10 + i % 10) for i in range(26))
MARKS, SHOWN_MARKS = ".,!?()", "。、！？「」"


def _vowels(vowels: str, rest: str) -> str:
    return "".join(v if c in "aeiou" else r for c, v, r in zip(ascii_lowercase, vowels, rest))


LETTERS = ascii_lowercase + ascii_uppercase + MARKS
#: What the letters and marks of a text become, by doc_id % 4.
TEXTS = tuple(t + SHOWN_MARKS for t in (HIRAGANA + KANJI, KATAKANA + KANJI, _vowels(HIRAGANA, KANJI) + KATAKANA, _vowels(KANJI, HALF_WIDTH) + ascii_uppercase))
#: What the letters of a lower-case word become, by the sum of its length and first code point, modulo 8; the last but two are
#: numbers, the last but one is cut to one character, the last ends with a long mark.
WORDS = (HIRAGANA, KATAKANA, _vowels(HIRAGANA, KANJI), ascii_lowercase, KANJI, DIGITS, HIRAGANA, HIRAGANA)

# Analyser parts of speech, the ones that never make vocabulary and others.
POS_PAIRS = (("名詞", "普通名詞"), ("動詞", "一般"), ("助動詞", "*"), *((p, "一般") for p in SKIP_POS1), *SKIP_POS12, ("形容詞", "一般"))
POS_NAMES = (*POS_MAP, "something else", "particle")
PRIORITY_MARKS = (*PRIORITY, "nfxx", "unknown", "nf00", "nf48")


def text(doc_id: Column, latin: Column) -> Column:
    """A text in Japanese script."""
    out = F.translate(latin, LETTERS, TEXTS[3])
    for i in range(3):
        out = F.when(doc_id % 4 == i, F.translate(latin, LETTERS, TEXTS[i])).otherwise(out)
    return out


def marked(doc_id: Column, place: Column, piece: Column) -> Column:
    """A sentence with what the rules look for: a speaker, gaps, a quote, guide labels, cuts."""
    first = lambda n: F.substring(piece, 1, n)
    kinds = (
        F.concat(F.lit("名前>"), piece), F.concat(piece, F.lit("[...]")), F.concat(F.lit("「"), piece), F.concat(F.lit("行き方 "), first(8)), first(4), F.concat(F.lit("名前>"), first(12)),
        F.concat(first(3), F.lit(" Ｍ "), first(9)), F.concat(piece, F.lit("[...][...][...]")), F.concat(first(40), F.lit("。")), first(30),
    )
    out = piece
    for i, kind in enumerate(kinds):
        out = F.when((doc_id + place) % 12 == i, kind).otherwise(out)
    return out


def word(latin: Column) -> Column:
    """A lower-case word in Japanese script."""
    kind = (F.length(latin) + F.ascii(latin)) % 8
    out = F.concat(F.translate(latin, ascii_lowercase, WORDS[7]), F.lit("ー"))
    for i in range(7):
        shown = F.translate(latin, ascii_lowercase, WORDS[i])
        out = F.when(kind == i, F.substring(shown, 1, 1) if i == 6 else shown).otherwise(out)
    return out


def pos_pair(latin: Column) -> Column:
    pairs = F.array(*(F.array(F.lit(a), F.lit(b), F.lit("*"), F.lit("*")) for a, b in POS_PAIRS))
    return F.get(pairs, (F.length(latin) * 7 + F.ascii(latin)) % len(POS_PAIRS))


def picked(number: Column, names: tuple[str, ...]) -> Column:
    """None to three of the names, by a number."""
    every = F.array(*map(F.lit, names))
    return F.slice(F.array(*(F.get(every, ((number * 7 + j * 5) % len(names)).cast("int")) for j in range(3))), F.lit(1), (number % 4).cast("int"))


def words(table: DataFrame, pattern: str) -> DataFrame:
    """latin, word: the distinct lower-case words of a table of texts."""
    each = table.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("latin")).distinct()
    return each.select("latin", word(F.col("latin")).alias("word"))
