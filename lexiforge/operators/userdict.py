"""User-dictionary building: n-gram candidates, part-of-speech choice, costs and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.profiles import ngram_chars
from lexiforge.operators.dictionary import all_pos, inverted_index, ranked_entries

MIN_GRAM, MAX_GRAM = 2, 20

# Dictionary part of speech to the analyser's four levels.
POS_MAP = {
    "noun (common) (futsuumeishi)": ("名詞", "普通名詞", "一般", "*"),
    "noun (proper)": ("名詞", "固有名詞", "一般", "*"),
    "noun (temporal) (jisoumeishi)": ("名詞", "普通名詞", "副詞可能", "*"),
    "noun, used as a prefix": ("名詞", "普通名詞", "接頭可能", "*"),
    "noun, used as a suffix": ("名詞", "普通名詞", "接尾可能", "*"),
    "numeric": ("名詞", "数詞", "*", "*"),
    "Ichidan verb": ("動詞", "一般", "*", "*"),
    "Godan verb": ("動詞", "一般", "*", "*"),
    "Godan verb - -aru special class": ("動詞", "一般", "*", "*"),
    "Kuru verb - special class": ("動詞", "一般", "*", "*"),
    "Suru verb": ("動詞", "一般", "*", "*"),
    "Suru verb - included": ("動詞", "一般", "*", "*"),
    "transitive verb": ("動詞", "一般", "*", "*"),
    "intransitive verb": ("動詞", "一般", "*", "*"),
    "adjective (keiyoushi)": ("形容詞", "一般", "*", "*"),
    "adjectival nouns or quasi-adjectives (keiyodoshi)": ("形状詞", "一般", "*", "*"),
    "adjectival nouns or quasi-adjectives (keiyodoshi) taking the 'no' particle": ("形状詞", "一般", "*", "*"),
    "adjective (prenoun)": ("連体詞", "*", "*", "*"),
    "pre-noun adjectival (rentaishi)": ("連体詞", "*", "*", "*"),
    "adverb (fukushi)": ("副詞", "一般", "*", "*"),
    "adverb taking the 'to' particle": ("副詞", "一般", "*", "*"),
    "particle": ("助詞", "*", "*", "*"),
    "auxiliary verb": ("助動詞", "*", "*", "*"),
    "auxiliary adjective": ("助動詞", "*", "*", "*"),
    "conjunction": ("接続詞", "*", "*", "*"),
    "interjection (kandoushi)": ("感動詞", "一般", "*", "*"),
    "prefix": ("接頭辞", "*", "*", "*"),
    "suffix": ("接尾辞", "*", "*", "*"),
    "expressions (phrases, clauses, etc.)": ("名詞", "普通名詞", "一般", "*"),
}
# Which first level wins among several.
POS_PRIORITY = ("動詞", "形容詞", "形状詞", "副詞", "接続詞", "感動詞", "名詞")


#: Lengths of the prefixes by which forms and texts meet.
TIERS = (2, 4, 8, 16)


def runs(text: Column, members: str | None = None) -> Column:
    """Maximal runs of the class's characters (by default those of Japanese n-grams)."""
    return F.regexp_extract_all(text, F.lit(f"[{members or ngram_chars()}]+"), F.lit(0))


def longest_grams(lines: DataFrame, low: int = MIN_GRAM, high: int = MAX_GRAM, members: str | None = None) -> DataFrame:
    """Distinct ``gram``: from every place of every run what follows, up to ``high`` characters, if it has
    ``low``. Every candidate is a prefix of one of these."""
    each = lines.select(F.explode(F.array_distinct(runs(F.col("text"), members))).alias("run")).distinct()
    starts = F.filter(F.sequence(F.lit(1), F.length("run")), lambda i: F.length("run") - i + 1 >= low)
    return each.select(F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("run", i, F.lit(high))))).alias("gram")).distinct()


def candidate_ngrams(lines: DataFrame, low: int = MIN_GRAM, high: int = MAX_GRAM, members: str | None = None) -> DataFrame:
    """Distinct candidate substrings of a table of texts: the prefixes of the distinct longest grams, so that
    what stands at many places is taken apart once."""
    grams = longest_grams(lines, low, high, members)
    prefixes = F.transform(F.sequence(F.lit(low), F.length("gram")), lambda k: F.substring("gram", 1, k))
    return grams.select(F.explode(prefixes).alias("candidate")).distinct()


def _tier(length: Column) -> Column:
    """The longest prefix length up to ``length``."""
    return F.array_max(F.filter(F.array(*map(F.lit, TIERS)), lambda t: t <= length))


def forms_in(lines: DataFrame, forms: DataFrame, low: int = MIN_GRAM, high: int = MAX_GRAM, members: str | None = None) -> DataFrame:
    """Distinct ``candidate``: the forms (column form) of ``low`` to ``high`` characters that stand in the runs
    of the texts. A form meets the longest grams that share its prefix of 2, 4, 8 or 16 characters (the longest
    it has), so a gram makes four rows at most, where its n-grams would be nineteen."""
    if low < TIERS[0]:
        raise ValueError(f"forms of less than {TIERS[0]} characters have no prefix to meet by")
    grams = longest_grams(lines, low, high, members)
    tiers = F.filter(F.array(*map(F.lit, TIERS)), lambda t: t <= F.length("gram"))
    windows = grams.select("gram", F.explode(tiers).alias("t")).select("gram", F.expr("substring(gram, 1, t)").alias("prefix"))
    known = forms.where(F.length("form").between(low, high)).select("form").distinct()
    known = known.select("form", F.substring("form", F.lit(1), _tier(F.length("form"))).alias("prefix"))
    return windows.join(known, "prefix").where(F.startswith("gram", "form")).select(F.col("form").alias("candidate")).distinct()


def unsegmented(candidates: DataFrame, tokenizer) -> DataFrame:
    """Candidates that the tokeniser doesn't take for one token, so they aren't known yet."""
    return tokenizer.lists(candidates.withColumn("text", F.col("candidate"))).where(F.size("tokens") != 1).select("candidate")


def resolve_pos(pos: Column) -> Column:
    """The analyser's parts of speech for a sense's list: the mapped one of highest priority, the
    first such; else the first mapped; null if none is."""
    table = F.create_map(*[x for k, v in POS_MAP.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    mapped = F.filter(F.transform(pos, lambda p: F.try_element_at(table, p)), lambda x: x.isNotNull())

    def place(x: Column) -> Column:
        out = F.lit(len(POS_PRIORITY))
        for i, p in enumerate(POS_PRIORITY):
            out = F.when(x[0] == p, i).otherwise(out)
        return out

    ranked = F.array_sort(F.transform(mapped, lambda x, i: F.struct(place(x).alias("p"), i.alias("i"), x.alias("pos"))))
    return F.get(ranked, 0)["pos"]


def is_all_hiragana(word: Column) -> Column:
    return word.rlike(r"\A[ぁ-んー]+\z")


def only_nouns(pos: Column) -> Column:
    return F.forall(pos, lambda p: p.startswith("noun"))


def only_verbs_or_nouns(pos: Column) -> Column:
    """Every one a noun, or naming "verb" (so adverbs count too)."""
    return F.forall(pos, lambda p: p.startswith("noun") | p.contains("verb"))


def is_expression(pos: Column) -> Column:
    return F.exists(pos, lambda p: p.startswith("expressions"))


def cost(word: Column, expression: Column) -> Column:
    n = F.length(word)
    fragment = F.when(is_all_hiragana(word), F.when(n < 3, 1000).otherwise(500)).otherwise(0)
    return F.when(expression, 500 * n - 1000 + fragment).otherwise(1750 * n)


def build(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """The 18 columns of a user dictionary (c0 to c17) for the candidates that the dictionary
    has, a part of speech is known for, and that aren't kana-only verbs or nouns."""
    best = ranked_entries(entries).select("form", "reading", "senses")
    rows = candidates.join(best, F.col("candidate") == F.col("form"))
    word, every = F.col("candidate"), all_pos(F.col("senses"))
    rows = rows.withColumn("p", resolve_pos(F.get("senses", 0)["pos"])).where("p is not null")
    rows = rows.where(~(is_all_hiragana(word) & only_verbs_or_nouns(every)))
    star = F.lit("*")
    cells = [word, F.lit(0), F.lit(0), cost(word, is_expression(every)), word, F.col("p")[0], F.col("p")[1], F.col("p")[2], F.col("p")[3], star, star, F.get("reading", 0)["form"], word, star, F.lit("C"), star, star, star]
    return rows.select(*(c.alias(f"c{i}") for i, c in enumerate(cells)))


def user_dictionary(lines: DataFrame, entries: DataFrame, tokenizer=None, members: str | None = None) -> DataFrame:
    """build() of the dictionary's forms that stand in the texts, without those that the tokeniser (if one is
    given) takes for one token already."""
    found = forms_in(lines, inverted_index(entries).select("form"), members=members)
    return build(found if tokenizer is None else unsegmented(found, tokenizer), entries)
