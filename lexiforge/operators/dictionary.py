"""Dictionary: inverted index, best entry per form, definitions, and the join with words.

Entries have entry_ord, kanji and reading (arrays of struct<form, pri>) and senses (array of
struct<gloss, pos, misc, field, dialect>). The best entry per form doesn't depend on the words, so
it is computed once and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.scoring import entry_score
from lexiforge.functions.text import kana_fold

ELEMENT = "struct<form:string,pri:array<string>>"
ENTRY_SCHEMA = f"entry_ord long, kanji array<{ELEMENT}>, reading array<{ELEMENT}>, senses array<struct<gloss:array<string>,pos:array<string>,misc:array<string>,field:array<string>,dialect:array<string>>>"


def inverted_index(entries: DataFrame) -> DataFrame:
    """A row per (form, entry) over kanji and reading forms; a form listed in both counts once."""
    forms = F.array_union(F.transform("kanji", lambda e: e["form"]), F.transform("reading", lambda e: e["form"]))
    return entries.select(F.explode(forms).alias("form"), "*").where("form is not null")


def lookup(entries: DataFrame, form: str) -> DataFrame:
    """Entries of one form in dictionary order."""
    return inverted_index(entries).where(F.col("form") == form).orderBy("entry_ord").drop("form")


def ranked_entries(entries: DataFrame, ties: str = "first") -> DataFrame:
    """Best entry of each form: highest priority, then most senses, then dictionary order.
    ``ties="all"`` keeps every entry of the highest priority and most senses."""
    if ties not in ("first", "all"):
        raise ValueError(f"unknown tie rule {ties!r}")
    scored = inverted_index(entries).withColumn("priority", entry_score(F.col("form"), F.col("kanji"), F.col("reading")))
    scored = scored.withColumn("n_senses", F.size("senses"))
    if ties == "all":
        place = Window.partitionBy("form").orderBy(F.desc("priority"), F.desc("n_senses"))
        return scored.withColumn("place", F.rank().over(place)).where("place = 1").drop("place")
    order = F.struct((-F.col("priority")).alias("p"), (-F.col("n_senses")).alias("s"), "entry_ord")
    whole = F.struct(*[c for c in scored.columns if c != "form"])
    return scored.groupBy("form").agg(F.min_by(whole, order).alias("x")).select("form", "x.*")


def definition(senses: Column) -> Column:
    """Senses with glosses, numbered if the entry has several; glosses apart by "; ", senses by <br>."""
    many = F.size(senses) > 1
    numbered = F.transform(senses, lambda s, i: F.struct(i.alias("i"), F.coalesce(s["gloss"], F.array().cast("array<string>")).alias("gloss")))
    shown = F.transform(F.filter(numbered, lambda s: F.size(s["gloss"]) > 0), lambda s: F.concat(F.when(many, F.concat((s["i"] + 1).cast("string"), F.lit(". "))).otherwise(F.lit("")), F.array_join(s["gloss"], "; ")))
    return F.array_join(shown, "<br>")


def definitions(entries: DataFrame) -> DataFrame:
    """form, entry_ord, priority, n_senses, definition, first_reading of each form's best entry."""
    best = ranked_entries(entries)
    return best.select("form", "entry_ord", "priority", "n_senses", definition(F.col("senses")).alias("definition"), F.get("reading", 0)["form"].alias("first_reading"))


def add_definitions(words: DataFrame, entries: DataFrame, readings: bool = False) -> DataFrame:
    """``words`` with definition, and invalid where there is none or it is empty; with ``readings`` also
    with the best entry's first reading, folded to hiragana, in place of their own. The join
    leaves the strategy to the planner: the dictionary's size decides, not a hint."""
    best = definitions(entries).select("form", F.col("definition").alias("definition"), F.col("first_reading").alias("__reading"))
    base = words.drop("definition", "invalid")
    out = base.join(best, base["lemma"] == best["form"], "left").drop("form")
    if readings:
        own = F.coalesce(F.nullif(kana_fold(F.col("__reading")), F.lit("")), F.col("reading"))
        out = out.withColumn("reading", own)
    return out.withColumn("invalid", F.coalesce("definition", F.lit("")) == "").drop("__reading")


def invalid_words(words: DataFrame) -> DataFrame:
    """word, reading, tags of the words without a definition."""
    return words.where("invalid").select(F.col("lemma").alias("word"), "reading", F.array_join(F.array_sort("tags"), " ").alias("tags"))


def all_pos(senses: Column) -> Column:
    """Distinct parts of speech over the senses."""
    return F.array_distinct(F.flatten(F.transform(senses, lambda s: F.coalesce(s["pos"], F.array().cast("array<string>")))))
