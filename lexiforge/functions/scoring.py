"""Scores of words, dictionary entries and example sentences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of priority marks; nfNN counts (49 - NN) * 100.
PRIORITY = {"ichi1": 1000, "ichi2": 500, "news1": 800, "news2": 400, "spec1": 600, "spec2": 300, "gai1": 100, "gai2": 50}

# The example penalty.
IDEAL_LENGTH, LENGTH_STEP = 25, 15
VARIANCE_STEP = 100_000
UNKNOWN_WEIGHT, TOO_HARD_WEIGHT, DISTANCE_WEIGHT = 0.9, 0.9, 1.5
KNOWN_WANTED, KNOWN_WEIGHT = 6, 0.5


def word_score(frequency: Column, index: Column, max_frequency: Column) -> Column:
    """Frequency on a log scale against the maximum, and how early the word comes."""
    often = F.when(max_frequency > 0, F.log1p(frequency.cast("double")) / F.log1p(F.when(max_frequency > 0, max_frequency).cast("double"))).otherwise(0.0)
    return 0.7 * often + 0.3 * F.pow(1 - index, F.lit(1.5))


def tag_diversity(n_tags: Column, saturation: int = 10) -> Column:
    """0.1 for one tag, rising evenly to 1 at ``saturation`` tags."""
    return F.when(n_tags >= saturation, 1.0).otherwise(0.1 + 0.9 * (F.greatest(n_tags, F.lit(1)) - 1) / (saturation - 1))


def scaled_score(raw: Column, max_raw: Column) -> Column:
    return F.when(max_raw > 0, F.round(raw / F.when(max_raw > 0, max_raw) * 1000, 2)).otherwise(raw)


def priority_score(marks: Column) -> Column:
    """Sum of an element's priority marks; unknown or malformed ones count nothing."""

    def one(mark: Column) -> Column:
        named = F.lit(0)
        for name, points in PRIORITY.items():
            named = F.when(mark == name, points).otherwise(named)
        return F.when(mark.rlike(r"\Anf[+-]?[0-9]{1,8}\z"), (49 - F.regexp_extract(mark, r"\Anf([+-]?[0-9]{1,8})\z", 1).try_cast("int")) * 100).otherwise(named)

    return F.aggregate(F.transform(F.coalesce(marks, F.array().cast("array<string>")), one), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def entry_score(form: Column, kanji: Column, reading: Column) -> Column:
    """Priority of an entry for a form: over its kanji and reading elements of that form; if
    none has it, the first reading's."""
    elements = F.concat(kanji, reading)
    own = F.filter(elements, lambda e: e["form"] == form)
    matched = F.aggregate(F.transform(own, lambda e: priority_score(e["pri"])), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(own) > 0, matched).when(F.size(reading) > 0, priority_score(F.get(reading, 0)["pri"])).otherwise(0)


def example_penalty(length: Column, variance: Column, n_known: Column, n_total: Column) -> Column:
    return F.when(n_total > 0, variance / VARIANCE_STEP + (n_total - n_known) / F.when(n_total > 0, n_total) * UNKNOWN_WEIGHT + F.abs(length - IDEAL_LENGTH) / LENGTH_STEP + F.greatest(F.lit(0), KNOWN_WANTED - n_known) * KNOWN_WEIGHT).otherwise(0.0)


def nearest_rank(values: Column, share: float, empty: float = 3000.0) -> Column:
    """Element at floor(n * share), the last one at most, of the sorted values."""
    n = F.size(values)
    at = F.least(F.floor(n * F.lit(share)).cast("int"), n - 1) + 1
    return F.when(n > 0, F.element_at(F.sort_array(values), F.when(n > 0, at).otherwise(1))).otherwise(empty)


def two_decimals(x: Column) -> Column:
    """%.2f of a double's exact value, ties to even. For values from 0 to 4 the comparison with the tie
    is in whole numbers: scaling by 2**60 is exact, and so is the product as a decimal."""
    low = F.floor(x * 100)
    scaled = F.floor(F.when(x.between(0, 4), x * float(1 << 60))).cast("decimal(20,0)") * F.lit(200).cast("decimal(3,0)")
    tie = (low * 2 + 1).cast("decimal(4,0)") * F.lit(1 << 60).cast("decimal(20,0)")
    cents = low + F.when((scaled > tie) | ((scaled == tie) & (low % 2 == 1)), 1).otherwise(0)
    return F.when(x.between(0, 4), F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)).otherwise(F.format_string("%.2f", x))
