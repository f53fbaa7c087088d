"""Quality rules with risk-controlled thresholds, by DataFrame functions only.

Each document gets five word and line statistics. A fixed base rule rejects very short and very
repetitive texts. Beyond it, a text's badness is the largest of its ratios, each over a fixed
scale, and a cutoff on it is chosen per stratum (language) from labelled documents: cutoffs are
tried from the loosest on; one is certified while the exact binomial probability of as few
rejections among the stratum's good documents, if the true false-rejection rate were RISK,
stays below LEVEL / number of strata (fixed-sequence testing inside a stratum, Bonferroni
over strata). So with probability 1 - LEVEL no stratum loses more than RISK of its good
documents. Of the certified cutoffs the one that rejects the most bad labelled documents is
used, the loosest on ties; a stratum without one keeps what the base rule keeps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import documents, materialize

RISK = 0.02
LEVEL = 0.05
MIN_WORDS = 50
#: Ratios and what each is measured in.
SCALES = {"symbols": 0.10, "dup_lines": 0.30, "repeats": 0.30, "upper": 0.40, "marks": 0.15}
#: Cutoffs on the badness, from the loosest on.
CUTOFFS = (4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4)

_GAP = r"[\x20\x09-\x0D]+"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, a digest of the text (fp, fp2), the five statistics and the ratios' badness; one row per row of ``docs``.

    Null and empty texts count 0 of everything. Everything is computed inside the row: there is
    no shuffle, and very long texts only make longer arrays."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("t"))
    rows = rows.withColumns({"fp": F.xxhash64("t"), "fp2": F.hash("t")})
    rows = rows.withColumn("w", F.array_remove(F.split("t", _GAP), ""))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), F.hash(F.get("w", i + 2), F.get("w", i)).alias("g"), i.alias("i")))
    rows = rows.withColumn("s", F.when(F.size("w") >= 3, F.sort_array(grams)))
    same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
    twice = F.filter("s", lambda x, k: F.coalesce(same(x, F.get("s", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("s", k + 1)), F.lit(False)))
    rows = rows.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.aggregate(
        "p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("sum")),
        lambda a: a["sum"],
    )
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        "lang",
        "fp",
        "fp2",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("l"),
        F.coalesce(gaps, F.lit(0)).alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^!?]+", "")).alias("n_marks"),
    )
    rows = rows.withColumn("n_lines", F.size("l").cast("long")).withColumn("n_dup_lines", (F.size("l") - F.size(F.array_distinct("l"))).cast("long")).drop("l")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    part = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    ratio = {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words"), "upper": part("n_upper", "word_chars"), "marks": part("n_marks", "n_words")}
    bad = F.greatest(*(ratio[k] / SCALES[k] for k in SCALES))
    return rows.select("doc_id", "lang", "fp", "fp2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), bad.alias("badness"))


def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series, eight steps up, exact to about 1e-12."""
    z = x + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for i in range(1, 9):
        series = series - F.log(x + float(i))
    return series


def binomial_at_most(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, risk), for k below the mean; 1 from the mean on. Terms
    are summed downwards from k; they fall geometrically, and 12 deviations hold all that counts."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(risk) + (n - k) * math.log1p(-risk))
    steps = F.least(k, F.ceil(12 * F.sqrt(n * risk * (1 - risk))) + 60).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, t: F.struct((a["term"] * (k - t) / (n - k + t + 1) * ((1 - risk) / risk)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * total))


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum, cutoff: the certified cutoff of each language that has one. Labels repeated for an
    id count once, as the best one; so do labelled copies of a text in a language, which are
    no independent trials, and rows that share an id and a text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumnRenamed("doc_id", "id_")
    held = stats.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("id_"))
    held = held.groupBy("lang", "fp", "fp2").agg(F.max("badness").alias("badness"), F.max("quality").alias("quality"))
    grid = F.array(*map(F.lit, CUTOFFS))
    level_of = F.size(F.filter(grid, lambda c: F.col("badness") > c))  # cutoffs that reject it: the tightest ones
    binned = held.groupBy(F.col("lang").alias("stratum"), level_of.alias("bin")).agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad"))
    binned = materialize(binned, "quality-bins")
    strata = binned.agg(F.count_distinct(F.coalesce("stratum", F.lit("\0")))).first()[0]
    each = binned.select("stratum", "bin", "good", "bad", F.posexplode(grid).alias("g", "cutoff"))
    out = F.col("bin") >= len(CUTOFFS) - F.col("g")
    table = each.groupBy("stratum", "g", "cutoff").agg(F.sum("good").alias("n"), F.sum(F.when(out, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(out, F.col("bad")).otherwise(0)).alias("caught"))
    table = table.withColumn("passes", binomial_at_most(F.col("k"), F.col("n"), risk) <= level / max(strata, 1))
    order = Window.partitionBy("stratum").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    certified = table.withColumn("passes", F.min("passes").over(order)).where("passes")
    best = certified.groupBy("stratum").agg(F.max(F.struct("caught", "cutoff")).alias("best"))
    return best.select("stratum", F.col("best.cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Statistics, base_failed, cutoff and kept of every row."""
    stats = materialize(statistics(docs), "quality-statistics")
    chosen = materialize(cutoffs(stats, labels, risk, level), "quality-cutoffs")
    out = stats.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("badness") > F.col("cutoff"), F.lit(False))
    return out.withColumn("kept", kept).drop("stratum")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row of documents; null and empty texts fail the base rule,
    repeated rows are judged alike, an empty table gives an empty result."""
    got = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "badness", "cutoff")
