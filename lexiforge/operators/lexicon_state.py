"""A lexicon that files can be added to, changed in and taken out of.

Each file contributes one partial per lemma: a count, its first place, its first occurrence and its tag.
The state holds per lemma what partials add up to: sums that can be taken back exactly (places in fixed
point, files per tag), and the first occurrence. Only where a file that goes held a lemma's
first occurrence is that looked up again, among the partials of that lemma.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.lexicon import attributes, file_positions
from lexiforge.operators.staging import staged

#: Places are summed in units of 1 / UNITS: exact, whatever the order, and finer than a double's own error.
UNITS = 10**15
PLACE_SUM = "decimal(38,0)"


def partials(useful: DataFrame) -> DataFrame:
    """file_id, lemma, frequency, place, first, tag of numbered tokens: the file's share in each lemma."""
    return file_positions(useful).select("file_id", "lemma", "frequency", F.round(F.col("place") * UNITS).cast("long").alias("place"), "first", F.col("first.tag").alias("tag"))


def _sums(parts: DataFrame, sign: Column, **firsts: Column) -> DataFrame:
    """Per lemma: signed sums of frequency, files and places, and of files by tag; and the least of each of ``firsts``, which move with
    the sums."""
    tags = parts.groupBy("lemma", "tag").agg(F.sum(F.col("frequency") * sign).alias("f"), F.sum(sign).alias("n"), F.sum(F.col("place").cast(PLACE_SUM) * sign).alias("p"), *(F.min(c).alias(k) for k, c in firsts.items()))
    by_tag = F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n"))))
    return tags.groupBy("lemma").agg(F.sum("f").alias("frequency"), F.sum("n").alias("n_files"), F.sum("p").cast(PLACE_SUM).alias("place_sum"), by_tag.alias("tag_files"), *(F.min(k).alias(k) for k in firsts))


def state_of(parts: DataFrame) -> DataFrame:
    """lemma, frequency, n_files, place_sum, tag_files MAP<tag, files>, first: the sum of the partials."""
    return _sums(parts, F.lit(1), first=F.col("first"))


def updated(state: DataFrame, gone: DataFrame, new: DataFrame, current: DataFrame) -> DataFrame:
    """The state after the partials ``gone`` are taken out and ``new`` ones put in; ``current`` are all
    partials that hold afterwards. A changed file's old partials go and its new ones come."""
    signed = gone.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
    ends = {"out_first": F.when(F.col("sign") < 0, F.col("first")), "in_first": F.when(F.col("sign") > 0, F.col("first"))}
    change = _sums(signed, F.col("sign"), **ends).withColumnsRenamed({"frequency": "d_frequency", "n_files": "d_files", "place_sum": "d_places", "tag_files": "d_tags"})
    both = state.join(change, "lemma", "full_outer")
    zero = F.lit(0).cast(PLACE_SUM)
    none = F.create_map().cast("map<string,bigint>")
    tags = F.map_zip_with(F.coalesce("tag_files", none), F.coalesce("d_tags", none), lambda t, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    summed = both.select(
        "lemma",
        (F.coalesce("frequency", F.lit(0)) + F.coalesce("d_frequency", F.lit(0))).alias("frequency"),
        (F.coalesce("n_files", F.lit(0)) + F.coalesce("d_files", F.lit(0))).alias("n_files"),
        (F.coalesce("place_sum", zero) + F.coalesce("d_places", zero)).cast(PLACE_SUM).alias("place_sum"),
        F.map_filter(tags, lambda t, n: n > 0).alias("tag_files"),
        F.least("first", "in_first").alias("first"),
        F.coalesce(F.col("out_first") == F.col("first"), F.lit(False)).alias("lost"),
    )
    summed = staged(summed.where("n_files > 0"), "lexicon-sums")
    lost = summed.where("lost").select("lemma")
    found = current.join(lost, "lemma", "left_semi").groupBy("lemma").agg(F.min("first").alias("found"))
    return summed.join(found, "lemma", "left").withColumn("first", F.coalesce("found", "first")).drop("found", "lost")


def lexicon_of(state: DataFrame, pos: tuple[str, ...] = ()) -> DataFrame:
    """The columns of lexicon.lexicon."""
    reading, pos = attributes(F.col("first"), F.col("lemma"), state.schema["first"].dataType.names, pos)
    mean = F.col("place_sum").cast("double") / F.lit(float(UNITS)) / F.col("n_files")
    tags = F.array_sort(F.map_keys("tag_files"))
    return state.select("lemma", mean.alias("index"), F.col("n_files").cast("int").alias("index_count"), "frequency", reading, tags.alias("tags"), pos, F.col("first.at").alias("first_seen"))


@dataclass(frozen=True)
class Change:
    """Files by how they differ between two corpora (file_id, tag, text)."""

    gone: DataFrame
    new: DataFrame


def changed_files(before: DataFrame, after: DataFrame) -> Change:
    """Ids whose partials go (removed or changed files) and whose new partials come (added or changed ones), by
    a digest of tag and text."""
    digest = lambda c: F.sha2(F.concat_ws("\0", F.col("tag"), F.col("text")), 256).alias(c)
    both = before.select("file_id", digest("old")).join(after.select("file_id", digest("new")), "file_id", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    both = staged(both, "changed-files")
    return Change(both.where("old is not null").select("file_id"), both.where("new is not null").select("file_id"))
