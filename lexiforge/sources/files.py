"""Corpus sources: folders of text files, document tables, line files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import source_tag, strip, universal_newlines
from lexiforge.operators.numbering import numbered

# Extensions of corpus files.
EXTENSIONS = (".tsv", ".txt", ".csv", ".pdf", ".xml", ".html", ".srt")


def gather(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of the corpus files. A single file is taken
    whatever its name; in a folder the extension decides, in any case. A missing path raises."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    path = re.sub(r"([\[\]{}*?])", r"\\\1", path)  # names are literal, no globs
    if not fs.getFileStatus(target).isDirectory():
        return files.load(path)
    return files.load(path).where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*EXTENSIONS))


def read_corpus(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file_id, path, tag, mtime, text of each file, ids by sorted path. Bytes that aren't UTF-8
    raise; newlines of all systems become one."""
    files = gather(spark, path, recursive)
    text = universal_newlines(F.decode("content", "UTF-8"))
    ids = numbered(files.select("path"), ["path"], "file_id")  # names only: numbering moves no content
    whole = files.select("path", F.col("modificationTime").alias("mtime"), text.alias("text"))
    return whole.join(ids, "path").select("file_id", "path", source_tag(F.col("path")).alias("tag"), "mtime", "text")


#: Bytes of a table, as it is stored, that make a task.
DEAL = 4 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table dealt by a key: evenly over the cores if it is small, a larger one in tasks of at most DEAL bytes, about. Texts
    move once; what is grouped by the key afterwards stays in its task."""
    return df.repartition(_tasks(df), key)


#: From here on a size is the planner's word for an unknown one.
UNKNOWN = 1 << 50


def _tasks(df: DataFrame) -> int:
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cores * max(1, -(-size // (DEAL * cores)))  # full rounds of tasks: no core waits for a last one


def deal_number(key: Column, numbers: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, numbers)), F.pmod(F.xxhash64(key), F.lit(len(numbers))).cast("int") + 1)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """spread() by ``deal``, a number that follows from the key. What another table sends to a deal meets its rows there: neither
    these rows nor what is exploded from them move again. The numbers, one for each task, are the column's metadata."""
    tasks = _tasks(df)
    spare = df.sparkSession.range(64 * tasks).select(F.col("id").cast("int").alias("n"))
    found = spare.groupBy(F.pmod(F.hash("n"), F.lit(tasks)).alias("task")).agg(F.min("n").alias("n")).collect()  # by Spark's own rule of a repartition
    numbers = sorted(r.n for r in found)
    return df.withColumn("deal", deal_number(F.col(key), numbers).alias("deal", metadata={"numbers": numbers})).repartition(tasks, "deal")


def from_documents(documents: DataFrame) -> DataFrame:
    """A document table as a corpus: its source is the tag. Null texts drop out."""
    own = [c for c in ("deal",) if c in documents.columns]
    return documents.where("text is not null").select(F.col("doc_id").alias("file_id"), F.coalesce("source", F.lit("[no tag]")).alias("tag"), "text", *own)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A conversation as one text, a line per turn in order: the dialogue layout."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    joined = conversations.groupBy("conv_id").agg(ordered.alias("x"))
    return joined.select(F.col("conv_id").alias("file_id"), F.lit("[no tag]").alias("tag"), F.array_join(F.transform("x", lambda t: t["text"]), "\n").alias("text"))


def read_lines(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Stripped lines that aren't blank, as text."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(strip(F.col("value")).alias("text"))
    return lines.where("text <> ''")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
