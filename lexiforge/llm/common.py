"""Shared helpers: shared-folder materialisation, bounded prefix sums, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from hashlib import blake2b
from os import urandom

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space and U+0009..U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rank of a null doc_id: after every other id.
NULL_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder (tests); on a cluster
    a missing setting is an error, since machine-local files would be unreadable
    for other executors.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    where = getattr(spark.sparkContext, "_lexiforge_dir", None)
    if where is None:
        where = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
        spark.sparkContext._lexiforge_dir = where
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder. Its files go when the driver ends."""
    path = f"{shared_dir(spark)}/lexiforge/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, an executor's
    loss costs nothing, and the planner sees the true size (so broadcasts are size-checked).
    The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Words in ``text``; null has none. Keeps each word's first character and counts those."""
    first = F.regexp_replace(text, r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "$1")
    return F.coalesce(F.length(first), F.lit(0)).cast("long")


def rank_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def prefix_sums(df: DataFrame, group: list[str], coarse: list[Column], fine: list[Column], value: str, rows_per_bucket: int, total_rows: int) -> DataFrame:
    """Exclusive running sum ``before`` and running count ``seq`` of ``value`` inside each
    ``group``, over the order (coarse, hash bucket, fine), without one task per group.

    Every (group, coarse) run is dealt into hash buckets of about ``rows_per_bucket`` rows;
    bucket totals are summed by a window over buckets only, rows by a window inside a
    bucket. So a group with a third of all rows is spread over many tasks.
    Ties in ``fine`` must be interchangeable rows.
    """
    buckets = max(1, -(-total_rows // rows_per_bucket))
    keys = [f"__c{i}" for i in range(len(coarse))]
    dealt = df.withColumns(dict(zip(keys, coarse)))
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64(*fine), F.lit(buckets)))
    totals = dealt.groupBy(*group, *keys, "__b").agg(F.sum(value).alias("__t"), F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*group).orderBy(*keys, "__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, *keys, "__b", F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__t0"), F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__n0"))
    inside = Window.partitionBy(*group, *keys, "__b").orderBy(*fine)
    rows = dealt.withColumn("__s", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)).withColumn("__r", F.row_number().over(inside) - 1)
    on = [rows[k].eqNullSafe(totals[k]) for k in [*group, *keys, "__b"]]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    out = rows.join(totals, cond)
    return out.select(*[rows[c] for c in df.columns], (F.col("__t0") + F.col("__s")).alias("before"), (F.col("__n0") + F.col("__r")).alias("seq"))


# ---------------------------------------------------------------- word hashing in numpy

_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (published constants): a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for base in (int(_BASES[which]), _inverse(int(_BASES[which]))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        have = (both[0], both[1])
        if size <= 1 << 20:
            _POWERS[which] = have
    return have


def rolling(values: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, inverse powers) for window_hash()."""
    power, inverse = _powers(which, len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=prefix[1:])
    return prefix, inverse


def window_hash(roll: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for arrays of bounds; equal sequences hash alike anywhere."""
    prefix, inverse = roll
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Words whose digests a worker remembers, the first it meets, and their bytes at most.
WORDS_HELD, WORD_HELD = 1 << 17, 64


class _Digests(dict):
    """128-bit BLAKE2b digest of each word under a key."""

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> bytes:
        got = blake2b(word, digest_size=16, key=self.key).digest()
        if len(self) < WORDS_HELD and len(word) <= WORD_HELD:
            self[word] = got
        return got


_DIGESTS = _Digests(b"")


def new_key() -> bytes:
    """A key for the digests of one run. Hashes of word runs are polynomials in the digests with known
    bases: under a key that no text was written for, two different runs can't be made to share one."""
    return urandom(16)


def text_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8, with A-Z lower-cased on demand: bytes.split() parts
    exactly at space and U+0009..U+000D, bytes.lower() changes exactly A-Z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_digests(words: list[bytes], key: bytes = b"") -> np.ndarray:
    """Two independent 64-bit hashes of each word: an array of shape (words, 2)."""
    global _DIGESTS
    if _DIGESTS.key != key:
        _DIGESTS = _Digests(key)
    return np.frombuffer(b"".join(map(_DIGESTS.__getitem__, words)), "<u8").reshape(-1, 2)
