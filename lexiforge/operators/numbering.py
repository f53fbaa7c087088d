"""Row numbers in a total order, without a task that sees all rows.

Rows are dealt to tasks by ranges of the order and sorted there. A row's number is its place in its
task plus what the tasks before it hold; only one count per task is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.staging import staged

#: Rows of a task, about: ranges come from a sample.
ROWS = 1_000_000
#: Bits of a row's place within its task in ``monotonically_increasing_id``.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", rows: int = ROWS) -> DataFrame:
    """``df`` with ``name``, a long: 0, 1, 2... in the given order.

    Rows that tie over the whole order are told apart by where they stand in the staged table, so
    that even equal rows are spread over tasks: add keys where their order matters. The table has
    ``rows`` rows a task, or as many as an even deal over the session's shuffle partitions gives,
    whichever is less. An empty table stays empty.
    """
    spark = df.sparkSession
    input_ = staged(df, "to-number")
    n = input_.count()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-n // rows), min(wanted, -(-n // 1000)))
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    tied = [*keys, F.col("__tie")]
    dealt = input_.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *tied).sortWithinPartitions(*tied)
    placed = staged(dealt.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("__at", PLACE_BITS)
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())  # a row per task
    before, so_far = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(so_far)
        so_far += sizes.get(i, 0)
    offsets = F.array(*[F.lit(b) for b in before]) if before else F.array().cast("array<long>")
    place = F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1)
    return placed.withColumn(name, F.get(offsets.cast("array<long>"), part.cast("int")) + place).drop("__at")


def numbered_within(df: DataFrame, groups: list[str], order: list[str | Column], name: str = "number", rows: int = ROWS) -> DataFrame:
    """``df`` with ``name`` from 0 in each of ``groups`` (no nulls), in the given order. A group of any
    size is spread over tasks; what is joined back is one row per group."""
    everywhere = numbered(df, [*groups, *order], "__n", rows)
    first = everywhere.groupBy(*groups).agg(F.min("__n").alias("__first"))
    return everywhere.join(first, groups).select(*df.columns, (F.col("__n") - F.col("__first")).alias(name))
