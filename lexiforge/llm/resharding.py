"""Minimum-cost-flow resharding: the fewest bytes move from old shards to new capacities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import documents, materialize, prefix_sums, shared_path

OLD_SHARDS = 12
NEW_SHARDS = 16
ROWS_PER_BUCKET = 20_000
#: Parts of all bytes, in the smallest rows, that even out what the larger ones leave.
SMALL_SHARES = (0.25, 0.02)
SEED = 3
#: Of shard files.
CODEC = "zstd"


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> list[list[int]]:
    """Bytes to send from each old to each new shard: successive shortest paths (Bellman-Ford)
    over the bipartite graph. By default what stays in its shard is free, a moved byte costs 1."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold all bytes")
    cost = cost or [[0 if i == j else 1 for j in range(m)] for i in range(n)]
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        far = [0 if x else float("inf") for x in left] + [float("inf")] * m
        via = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + cost[i][j] < far[n + j]:
                        far[n + j], via[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] - cost[i][j] < far[i]:
                        far[i], via[i], changed = far[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: far[n + j])
        path, at = [], n + end
        while via[at] >= 0:
            path.append((via[at], at))
            at = via[at]
        amount = min([room[end], left[at], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def equal_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def destination(old: Column, before: Column, flow: list[list[int]], start: list[int] | None = None) -> Column:
    """New shard of a row that starts ``before`` bytes into its old shard: from byte ``start`` on,
    what stays comes first, then one run of bytes (a block transfer) per destination."""
    out = F.when(F.lit(False), 0)
    for i, row in enumerate(flow):
        at, runs = start[i] if start else 0, sorted((j for j in range(len(row)) if row[j]), key=lambda j: (j != i, j))
        for j in runs:
            at += row[j]
            out = out.when((old == i) & ((before < at) if j != runs[-1] else F.lit(True)), j)
    return out.cast("int")


def _scaled(row: list[int], total: int) -> list[int]:
    """``total`` in the proportions of ``row``, whole bytes."""
    ends = [sum(row[: j + 1]) * total // max(sum(row), 1) for j in range(len(row))]
    return [e - b for b, e in zip([0, *ends], ends)]


def reshard(rows: DataFrame, old: str, size: str, fine: list[str], n_new: int, n_old: int, capacities: list[int] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, list[list[int]]]:
    """``rows`` with columns shard and slot, and the transfers flow[old][new] in bytes.

    ``rows`` must be cheap to read twice (materialised). Rows of an old shard stand by falling
    power of two of their size, in levels: the largest ones, those of the first of SMALL_SHARES of all
    bytes, and so on. A level is cut in the proportions of a flow to the room that the levels before
    it left in the new shards. So a new shard misses its capacity by at most one row of
    the last level for each transfer, unless its large rows alone exceed it. One total per old shard and
    power of two, and per level and transfer, reaches the driver."""
    total_rows, kind = rows.count(), F.length(F.bin(size))
    sums = {(r[0], r[1]): int(r[2]) for r in rows.groupBy(old, kind).agg(F.sum(size)).where(F.col(old).isNotNull()).collect()}  # 64 * n_old rows at most
    held = lambda i, low, high: sum(v for (k, b), v in sums.items() if (i is None or i == k) and low < b <= high)
    left = [held(i, -1, 64) for i in range(n_old)]
    total, room, flow = sum(left), list(capacities or equal_capacities(sum(left), n_new)), [[0] * n_new for _ in range(n_old)]
    ends = sorted({min((b for b in range(65) if held(None, -1, b) >= share * total), default=64) for share in SMALL_SHARES}, reverse=True)
    placed = prefix_sums(rows, [old], [-kind], [F.col(c) for c in fine], size, rows_per_bucket, total_rows).drop("seq").withColumn("shard", F.lit(None).cast("int"))
    for high, low in zip([64, *ends], [*ends, -1]):
        moves = min_cost_flow(left, [max(0, x) for x in room])
        own = [held(i, low, high) for i in range(n_old)]
        target = destination(F.col(old), F.col("before"), [_scaled(*x) for x in zip(moves, own)], [held(i, high, 64) for i in range(n_old)])
        placed = materialize(placed.withColumn("shard", F.when((kind > low) & (kind <= high), target).otherwise(F.col("shard"))), "reshard-placed")
        left = [x - y for x, y in zip(left, own)]
        for i, j, n in placed.where((kind > low) & (kind <= high)).groupBy(old, "shard").agg(F.sum(size)).collect():  # n_old * n_new rows at most
            flow[i][j] += int(n)
            room[j] -= int(n)
    out = prefix_sums(placed.drop("before"), ["shard"], [], [F.col(c) for c in fine], size, rows_per_bucket, total_rows)
    return out.withColumnRenamed("seq", "slot").drop("before"), flow


def affected(flow: list[list[int]], n_new: int) -> list[int]:
    """Shards whose files must be rewritten: they send or receive bytes."""
    return [k for k in range(n_new) if any(flow[i][k] for i in range(len(flow)) if i != k) or k < len(flow) and any(flow[k][j] for j in range(len(flow[k])) if j != k)]


def rewrite(placed: DataFrame, flow: list[list[int]], n_new: int, path: str) -> None:
    """Write the affected shards only, one folder shard=k each; other shards' files stay."""
    changed = affected(flow, n_new)
    spark = placed.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        placed.where(F.col("shard").isin(changed)).write.mode("overwrite").partitionBy("shard").parquet(path, compression=CODEC)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def transfer(docs: DataFrame, n_old: int, n_new: int, capacities: list[int] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, old_shard) with shard and slot, read from shard files.

    The old shards are written to the shared folder, the moves are planned on rows without
    texts, and the affected shards are written anew with theirs; a shard that neither sends nor
    receives is read from its old files. A text meets its place by the number its row got in
    the old files."""
    spark, n = docs.sparkSession, F.monotonically_increasing_id()
    before, after = shared_path(spark, "reshard-old"), shared_path(spark, "reshard-new")
    docs.select("doc_id", "text", "old_shard", n.alias("row")).write.mode("overwrite").partitionBy("old_shard").parquet(before, compression=CODEC)
    kinds = dict(docs.dtypes)
    held = spark.read.schema(f"doc_id {kinds['doc_id']}, text string, row long, old_shard int").parquet(before)
    rows = materialize(held.select("doc_id", "row", "old_shard", *digests()), "reshard-rows")
    placed, flow = reshard(rows, "old_shard", "size", ["doc_id", "text_crc32", "size", "row"], n_new, n_old, capacities)
    places = materialize(placed.select("doc_id", "row", "old_shard", "shard", F.col("slot").cast("long").alias("slot")), "reshard-places")
    texts = held.select("row", "old_shard", "text").hint("merge")  # so that disk grows with the input at every size
    moved = places.join(texts, ["row", "old_shard"]).select("doc_id", "text", "old_shard", "slot", "shard")
    rewrite(moved, flow, n_new, after)
    out = spark.read.schema(moved.schema).parquet(after)
    stay = [k for k in range(n_new) if k not in affected(flow, n_new)]
    if stay:
        out = out.unionByName(moved.where(F.col("old_shard").isin(stay)))
    return out


def digests() -> list[Column]:
    """size and text_crc32 of text: null texts have size 1 and checksum 0."""
    text = F.coalesce("text", F.lit(""))
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def op6_resharding(spark, sf_dir: str) -> DataFrame:
    """All documents from OLD_SHARDS hash shards to NEW_SHARDS equal ones (law: bytes), with the
    digests of the rewritten texts.

    A null id is hashed like any other value. Equal texts and repeated rows are rows of their own
    and may part. Each size is near total / 16 (see ``reshard``)."""
    old = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(OLD_SHARDS)).cast("int")
    out = transfer(documents(spark, sf_dir).select("doc_id", "text", old.alias("old_shard")), OLD_SHARDS, NEW_SHARDS)
    return out.select("doc_id", *digests(), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
