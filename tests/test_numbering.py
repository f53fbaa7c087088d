"""Numbers in a total order, dealt over tasks."""

from pyspark.sql import functions as F

from lexiforge.operators.numbering import numbered, numbered_within


def sizes(df):
    return [r[0] for r in df.groupBy(F.input_file_name()).count().select("count").collect()]


def test_equal_rows_are_spread(spark):
    out = numbered(spark.range(40_000).select(F.lit(1).alias("k")), ["k"], rows=10_000)
    assert [r.number for r in out.select("number").orderBy("number").collect()] == list(range(40_000))
    assert max(sizes(out)) < 20_000


def test_order_with_nulls_and_directions(spark):
    rows = [(None, 1), ("b", None), ("a", 2), ("a", 3), ("b", 1)]
    out = numbered(spark.createDataFrame(rows, "k string, v int"), [F.asc_nulls_last("k"), F.desc_nulls_first("v")], "n")
    assert [(r.k, r.v) for r in out.orderBy("n").collect()] == [("a", 3), ("a", 2), ("b", None), ("b", 1), (None, 1)]
    assert numbered(spark.range(0), ["id"]).count() == 0


def test_within_one_group_of_all_rows(spark):
    df = spark.range(30_000).select((F.col("id") % 10_007).alias("v"), F.when(F.col("id") == 5, "y").otherwise("x").alias("g"))
    out = numbered_within(df, ["g"], ["v"], rows=5_000)
    got = [(r.g, r.number) for r in out.orderBy("g", "number").collect()]
    assert got == [("x", i) for i in range(29_999)] + [("y", 0)]
    assert max(sizes(numbered(df, ["g", "v"], rows=5_000))) < 10_000
