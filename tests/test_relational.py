from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.plans import explain


def test_scan_prunes_and_filters(spark, sf):
    df = R.scan(spark, f"{sf}/orders.parquet", ["o_orderkey"], F.col("o_custkey") < 10, "o")
    assert df.select("o.o_orderkey").count() == spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey < 10").count()
    assert set(explain.read_columns(df)) == {"o_orderkey", "o_custkey"} and any("o_custkey" in f for f in explain.pushed_filters(df))


def test_case_insensitive_order_puts_nulls_last(spark):
    df = spark.createDataFrame([("b",), ("A",), (None,), ("a",), ("C",)], "s string")
    assert [r[0] for r in R.sort_case_insensitive(df, "s").collect()] == ["A", "a", "b", "C", None]
    assert [r[0] for r in R.sort_case_insensitive(df, "s", "DESC").collect()] == ["C", "b", "a", "A", None]


def test_group_concat_and_distinct_keys(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, s string")
    out = {r.k: r.names for r in R.group_by(df, ["k"], {"names": ("GROUP_CONCAT", "s")}).collect()}
    assert sorted(out[1].split(",")) == ["x", "y"] and out[2] is None
    assert R.group_by(df, ["k"], {}).count() == 2


def test_union_goes_by_name_and_keeps_or_drops_repeats(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([("x", 1)], "s string, k int")
    assert R.union(a, b).count() == 1 and R.union(a, b, distinct=False).count() == 2
    assert R.intersect(a, b).count() == 1 and R.except_(a, b).count() == 0


def test_outer_join_with_an_empty_side(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([], "j int")
    assert [tuple(r) for r in R.join(a, b, F.expr("k = j"), "left").collect()] == [(1, None)]
    assert R.join(a, b, F.expr("k = j")).count() == 0


def test_ties_rank_alike(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7)], "id int, v int").withColumn("p", F.lit(0))
    got = {r.id: (r.a, r.b, r.c) for r in R.window(df, {"a": "ROW_NUMBER", "b": "RANK", "c": "DENSE_RANK"}, ["p"], ["v", ("id", "DESC")]).collect()}
    assert got == {2: (1, 1, 1), 1: (2, 2, 2), 3: (3, 3, 3)}
    tied = {r.id: (r.b, r.c) for r in R.window(df, {"b": "RANK", "c": "DENSE_RANK"}, ["p"], ["v"]).collect()}
    assert tied == {1: (1, 1), 2: (1, 1), 3: (3, 2)}


def test_materialized_rows_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    df = R.materialize(spark.range(10).select(F.udf(seen, "long")("id").alias("v")))
    assert df.count() == 10 and df.agg(F.sum("v")).collect()[0][0] == 45
    assert calls.value == 10
    df.unpersist()
