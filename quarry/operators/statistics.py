"""Table and column statistics, each a few aggregations over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: rows, nulls, distinct values, least, greatest (in the column's own order, as text), mean length; two passes and one shuffle."""
    columns = columns or df.columns
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    each = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    counted = each.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("v").alias("ndv"),
        F.round(F.sum(F.length("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), 4).alias("avg_length"),
    )
    ends = df.agg(*(f(c).cast("string").alias(f"{name}_{i}") for i, c in enumerate(columns) for f, name in ((F.min, "least"), (F.max, "most"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"least_{i}").alias("min_value"), F.col(f"most_{i}").alias("max_value")) for i, c in enumerate(columns)))
    ends = ends.select(F.explode(rows).alias("x")).select("x.*")
    return counted.join(ends, "column_name").select("column_name", "row_count", "null_count", "ndv", "min_value", "max_value", "avg_length")


def histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Equi-depth histogram: bucket, least, greatest, rows; equal values share a bucket.

    Values are counted first, so only distinct values are ordered.  Their running
    counts come from ranges: each is summed on its own and the ranges' sums, few,
    are added up; no task sees all values.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranged = values.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()).persist()
    sums = ranged.groupBy("part").agg(F.sum("n").alias("words"))
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    total = values.agg(F.sum("n").alias("total"))
    running = ranged.join(F.broadcast(before), "part").join(F.broadcast(total))
    first = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = running.withColumn("bucket", F.floor(first * buckets / F.col("total")).cast("bigint") + 1)
    return placed.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("row_count"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("frequency"))
    return counted.orderBy(F.desc("frequency"), "value").limit(k)


def join_selectivity(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """The textbook estimate of an equi-join's selectivity: one over the larger number of distinct values."""
    n, m = (df.agg(F.countDistinct(c).alias("ndv")) for df, c in ((left, a), (right, b)))
    both = n.unionByName(m).agg(F.max("ndv").alias("ndv"))
    return both.select(F.when(F.col("ndv") > 0, F.lit(1.0) / F.col("ndv")).alias("selectivity"))
