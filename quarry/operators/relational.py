"""Relational operators as small functions over DataFrames; Catalyst picks the physical plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quarry.functions.semantics import nulls_last

AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min, "GROUP_CONCAT": lambda c: F.listagg(c, F.lit(","))}
RANKS = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | Column | None = None, alias: str | None = None) -> DataFrame:
    """Parquet scan; the filter and the columns reach the reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns and columns != ["*"]:
        df = df.select(*columns)
    return df.alias(alias) if alias else df


def parallel_scan(df: DataFrame, workers: int | None = None) -> DataFrame:
    """The rows dealt evenly over so many partitions; without a number the scan's own splits stay, which grow with the input."""
    return df.repartition(workers) if workers else df


def gather(*parts: DataFrame) -> DataFrame:
    """All rows of the parts, by column name; nothing is moved to one task for it."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def materialize(df: DataFrame) -> DataFrame:
    """Rows that are computed once and replayed; what doesn't fit in memory goes to disk.  unpersist() of the result frees them."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: The optimizer's estimate of a side's size up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the optimizer's estimate of a result's size is within a limit."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def join(left: DataFrame, right: DataFrame, on: Column | str | list[str] | None = None, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Join by any condition; without one, the cross product.

    strategy: 'hash', 'merge', 'broadcast', 'index' (the right side's keys held by
    every task) or 'nested_loop' hints the right side; a side that is larger than
    BROADCAST_BYTES isn't broadcast.  None leaves the choice to statistics and
    adaptive execution.
    """
    hint = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast", "index": "broadcast", "nested_loop": "broadcast"}.get(strategy)
    if hint and (hint != "broadcast" or fits(right)):
        right = right.hint(hint)
    return left.crossJoin(right) if on is None else left.join(right, on, how)


def semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows with a partner (IN, EXISTS)."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows without a partner (NOT EXISTS)."""
    return left.join(right, on, "left_anti")


def group_by(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], having: str | Column | None = None) -> DataFrame:
    """Grouping with aggregates {alias: (function, column or '*')} and a filter on them; no keys: one row."""
    cols = [(F.count(F.lit(1)) if c == "*" else AGGREGATES[f.upper()](F.col(c))).alias(name) for name, (f, c) in aggregates.items()]
    out = df.groupBy(*keys).agg(*cols) if cols else df.select(*keys).distinct()
    return out if having is None else out.where(having)


def sort_case_insensitive(df: DataFrame, column: str, direction: str = "ASC") -> DataFrame:
    return df.orderBy(*nulls_last((F.lower(F.col(column)), direction), (column, direction)))


def union(*parts: DataFrame, distinct: bool = True) -> DataFrame:
    """Union by column name."""
    out = gather(*parts)
    return out.distinct() if distinct else out


def intersect(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b.select(*a.columns)), parts)


def except_(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Distinct rows of the first that are in none of the others."""
    return reduce(lambda a, b: a.subtract(b.select(*a.columns)), others, first)


def window(df: DataFrame, functions: dict[str, str], partition_by: list[str], order: list) -> DataFrame:
    """Ranking columns {alias: ROW_NUMBER, RANK or DENSE_RANK} over partitions."""
    w = Window.partitionBy(*partition_by).orderBy(*nulls_last(*order))
    return df.withColumns({name: RANKS[f.upper()]().over(w).cast("bigint") for name, f in functions.items()})
