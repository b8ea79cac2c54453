"""Where the engine's meaning differs from Spark's default, it is spelled out here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_div(a: Column | str, b: Column | str) -> Column:
    """True division; NULL where the divisor is 0 or either side is NULL."""
    return F.try_divide(_c(a), _c(b))


def order_by(df: DataFrame, *keys: tuple[str | Column, str] | str) -> DataFrame:
    """Sort by (column, 'ASC' or 'DESC') keys; NULLs come last in both directions."""
    return df.orderBy(*nulls_last(*keys))


def nulls_last(*keys: tuple[str | Column, str] | str) -> list[Column]:
    out = []
    for key in keys:
        c, direction = key if isinstance(key, tuple) else (key, "ASC")
        out.append(_c(c).desc_nulls_last() if direction.upper() == "DESC" else _c(c).asc_nulls_last())
    return out


def not_in(left: DataFrame, column: str, right: DataFrame, right_column: str) -> DataFrame:
    """SQL's three-valued NOT IN: a NULL on the right keeps nothing; a NULL on the left is not kept unless the right is empty.

    The right side's facts are two counts, which are joined as one row, so the
    plan stays an anti join on the key without a nested loop over rows.
    """
    values = right.select(F.col(right_column).alias("_v"))
    facts = values.agg(F.count("*").alias("_n"), F.count("_v").alias("_known"))
    rest = left.join(values.where("_v is not null").distinct(), F.col(column) == F.col("_v"), "left_anti")
    return rest.join(F.broadcast(facts)).where((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(column).isNotNull())).drop("_n", "_known")


def null_unsafe_not_in(left: DataFrame, column: str, right: DataFrame, right_column: str) -> DataFrame:
    """Two-valued NOT IN: NULLs match only NULLs, so one on the right blocks nothing else."""
    values = right.select(F.col(right_column).alias("_v")).distinct()
    return left.join(values, F.col(column).eqNullSafe(F.col("_v")), "left_anti")


def sum_or_zero(c: Column | str) -> Column:
    """SUM that is 0 over no values (SQL's own is NULL, which is the default elsewhere)."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def truthy(c: Column | str) -> Column:
    """A column as a predicate: non-zero, non-empty and not NULL; what reads as a number counts as that number."""
    text = _c(c).cast("string")
    return F.coalesce(text.try_cast("double") != 0, ~text.isin("", "false"), F.lit(False))


def aggregate_name(name: str) -> str:
    """The name that an aggregate column has in results: FUNC(column), COUNT(*)."""
    head, bracket, rest = name.partition("(")
    if not bracket or head.lower() not in ("count", "sum", "avg", "max", "min"):
        return name
    return f"{head.upper()}({'*' if head.lower() == 'count' and rest in ('1)', '*)') else rest[:-1]})"


def sql_like(pattern: str) -> str:
    """A LIKE pattern as a regular expression for names."""
    import re

    return "^" + "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern) + "$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
