"""Every query of the engine proper, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import semantics as S
from quarry.operators import relational as R
from quarry.operators import statistics as stats
from quarry.plans import nl2sql
from quarry.plans.engine import Engine, scratch
from quarry.session import table
from quarry.streaming.events import event_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of a table reader ``t`` (name to DataFrame) under its name, with its SQL."""

    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: table(spark, sf_dir, n))

        _QUERIES[key] = run
        if oracle:
            _ORACLES[key] = oracle
        return f

    return register


def engine_with(t, *tables: str) -> Engine:
    """A scratch engine that offers the driver's tables."""
    first = t(tables[0])
    e = scratch(first.sparkSession)
    for name in tables:
        e.attach(name, t(name))
    return e


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["flagship"](spark, sf_dir)


@query("SELECT c_mktsegment, count(*) AS n_orders, round(avg(o_totalprice), 2) AS avg_price FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING count(*) > 1", "flagship")
def _flagship(t):
    joined = R.join(t("customer"), t("orders").where("o_totalprice > 1000"), F.expr("c_custkey = o_custkey"))
    grouped = joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))
    return S.order_by(grouped.where("n_orders > 1"), ("avg_price", "DESC"))


# -- scans


@query("SELECT * FROM nation")
def scan_all(t):
    return t("nation")


@query("SELECT c_name, c_acctbal FROM customer")
def scan_project(t):
    return t("customer").select("c_name", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def scan_filtered(t):
    return t("customer").where("c_acctbal > 5000").select("c_custkey", "c_name")


@query("SELECT n.n_name, n.n_regionkey FROM nation AS n")
def scan_aliased(t):
    return t("nation").alias("n").select("n.n_name", "n.n_regionkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def scan_parallel(t):
    return R.parallel_scan(t("lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")
def gather_parts(t):
    o = t("orders")
    return R.gather(o.where("o_orderstatus = 'O'").select("o_orderkey"), o.where("o_orderstatus <> 'O'").select("o_orderkey"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))")
def materialize_reuse(t):
    per = R.materialize(t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    mean = per.agg(F.avg("n").alias("mean"))
    return per.join(F.broadcast(mean), F.col("n") >= F.col("mean")).drop("mean")


# -- predicates and expressions


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND p_retailprice > 100 AND p_retailprice <= 1500")
def filter_compare(t):
    return t("part").where((F.col("p_size") >= 10) & (F.col("p_size") < 40) & (F.col("p_retailprice") > 100) & (F.col("p_retailprice") <= 1500)).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000 AND c_nationkey < 10")
def filter_and_or_precedence(t):
    return t("customer").where("c_mktsegment = 'BUILDING' OR c_acctbal > 9000 AND c_nationkey < 10").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 9000) AND c_nationkey < 10")
def filter_parentheses(t):
    return t("customer").where("(c_mktsegment = 'BUILDING' OR c_acctbal > 9000) AND c_nationkey < 10").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_extendedprice - l_tax + 1 > 100000")
def filter_arith(t):
    return t("lineitem").where("l_quantity * l_extendedprice - l_tax + 1 > 100000").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def filter_not_equal(t):
    return t("orders").where(F.col("o_orderstatus") != "F").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in_list(t):
    return t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_not_in_list(t):
    return t("customer").where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 AND c_nationkey = 5)")
def filter_not(t):
    return t("customer").where(~((F.col("c_acctbal") > 0) & (F.col("c_nationkey") == 5))).select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey <> 0")
def filter_truthy(t):
    return t("nation").where(S.truthy("n_regionkey")).select("n_nationkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 25 AND nullif(p_size, 7) IS NOT NULL OR nullif(p_size, 9) IS NULL")
def pred_like_between_null(t):
    size = F.col("p_size")
    return t("part").where(F.col("p_name").like("%a%") & size.between(5, 25) & F.nullif(size, F.lit(7)).isNotNull() | F.nullif(size, F.lit(9)).isNull()).select("p_partkey")


@query("SELECT n_nationkey, n_nationkey / nullif(n_regionkey, 0) AS ratio FROM nation")
def expr_safe_divide(t):
    return t("nation").select("n_nationkey", S.safe_div("n_nationkey", "n_regionkey").alias("ratio"))


@query("SELECT n_nationkey, n_nationkey / nullif(n_regionkey, 0) AS ratio FROM nation WHERE n_regionkey / nullif(n_nationkey, 0) < 1")
def sql_safe_divide(t):
    return engine_with(t, "nation").query("SELECT n_nationkey, n_nationkey / n_regionkey AS ratio FROM nation WHERE n_regionkey / n_nationkey < 1")


@query("SELECT c_name AS customer_name, c_acctbal * 2 AS doubled FROM customer")
def project_alias(t):
    return t("customer").select(F.col("c_name").alias("customer_name"), (F.col("c_acctbal") * 2).alias("doubled"))


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS lo, CAST(length(c_name) AS INT) AS len, trim(c_mktsegment) AS trimmed, substring(c_name, 1, 4) AS head, concat(c_name, '-', c_mktsegment) AS both FROM customer")
def fn_string(t):
    n = F.col("c_name")
    return t("customer").select(
        "c_custkey", F.upper(n).alias("up"), F.lower(n).alias("lo"), F.length(n).alias("len"), F.trim("c_mktsegment").alias("trimmed"), F.substring(n, 1, 4).alias("head"), F.concat(n, F.lit("-"), "c_mktsegment").alias("both")
    )


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, strftime(o_orderdate, '%H:%M:%S') AS tm FROM orders")
def fn_datetime(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.to_date(d).cast("string").alias("dt"), F.date_format(d, "HH:mm:ss").alias("tm"))


@query("SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f FROM supplier")
def fn_math(t):
    b = F.col("s_acctbal")
    return t("supplier").select("s_suppkey", F.abs(b).alias("a"), F.round(b, 1).alias("r"), F.ceil(b).alias("c"), F.floor(b).alias("f"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, if(c_nationkey > 12, 1, 0) AS late FROM customer")
def fn_conditional(t):
    b = F.col("c_acctbal")
    return t("customer").select(
        "c_custkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment"), F.expr("if(c_nationkey > 12, 1, 0)").alias("late")
    )


# -- joins

_INNER = "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000"


def _orders_of_customers(t, **kw):
    return R.join(t("customer"), t("orders").where("o_totalprice > 200000"), F.expr("c_custkey = o_custkey"), **kw).select("c_name", "o_orderkey")


@query(_INNER)
def join_inner(t):
    return _orders_of_customers(t)


@query(_INNER)
def join_hash_hint(t):
    return _orders_of_customers(t, strategy="hash")


@query(_INNER)
def join_merge_hint(t):
    return _orders_of_customers(t, strategy="merge")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_broadcast_hint(t):
    return R.join(t("nation"), t("region"), F.expr("n_regionkey = r_regionkey"), strategy="broadcast").select("n_name", "r_name")


@query("SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_index_nested_loop(t):
    return R.join(t("customer"), t("nation"), F.expr("c_nationkey = n_nationkey"), strategy="index").select("c_custkey", "n_name")


@query("SELECT c_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey")
def join_left(t):
    return R.join(t("customer"), t("orders").where("o_totalprice > 400000"), F.expr("c_custkey = o_custkey"), "left").select("c_custkey", F.col("o_orderkey").cast("string").alias("o_orderkey"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 8000) c RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(t):
    return R.join(t("customer").where("c_acctbal > 8000"), t("orders"), F.expr("c_custkey = o_custkey"), "right").select(F.col("c_custkey").cast("string").alias("c_custkey"), "o_orderkey")


@query("SELECT n_name, r_name FROM nation, region")
def join_cross_no_on(t):
    return R.join(t("nation"), t("region")).select("n_name", "r_name")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def join_theta(t):
    return R.join(t("region").alias("a"), t("region").alias("b"), F.expr("a.r_regionkey < b.r_regionkey")).select(F.col("a.r_name").alias("a"), F.col("b.r_name").alias("b"))


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey AND s_acctbal > 100 * n_nationkey")
def join_nested_loop(t):
    return R.join(t("supplier"), t("nation"), F.expr("s_nationkey > n_nationkey AND s_acctbal > 100 * n_nationkey"), strategy="nested_loop").select("s_suppkey", "n_nationkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return R.join(a, b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_three_way(t):
    two = R.join(t("customer"), t("nation"), F.expr("c_nationkey = n_nationkey"))
    return R.join(two, t("region"), F.expr("n_regionkey = r_regionkey")).select("c_name", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def join_left_where(t):
    return R.join(t("customer"), t("orders"), F.expr("c_custkey = o_custkey"), "left").where("o_totalprice > 300000").select("c_custkey", "o_orderkey")


@query("SELECT c.c_custkey AS c_c_custkey, o.o_orderkey AS o_o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def join_qualified_names(t):
    c = t("customer").select(F.col("c_custkey").alias("c_c_custkey"))
    return c.join(t("orders").select(F.col("o_orderkey").alias("o_o_orderkey"), "o_custkey"), F.expr("c_c_custkey = o_custkey")).drop("o_custkey")


# -- semi joins, anti joins, subqueries


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_in_subquery(t):
    return R.semi(t("customer"), t("orders").where("o_totalprice > 300000"), F.expr("c_custkey = o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join_not_in(t):
    return S.not_in(t("customer"), "c_custkey", t("orders").where("o_totalprice > 300000"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE nullif(c_custkey, 3) NOT IN (SELECT nullif(o_custkey, 1) FROM orders WHERE o_totalprice > 300000 AND o_custkey <> 1)")
def anti_join_null_left(t):
    left = t("customer").select("c_custkey", F.nullif("c_custkey", F.lit(3)).alias("k"))
    return S.not_in(left, "k", t("orders").where("o_totalprice > 300000 AND o_custkey <> 1"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, o_custkey) FROM orders)")
def anti_join_null_aware(t):
    return S.not_in(t("customer"), "c_custkey", t("orders").select(F.nullif("o_custkey", "o_custkey").alias("k")), "k").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM (SELECT nullif(o_custkey, 4) AS k FROM orders WHERE o_totalprice > 250000) WHERE k IS NOT DISTINCT FROM c_custkey)")
def anti_join_two_valued(t):
    right = t("orders").where("o_totalprice > 250000").select(F.nullif("o_custkey", F.lit(4)).alias("k"))
    return S.null_unsafe_not_in(t("customer"), "c_custkey", right, "k").select("c_custkey")


@query("SELECT c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B') GROUP BY c_mktsegment")
def in_subquery_join_group(t):
    n = R.semi(t("nation"), t("region").where("r_name < 'B'"), F.expr("n_regionkey = r_regionkey"))
    return R.join(t("customer"), n, F.expr("c_nationkey = n_nationkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45)")
def exists_subquery(t):
    return R.semi(t("supplier"), t("lineitem").where("l_quantity > 45"), F.expr("l_suppkey = s_suppkey")).select("s_suppkey")


@query("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 15")
def derived_subquery(t):
    derived = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return derived.where("n > 15")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_nationkey NOT IN (1, 2)")
def sql_in_subquery(t):
    return engine_with(t, "customer", "orders").query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_nationkey NOT IN (1, 2)")


# -- aggregation


@query("SELECT count(*) AS n FROM lineitem")
def agg_count_star(t):
    return R.group_by(t("lineitem"), [], {"n": ("COUNT", "*")})


@query("SELECT count(nullif(l_returnflag, 'N')) AS n FROM lineitem")
def agg_count_col(t):
    return t("lineitem").agg(F.count(F.nullif("l_returnflag", F.lit("N"))).alias("n"))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag")
def agg_sum(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("total"))


@query("SELECT l_linestatus, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY l_linestatus")
def agg_avg(t):
    return t("lineitem").groupBy("l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("mean"))


@query("SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority")
def agg_min_max(t):
    return R.group_by(t("orders"), ["o_orderpriority"], {"low": ("MIN", "o_totalprice"), "high": ("MAX", "o_totalprice")})


@query("SELECT p_brand, min(p_name) AS first_name, max(p_name) AS last_name FROM part GROUP BY p_brand")
def agg_min_max_string(t):
    return R.group_by(t("part"), ["p_brand"], {"first_name": ("MIN", "p_name"), "last_name": ("MAX", "p_name")})


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer")
def agg_global(t):
    b = F.col("c_acctbal")
    return t("customer").agg(F.count("*").alias("n"), F.round(F.sum(b), 2).alias("total"), F.round(F.avg(b), 4).alias("mean"), F.min(b).alias("low"), F.max(b).alias("high"))


@query("SELECT count(*) AS n, sum(c_acctbal) AS total, avg(c_acctbal) AS mean, max(c_name) AS last FROM customer WHERE c_custkey < 0")
def agg_empty_input(t):
    return t("customer").where("c_custkey < 0").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total"), F.avg("c_acctbal").alias("mean"), F.max("c_name").alias("last"))


@query("SELECT n_regionkey, coalesce(sum(CASE WHEN n_nationkey > 20 THEN n_nationkey END), 0)::BIGINT AS total FROM nation GROUP BY n_regionkey")
def agg_sum_or_zero(t):
    return t("nation").groupBy("n_regionkey").agg(S.sum_or_zero(F.when(F.col("n_nationkey") > 20, F.col("n_nationkey"))).alias("total"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_group_concat(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


_HASHED = "SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_suppkey"


@query(_HASHED)
def agg_hash(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))


@query("SELECT l_suppkey, count(*) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY l_suppkey")
def agg_sort(t):
    # the greatest string has no fixed-size buffer: Spark sorts by the key and aggregates in order
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_multi_key(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def group_distinct_keys(t):
    return R.group_by(t("customer"), ["c_mktsegment", "c_nationkey"], {})


@query("SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY 1")
def group_null_key(t):
    return t("orders").groupBy(F.nullif("o_orderstatus", F.lit("F")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_simple(t):
    return R.group_by(t("orders"), ["o_custkey"], {"n": ("COUNT", "*")}, "n > 12")


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) < 400000 OR count(*) > 18")
def having_and_or(t):
    return R.group_by(t("orders"), ["o_custkey"], {"n": ("COUNT", "*"), "high": ("MAX", "o_totalprice")}, "n > 12 AND high < 400000 OR n > 18")


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def group_join_order(t):
    joined = R.join(R.join(t("customer"), t("orders"), F.expr("c_custkey = o_custkey")), t("nation"), F.expr("c_nationkey = n_nationkey"))
    return S.order_by(joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), ("total", "DESC"))


@query('SELECT o_orderstatus, count(*) AS "COUNT(*)", max(o_orderkey) AS "MAX(o_orderkey)" FROM orders GROUP BY o_orderstatus HAVING count(*) > 1')
def sql_aggregate_names(t):
    return engine_with(t, "orders").query("SELECT o_orderstatus, COUNT(*), MAX(o_orderkey) FROM orders GROUP BY o_orderstatus HAVING COUNT(*) > 1 ORDER BY o_orderstatus")


# -- order: a row number shows it


def _numbered(rows, *keys):
    """Rows with their position in an order, found by rank over the (few) rows of a report."""
    return R.window(rows.withColumn("_all", F.lit(1)), {"position": "ROW_NUMBER"}, ["_all"], list(keys)).drop("_all")


@query("SELECT *, row_number() OVER (ORDER BY n_regionkey ASC NULLS LAST, n_name DESC NULLS LAST) AS position FROM nation")
def order_multi(t):
    return _numbered(t("nation"), ("n_regionkey", "ASC"), ("n_name", "DESC"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_name DESC NULLS LAST) AS position FROM nation")
def order_desc_string(t):
    return _numbered(t("nation").select("n_name"), ("n_name", "DESC"))


@query("SELECT *, row_number() OVER (ORDER BY n DESC, c_mktsegment) AS position FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def order_by_agg(t):
    return _numbered(t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), ("n", "DESC"), "c_mktsegment")


@query("SELECT n_name, row_number() OVER (ORDER BY n_nationkey DESC) AS position FROM nation")
def order_unselected_col(t):
    return _numbered(t("nation"), ("n_nationkey", "DESC")).select("n_name", "position")


@query("SELECT n, row_number() OVER (ORDER BY lower(n), n) AS position FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n FROM nation)")
def order_case_insensitive(t):
    n = t("nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("n"))
    return _numbered(n, F.lower("n"), "n")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY nullif(n_regionkey, 2) DESC NULLS LAST, n_nationkey) AS position FROM nation")
def order_nulls_last(t):
    return _numbered(t("nation").withColumn("k", F.nullif("n_regionkey", F.lit(2))), ("k", "DESC"), "n_nationkey").select("n_nationkey", "position")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def order_top_k(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def order_external(t):
    # a range exchange and sorts that spill; the whole table comes out in order
    return S.order_by(t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", "l_orderkey", "l_linenumber")


# -- set operations


def _nation_keys(t):
    return t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").where("s_acctbal > 2000").select(F.col("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000")
def union_distinct(t):
    return R.union(*_nation_keys(t))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000")
def union_all(t):
    return R.union(*_nation_keys(t), distinct=False)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000")
def intersect(t):
    return R.intersect(*_nation_keys(t))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000", "except")
def _except(t):
    return R.except_(*_nation_keys(t))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def except_n_way(t):
    return R.except_(t("nation").select(F.col("n_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")), t("customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")))


# -- windows


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rn FROM customer")
def win_row_number(t):
    return R.window(t("customer"), {"rn": "ROW_NUMBER"}, ["c_nationkey"], [("c_acctbal", "DESC"), "c_custkey"]).select("c_custkey", "c_nationkey", "rn")


@query("SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk FROM part")
def win_rank(t):
    return R.window(t("part"), {"rk": "RANK"}, ["p_brand"], ["p_size"]).select("p_partkey", "p_brand", "rk")


@query("SELECT p_partkey, p_brand, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
def win_dense_rank(t):
    return R.window(t("part"), {"dr": "DENSE_RANK"}, ["p_brand"], ["p_size"]).select("p_partkey", "p_brand", "dr")


# -- views


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def view_simple(t):
    e = engine_with(t, "customer")
    e.execute("CREATE VIEW debtors AS SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
    return e.query("SELECT * FROM debtors")


@query("SELECT c_custkey AS id, c_name AS label FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3")
def view_column_list(t):
    e = engine_with(t, "customer")
    e.execute("CREATE OR REPLACE VIEW v (id, label) AS SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3 WITH CHECK OPTION")
    return e.query("SELECT id, label FROM v")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey")
def view_on_view(t):
    e = engine_with(t, "customer")
    e.run("CREATE VIEW debtors AS SELECT * FROM customer WHERE c_acctbal < 0; CREATE VIEW per_nation (c_nationkey, n) AS SELECT c_nationkey, COUNT(*) FROM debtors GROUP BY c_nationkey")
    return e.query("SELECT * FROM per_nation")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def matview_refresh(t):
    e = scratch(t("region").sparkSession)
    e.create_from("places", t("region").select("r_regionkey", "r_name"))
    e.run("CREATE MATERIALIZED VIEW mv AS SELECT * FROM places; INSERT INTO places VALUES (99, 'NOWHERE')")
    assert e.query("SELECT * FROM mv WHERE r_regionkey = 99").count() == 0  # as it was
    e.execute("REFRESH MATERIALIZED VIEW mv")
    return e.query("SELECT * FROM mv")


# -- DML and transactions: the table afterwards


def _with_nations(t) -> Engine:
    e = engine_with(t, "customer", "supplier")
    e.create_from("places", t("nation"))
    return e


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', '1' UNION ALL SELECT 101, 'MU', NULL")
def dml_insert(t):
    e = _with_nations(t)
    e.run("INSERT INTO places VALUES (100, 'ATLANTIS', 1); INSERT INTO places (n_name, n_nationkey) VALUES ('MU', 101)")
    return e.query("SELECT n_nationkey, n_name, CAST(n_regionkey AS STRING) AS n_regionkey FROM places")


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def dml_insert_select(t):
    e = _with_nations(t)
    e.execute("INSERT INTO places SELECT n_nationkey + 100, n_name, n_regionkey FROM places WHERE n_regionkey = 2")
    return e.query("SELECT * FROM places")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN concat(n_name, '!') ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_regionkey * 10 + n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation")
def dml_update_expr(t):
    e = _with_nations(t)
    e.execute("UPDATE places SET n_regionkey = n_regionkey * 10 + n_nationkey, n_name = concat(n_name, '!') WHERE n_regionkey = 1")
    return e.query("SELECT * FROM places")


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) THEN 'RICH' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update_in_subquery(t):
    e = _with_nations(t)
    e.execute("UPDATE places SET n_name = 'RICH' WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
    return e.query("SELECT * FROM places")


@query("SELECT * FROM nation WHERE NOT (n_regionkey = 3 OR n_name < 'C')")
def dml_delete(t):
    e = _with_nations(t)
    e.execute("DELETE FROM places WHERE n_regionkey = 3 OR n_name < 'C'")
    return e.query("SELECT * FROM places")


@query("SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def dml_delete_not_in(t):
    e = _with_nations(t)
    e.execute("DELETE FROM places WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
    return e.query("SELECT * FROM places")


@query("SELECT * FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 200, 'LEMURIA', 4")
def txn_commit(t):
    e = _with_nations(t)
    e.run("BEGIN ISOLATION LEVEL SERIALIZABLE; DELETE FROM places WHERE n_regionkey = 0; INSERT INTO places VALUES (200, 'LEMURIA', 4); COMMIT")
    return e.query("SELECT * FROM places")


@query("SELECT * FROM nation")
def txn_rollback(t):
    e = _with_nations(t)
    e.run("START TRANSACTION; DELETE FROM places; INSERT INTO places VALUES (200, 'LEMURIA', 4); ROLLBACK WORK")
    return e.query("SELECT * FROM places")


@query("SELECT * FROM nation WHERE n_regionkey <> 0")
def txn_savepoint_rollback(t):
    e = _with_nations(t)
    e.run("BEGIN; DELETE FROM places WHERE n_regionkey = 0; SAVEPOINT a; UPDATE places SET n_name = 'X'; ROLLBACK TO SAVEPOINT a; RELEASE SAVEPOINT a; COMMIT")
    return e.query("SELECT * FROM places")


@query("SELECT count(*) AS n FROM nation")
def txn_read_only(t):
    e = _with_nations(t)
    e.execute("BEGIN READ ONLY")
    try:
        e.execute("DELETE FROM places")
    except Exception as x:  # noqa: BLE001, this is the expected refusal
        assert "read only" in str(x)
    out = e.query("SELECT COUNT(*) AS n FROM places")
    e.execute("COMMIT")
    return out


# -- indexes and introspection


def _indexed(t) -> Engine:
    e = scratch(t("orders").sparkSession)
    e.create_from("sales", t("orders"))
    e.run("CREATE UNIQUE INDEX by_key ON sales (o_orderkey); CREATE INDEX by_customer ON sales (o_custkey, o_orderdate) BTREE")
    return e


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 100")
def index_lookup(t):
    return _indexed(t).index_scan("by_key", F.col("o_orderkey") == 100, ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 50 AND 150")
def index_range(t):
    return _indexed(t).index_scan("by_key", F.col("o_orderkey").between(50, 150), ["o_orderkey", "o_totalprice"])


@query("SELECT o_custkey, o_orderdate FROM orders WHERE o_custkey < 20")
def index_covering(t):
    e = _indexed(t)
    assert e.is_covering("by_customer", ["o_custkey", "o_orderdate"])
    return e.index_scan(e.best_index("sales", ["o_custkey"]), "o_custkey < 20", ["o_custkey", "o_orderdate"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_custkey < 30 OR o_orderkey = 1")
def index_bitmap_and(t):
    return _indexed(t).index_scan("by_key", "o_orderkey > 100 AND o_custkey < 30 OR o_orderkey = 1", ["o_orderkey"])


@query("SELECT 'sales' AS \"Table\", 'by_customer' AS \"Index_name\", 'o_custkey, o_orderdate' AS \"Columns\", false AS \"Unique\", 'BTREE' AS \"Index_type\" UNION ALL SELECT 'sales', 'by_key', 'o_orderkey', true, 'BTREE'")
def show_indexes(t):
    return _indexed(t).execute("SHOW INDEXES FROM sales")


@query("SELECT 'a_view' AS view_name, false AS materialized, 'SELECT n_name FROM nation' AS definition")
def show_views_like(t):
    e = engine_with(t, "nation")
    e.run("CREATE VIEW a_view AS SELECT n_name FROM nation; CREATE VIEW b_view AS SELECT n_name FROM nation; CREATE VIEW ab AS SELECT n_name FROM nation; DROP VIEW IF EXISTS ab, absent")
    return e.execute("SHOW VIEWS LIKE 'a%'")


@query("SELECT 'places' AS table_name UNION ALL SELECT 'customer' UNION ALL SELECT 'supplier'")
def show_tables(t):
    return _with_nations(t).execute("SHOW TABLES")


@query("SELECT 'n' AS column_name, 'STRING' AS data_type, true AS nullable UNION ALL SELECT 'k', 'INT', true")
def describe_view(t):
    e = engine_with(t, "nation")
    e.execute("CREATE VIEW v (n, k) AS SELECT n_name, n_regionkey FROM nation")
    return e.execute("DESCRIBE VIEW v")


@query("SELECT 'id' AS column_name, 'INT' AS data_type, true AS nullable UNION ALL SELECT 'name', 'VARCHAR(20)', true UNION ALL SELECT 'code', 'CHAR(3)', true UNION ALL SELECT 'score', 'FLOAT', true UNION ALL SELECT 'ok', 'BOOLEAN', true UNION ALL SELECT 'price', 'DECIMAL(10,2)', true")
def describe_table(t):
    e = scratch(t("region").sparkSession)
    e.execute("CREATE TABLE typed (id INT, name VARCHAR(20), code CHAR(3), score FLOAT, ok BOOLEAN, price DECIMAL(10, 2))")
    return e.execute("DESCRIBE TABLE typed")


@query("SELECT CAST(1 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS views, CAST(2 AS BIGINT) AS indexes")
def catalog_counts(t):
    e = _indexed(t)
    e.execute("CREATE VIEW v AS SELECT o_orderkey FROM sales")
    return e.catalog_stats()


@query("SELECT 'Table a created' AS message, 1 AS step UNION ALL SELECT '2 rows inserted', 2 UNION ALL SELECT '1 rows updated', 3 UNION ALL SELECT 'Index i created', 4 UNION ALL SELECT 'Index i dropped', 5 UNION ALL SELECT '1 rows deleted', 6 UNION ALL SELECT 'Table a dropped', 7 UNION ALL SELECT 'No table a', 8")
def messages(t):
    e = scratch(t("region").sparkSession)
    said = e.run("CREATE TABLE a (k INT); INSERT INTO a VALUES (1), (2); UPDATE a SET k = 3 WHERE k = 1; CREATE INDEX i ON a (k); DROP INDEX i; DELETE FROM a WHERE k = 2; DROP TABLE a; DROP TABLE IF EXISTS a")
    return e._rows("message string, step int", [(x, i + 1) for i, x in enumerate(said)])


@query("SELECT n_nationkey, n_name, n_regionkey * 2 AS region, 'new' AS note FROM nation")
def alter_table(t):
    e = _with_nations(t)
    e.run("ALTER TABLE places ADD COLUMN note VARCHAR(10); ALTER TABLE places RENAME COLUMN n_regionkey TO region; UPDATE places SET note = 'new', region = region * 2; ALTER TABLE places RENAME TO spots")
    return e.query("SELECT * FROM spots")


@query("SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def alter_drop_and_retype(t):
    e = _with_nations(t)
    e.run("ALTER TABLE places DROP COLUMN n_name; ALTER TABLE places ALTER COLUMN n_regionkey TYPE BIGINT")
    return e.query("SELECT * FROM places")


@query("SELECT count(*) AS seen FROM nation WHERE n_regionkey <> 0")
def isolation_read_committed(t):
    e = _with_nations(t)
    other = Engine(e.spark, e.store.root)
    e.execute("BEGIN ISOLATION LEVEL READ COMMITTED")
    other.execute("DELETE FROM places WHERE n_regionkey = 0")
    e.execute("SELECT COUNT(*) FROM places")
    out = e.execute("SELECT COUNT(*) AS seen FROM places")
    e.execute("COMMIT")
    return out


@query("SELECT count(*) AS seen FROM nation")
def isolation_repeatable_read(t):
    e = _with_nations(t)
    other = Engine(e.spark, e.store.root)
    e.execute("BEGIN ISOLATION LEVEL REPEATABLE READ")
    other.execute("DELETE FROM places WHERE n_regionkey = 0")
    out = e.execute("SELECT COUNT(*) AS seen FROM places")
    e.execute("COMMIT")
    return out


@query("SELECT 'duplicate key in unique index u' AS error UNION ALL SELECT 'name: a string is longer than 3' UNION ALL SELECT 'id: a string can''t be stored as INT' UNION ALL SELECT 'no table absent' UNION ALL SELECT 'HAVING needs GROUP BY'")
def rejected_statements(t):
    e = scratch(t("region").sparkSession)
    e.run("CREATE TABLE a (id INT, name VARCHAR(3)); CREATE UNIQUE INDEX u ON a (id); INSERT INTO a VALUES (1, 'x')")
    said = []
    for sql in ("INSERT INTO a VALUES (1, 'y')", "INSERT INTO a VALUES (2, 'long')", "INSERT INTO a VALUES ('z', 'y')", "DELETE FROM absent", "SELECT id FROM a HAVING COUNT(*) > 0"):
        try:
            e.execute(sql)
        except Exception as x:  # noqa: BLE001, the refusals are the result
            known = ("duplicate key in unique index u", "name: a string is longer than 3", "id: a string can't be stored as INT", "no table absent", "HAVING needs GROUP BY")
            said.append((next((k for k in known if k in str(x)), str(x)[:80]),))
    return e._rows("error string", said)


@query("SELECT 'UNRESOLVED_COLUMN' AS error, 1 AS k UNION ALL SELECT 'PARSE_SYNTAX_ERROR', 2 UNION ALL SELECT 'none', 3")
def validate_statements(t):
    e = engine_with(t, "nation")
    said = [e.validate(sql) for sql in ("SELECT nope FROM nation", "SELEC 1", "SELECT n_name FROM nation;")]
    return e._rows("error string, k int", [(x.split("]")[0].split(".")[0].lstrip("[") if x else "none", i + 1) for i, x in enumerate(said)])


@query("SELECT 'n_name' AS column_name, 'STRING' AS data_type UNION ALL SELECT 'n_nationkey', 'INT' UNION ALL SELECT 'n_regionkey', 'INT'")
def table_columns(t):
    e = _with_nations(t)
    assert e.has_column("places", "N_NAME") and not e.has_column("places", "nope") and e.tables() == ["places"]
    return e._rows("column_name string, data_type string", sorted(e.columns("places").items()))


@query("SELECT 'CREATE TABLE a (' AS line, 1 AS n UNION ALL SELECT 'id INT,', 2 UNION ALL SELECT 'name VARCHAR(9)', 3 UNION ALL SELECT ');', 4")
def schema_export(t):
    e = scratch(t("region").sparkSession)
    e.execute("CREATE TABLE a (id INT, name VARCHAR(9))")
    assert e.validate_catalog() == [] and e.repair_catalog() == []
    return e._rows("line string, n int", [(x.strip(), i + 1) for i, x in enumerate(e.export_schema().splitlines())])


@query("SELECT 'by_customer' AS best, 'by_customer' AS any_of UNION ALL SELECT 'by_key', 'by_key'")
def index_choice(t):
    e = _indexed(t)
    return e._rows("best string, any_of string", [(e.best_index("sales", [c]), ",".join(e.indexes_for("sales", [c]))) for c in ("o_orderdate", "o_orderkey")])


@query("SELECT count(*) AS row_count, count(DISTINCT o_orderkey) AS distinct_keys, CAST(0 AS BIGINT) AS null_keys FROM orders")
def index_statistics(t):
    return _indexed(t).index_stats("by_key")


@query("SELECT 'a' AS used, 'b' AS by_view UNION ALL SELECT 'places', 'a' UNION ALL SELECT 'places', 'b'")
def view_dependents(t):
    e = _with_nations(t)
    e.run("CREATE VIEW a AS SELECT n_name FROM places; CREATE VIEW b AS SELECT n_name FROM a")
    return e._rows("used string, by_view string", [(x, v) for x in ("a", "places") for v in e.dependents(x)])


@query("SELECT n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'two'")
def run_script(t):
    e = _with_nations(t)
    return R.gather(e.run("SELECT n_name FROM places WHERE n_regionkey = 1; -- a comment; not a statement\nSELECT 'two' AS n_name;")[0], e.query("SELECT 'two' AS n_name"))


@query("SELECT * FROM nation WHERE n_regionkey <> 2")
def txn_block(t):
    e = _with_nations(t)
    with e.transaction():
        e.execute("DELETE FROM places WHERE n_regionkey = 2")
    try:
        e.run_atomically(["DELETE FROM places", "INSERT INTO absent VALUES (1)"])
    except Exception as x:  # noqa: BLE001, all or nothing
        assert "absent" in str(x)
    return e.query("SELECT * FROM places")


@query("SELECT n_nationkey, n_nationkey / nullif(CASE WHEN n_regionkey = 0 THEN 0 ELSE n_regionkey END, 0) AS a, 10 / nullif(n_regionkey, 0) AS b FROM nation")
def sql_divide_case(t):
    return engine_with(t, "nation").query("SELECT n_nationkey, n_nationkey / CASE WHEN n_regionkey = 0 THEN 0 ELSE n_regionkey END AS a, 10 / array(n_regionkey)[0] AS b /* x/0 */ FROM nation -- 1/0")


@query("SELECT s_suppkey FROM supplier WHERE round(s_acctbal / 1000) <> 0")
def truthy_decimal(t):
    return t("supplier").where(S.truthy(F.round(F.col("s_acctbal") / 1000).cast("decimal(12,2)"))).select("s_suppkey")


@query("SELECT n_nationkey FROM nation ORDER BY nullif(n_regionkey, 4) DESC NULLS LAST, n_nationkey LIMIT 3")
def nulls_last_subquery(t):
    return engine_with(t, "nation").query("SELECT n_nationkey FROM (SELECT n_nationkey FROM nation ORDER BY nullif(n_regionkey, 4) DESC, n_nationkey LIMIT 3) x")


@query("SELECT n_name FROM nation WHERE now() > TIMESTAMP '2020-01-01 00:00:00'")
def fn_now(t):
    return engine_with(t, "nation").query("SELECT n_name FROM nation WHERE now() > TIMESTAMP '2020-01-01 00:00:00'")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def order_redundant(t):
    # neither sort has an effect on the groups: the optimizer takes both out
    return S.order_by(S.order_by(t("nation"), "n_name"), ("n_regionkey", "DESC")).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 50 AND 90 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey = 200")
def index_maintained(t):
    e = _indexed(t)
    e.run("DELETE FROM sales WHERE o_orderkey = 200; DROP INDEX by_customer")
    e.attach("extra", t("orders").where("o_orderkey = 200"))
    e.execute("INSERT INTO sales SELECT * FROM extra")
    return e.index_scan("by_key", "o_orderkey BETWEEN 50 AND 90 OR o_orderkey = 200", ["o_orderkey"])


@query("SELECT greatest(n_nationkey, n_regionkey) AS most, least(n_nationkey, n_regionkey) AS low FROM nation")
def row_level_max(t):
    return t("nation").select(F.greatest("n_nationkey", "n_regionkey").alias("most"), F.least("n_nationkey", "n_regionkey").alias("low"))


# -- statistics


@query("SELECT 'c_custkey' AS column_name, CAST(min(c_custkey) AS VARCHAR) AS min_value, CAST(max(c_custkey) AS VARCHAR) AS max_value FROM customer")
def stats_numeric_minmax(t):
    return stats.column_stats(t("customer"), ["c_custkey"]).select("column_name", "min_value", "max_value")


@query("SELECT count(*) AS row_count FROM orders")
def stats_table(t):
    return t("orders").agg(F.count("*").alias("row_count"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({v}) AS null_count, count(DISTINCT {v}) AS ndv, CAST(min({v}) AS VARCHAR) AS min_value, CAST(max({v}) AS VARCHAR) AS max_value, round(avg(length(CAST({v} AS VARCHAR))), 4) AS avg_length FROM customer"
        for c, v in (("c_custkey", "c_custkey"), ("c_nationkey", "c_nationkey"), ("c_mktsegment", "nullif(c_mktsegment, 'BUILDING')"))
    )
)
def stats_column_ndv(t):
    return stats.column_stats(t("customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))), ["c_custkey", "c_nationkey", "c_mktsegment"])


@query(
    "WITH v AS (SELECT p_size AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT v, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT count(p_size) FROM part) AS total FROM v) "
    "SELECT CAST(floor(before * 10 / total) + 1 AS BIGINT) AS bucket, min(v) AS low, max(v) AS high, CAST(sum(n) AS BIGINT) AS row_count FROM r GROUP BY 1"
)
def stats_histogram(t):
    return stats.histogram(t("part"), "p_size")


@query("SELECT p_brand AS value, count(*) AS frequency FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def stats_top_values(t):
    return stats.top_values(t("part"), "p_brand")


@query("SELECT 1.0::DOUBLE / greatest((SELECT count(DISTINCT c_custkey) FROM customer), (SELECT count(DISTINCT o_custkey) FROM orders)) AS selectivity")
def stats_join_selectivity(t):
    return stats.join_selectivity(t("customer"), "c_custkey", t("orders"), "o_custkey").select(F.col("selectivity").cast("double").alias("selectivity"))


# -- natural language


def _asked(t, question: str) -> DataFrame:
    e = engine_with(t, "customer", "nation")
    return e.query(nl2sql.translate(question, {"customer": t("customer").columns, "nation": t("nation").columns}).sql)


@query("SELECT * FROM nation")
def nl_select_all(t):
    return _asked(t, "show all nation")


@query('SELECT count(*) AS "COUNT(*)" FROM customer')
def nl_count(t):
    return _asked(t, "how many customer are there")


@query('SELECT c_mktsegment, avg(c_acctbal) AS "AVG(c_acctbal)" FROM customer GROUP BY c_mktsegment', "nl_group")
def _nl_group(t):
    return _asked(t, "average c_acctbal of customer by c_mktsegment")


@query("SELECT * FROM nation WHERE n_regionkey > 3")
def nl_condition(t):
    return _asked(t, "查询 nation 中 n_regionkey 大于 3 的所有记录")


# -- streaming (an extension): the same function serves the batch


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_event_counts(t):
    return event_counts(t("events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


