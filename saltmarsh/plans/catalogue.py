"""The registered queries: one for each operator, beside the same result in SQL.

Sums of money are exact (decimals, then double), averages are rounded, and all orders before a limit are total, so
that both engines give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions.scalar import like
from saltmarsh.functions.transforms import PartitionField, transform
from saltmarsh.operators import kv
from saltmarsh.operators import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None, name: str | None = None):
    def keep(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[key] = sql
        return f

    return keep


def simple(name: str, sql: str, build: Callable) -> None:
    register(sql, name)(build)


def money(c: Column | str) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def _money(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


col, lit = F.col, F.lit

# Scans and projections
simple("scan_all_nation", "SELECT * FROM nation", lambda t: t("nation"))
simple("scan_prune_orders", "SELECT o_orderkey, o_orderstatus FROM orders", lambda t: t("orders").select("o_orderkey", "o_orderstatus"))
simple("scan_empty_result", "SELECT * FROM region WHERE r_regionkey < 0", lambda t: t("region").where("r_regionkey < 0"))
simple("project_order", "SELECT c_name, c_custkey FROM customer", lambda t: t("customer").select("c_name", "c_custkey"))
simple(
    "project_computed",
    "SELECT o_orderkey, o_totalprice * 2 AS twice, o_custkey + 1 AS next_cust, 7 AS seven FROM orders",
    lambda t: t("orders").select("o_orderkey", (col("o_totalprice") * 2).alias("twice"), (col("o_custkey") + 1).alias("next_cust"), lit(7).alias("seven")),
)
simple(
    "project_alias",
    "SELECT s_suppkey AS id, s_name AS supplier FROM supplier",
    lambda t: t("supplier").select(col("s_suppkey").alias("id"), col("s_name").alias("supplier")),
)
simple(
    "project_aggregate_name",
    "SELECT COUNT(*) AS count, MAX(p_size) AS max_p_size FROM part",
    lambda t: R.aggregate(t("part"), [], [("count", "*"), ("max", "p_size")]).select("count", "max_p_size"),
)
simple(
    "concat_batches",
    "SELECT * FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT * FROM supplier WHERE s_acctbal >= 0",
    lambda t: R.concat(t("supplier").where("s_acctbal < 0"), t("supplier").where("s_acctbal >= 0")),
)
simple(
    "page_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100",
    lambda t: R.limit(R.order(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey"), 25, 100),
)
simple(
    "distinct_rows",
    "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    lambda t: t("orders").select("o_orderstatus", "o_orderpriority").distinct(),
)

# Comparisons of a column with a literal, for each type
OPS = {"gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "=", "ne": "<>"}
FILTERS = {
    "int": ("part", "p_size", "25", "p_partkey, p_size"), "bigint": ("orders", "o_custkey", "700", "o_orderkey, o_custkey"),
    "double": ("lineitem", "l_quantity", "25.0", "l_orderkey, l_quantity"), "string": ("orders", "o_orderpriority", "'3-MEDIUM'", "o_orderkey, o_orderpriority"),
}
for _kind, (_table, _column, _literal, _out) in FILTERS.items():
    for _op, _sign in OPS.items():
        _where = f"{_column} {_sign} {_literal}"
        simple(f"filter_{_op}_{_kind}", f"SELECT {_out} FROM {_table} WHERE {_where}", lambda t, n=_table, w=_where, o=_out: t(n).where(w).select(*o.split(", ")))
simple(
    "filter_timestamp",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'",
    lambda t: t("orders").where("o_orderdate >= TIMESTAMP_NTZ'1995-01-01 00:00:00'").select("o_orderkey", "o_orderdate"),
)
simple(
    "filter_and",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'",
    lambda t: t("orders").where((col("o_totalprice") > 1000) & (col("o_orderstatus") == "O")).select("o_orderkey"),
)
simple(
    "filter_or",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR o_orderstatus = 'P'",
    lambda t: t("orders").where((col("o_totalprice") > 400000) | (col("o_orderstatus") == "P")).select("o_orderkey"),
)
simple("filter_not", "SELECT n_name FROM nation WHERE NOT (n_regionkey = 1)", lambda t: t("nation").where(~(col("n_regionkey") == 1)).select("n_name"))
simple(
    "filter_between_in",
    "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')",
    lambda t: t("part").where(col("p_size").between(5, 9) & col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select("p_partkey"),
)
simple(
    "filter_like_pct",
    "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1%'",
    lambda t: t("customer").where(like(col("c_name"), "%1%")).select("c_custkey", "c_name"),
)
simple(
    "filter_like_underscore",
    "SELECT n_name FROM nation WHERE n_name LIKE '_A%_N%1_'",
    lambda t: t("nation").where(like(col("n_name"), "_A%_N%1_")).select("n_name"),
)
simple(
    "filter_arith",
    "SELECT o_orderkey FROM orders WHERE o_totalprice / 2 - 100 > 50000 + 1",
    lambda t: t("orders").where(col("o_totalprice") / 2 - 100 > lit(50000) + 1).select("o_orderkey"),
)
simple(
    "filter_col_col",
    "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey < l_linenumber",
    lambda t: t("lineitem").where(col("l_suppkey") < col("l_linenumber")).select("l_orderkey", "l_linenumber", "l_suppkey"),
)
simple("filter_lit_col", "SELECT p_partkey FROM part WHERE 10 > p_size", lambda t: t("part").where(lit(10) > col("p_size")).select("p_partkey"))
simple(
    "filter_null_dropped",
    "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'O') <> 'F'",
    lambda t: t("orders").where("NULLIF(o_orderstatus, 'O') <> 'F'").select("o_orderkey"),
)
simple(
    "filter_is_null",
    "SELECT COUNT(*) AS n FROM orders WHERE NULLIF(o_orderstatus, 'O') IS NULL",
    lambda t: t("orders").where(F.nullif(col("o_orderstatus"), lit("O")).isNull()).agg(F.count("*").alias("n")),
)

# Joins
simple(
    "join_inner",
    "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE "
    "o_totalprice > 300000",
    lambda t: R.join(t("customer"), t("orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey", "c_name", "o_orderkey", "o_totalprice"),
)


def _keyed(t) -> tuple[DataFrame, DataFrame]:
    return t("nation").select(col("n_nationkey").alias("id"), col("n_name").alias("name"), col("n_regionkey").alias("region")), t("supplier").select(col("s_nationkey").alias("id"), col("s_name").alias("name"), col("s_acctbal").alias("balance"))


simple(
    "join_same_key_name",
    "SELECT n_nationkey AS id, n_name AS name, s_suppkey AS supplier FROM nation JOIN supplier ON n_nationkey = s_nationkey",
    lambda t: R.join(_keyed(t)[0].drop("region"), t("supplier").select(col("s_nationkey").alias("id"), col("s_suppkey").alias("supplier")), "id", "id"),
)
simple(
    "join_name_collision",
    "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, s_name AS right_name, s_acctbal AS balance FROM nation "
    "JOIN supplier ON n_nationkey = s_nationkey",
    lambda t: R.join(*_keyed(t), "id", "id"),
)
simple(
    "join_dup_keys",
    "SELECT a.n_name AS left_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    lambda t: R.join(t("nation").select("n_regionkey", col("n_name").alias("left_name")), t("nation").select("n_regionkey", col("n_name").alias("other")), "n_regionkey", "n_regionkey").drop("n_regionkey"),
)
simple(
    "join_null_keys",
    "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON NULLIF(a.n_nationkey, 3) = NULLIF(b.n_nationkey, 5)",
    lambda t: R.join(t("nation").selectExpr("NULLIF(n_nationkey, 3) ka", "n_name a_name"), t("nation").selectExpr("NULLIF(n_nationkey, 5) kb", "n_name b_name"), "ka", "kb").select("a_name", "b_name"),
)
simple(
    "join_no_match",
    "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey + 100",
    lambda t: R.join(t("nation"), t("region").withColumn("k", col("r_regionkey") + 100), "n_regionkey", "k").select("n_name", "r_name"),
)
simple(
    "join_three_way",
    f"SELECT r_name, COUNT(*) AS n, {_money('o_totalprice')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    lambda t: t("orders").select("o_custkey", "o_totalprice").join(t("customer").select("c_custkey", "c_nationkey"), col("o_custkey") == col("c_custkey")).join(t("nation"), col("c_nationkey") == col("n_nationkey")).join(t("region"), col("n_regionkey") == col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"), money("o_totalprice").alias("revenue")),
)
for _how, _word in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL OUTER")):
    _sql = f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c {_word} JOIN (SELECT * FROM orders WHERE o_custkey % 2 = 0) o ON c_custkey = o_custkey"
    simple(f"join_{_how}", _sql, lambda t, h=_how: R.join(t("customer").where("c_custkey % 3 <> 0"), t("orders").where("o_custkey % 2 = 0"), "c_custkey", "o_custkey", h).select("c_custkey", "o_orderkey"))
simple("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", lambda t: t("region").select("r_name").crossJoin(t("nation").select("n_name")))
simple(
    "join_multi_key",
    "SELECT COUNT(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > "
    "25) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    lambda t: t("lineitem").select("l_orderkey", "l_linenumber").join(t("lineitem").where("l_quantity > 25").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n")),
)
simple(
    "join_non_equi",
    "SELECT a.n_name AS a_name, b.r_name AS b_name FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5",
    lambda t: R.theta_join(t("nation"), t("region"), col("n_nationkey") > col("r_regionkey") * 5).select(col("n_name").alias("a_name"), col("r_name").alias("b_name")),
)
simple(
    "join_filter_pushdown",
    "SELECT COUNT(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000 AND o_totalprice > 100000",
    lambda t: R.join(t("customer"), t("orders"), "c_custkey", "o_custkey", "left").where("c_acctbal > 5000 AND o_totalprice > 100000").agg(F.count("*").alias("n")),
)
simple(
    "join_string_key",
    "SELECT a.c_custkey AS c_custkey, b.n AS n FROM customer a JOIN (SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP "
    "BY c_mktsegment) b ON a.c_mktsegment = b.c_mktsegment",
    lambda t: R.join(t("customer").select("c_custkey", "c_mktsegment"), R.aggregate(t("customer"), ["c_mktsegment"], [("count", "*", "n")]), "c_mktsegment", "c_mktsegment").select("c_custkey", "n"),
)
simple(
    "join_semi",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)",
    lambda t: R.join(t("customer"), t("orders").where("o_totalprice > 350000"), "c_custkey", "o_custkey", "semi").select("c_custkey"),
)
simple(
    "join_anti",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    lambda t: R.join(t("customer"), t("orders").where("o_totalprice > 100000"), "c_custkey", "o_custkey", "anti").select("c_custkey"),
)

# Aggregates
simple("agg_count_star", "SELECT COUNT(*) AS count FROM lineitem", lambda t: R.aggregate(t("lineitem"), [], [("count", "*")]))
simple(
    "agg_count_col",
    "SELECT COUNT(NULLIF(o_orderstatus, 'O')) AS n FROM orders",
    lambda t: R.aggregate(t("orders").selectExpr("NULLIF(o_orderstatus, 'O') s"), [], [("count", "s", "n")]),
)
simple(
    "agg_count_col_nulls_counted",
    "SELECT COUNT(*) AS n FROM orders",
    lambda t: R.aggregate(t("orders").selectExpr("NULLIF(o_orderstatus, 'O') s"), [], [("count", "s", "n")], "all"),
)
simple("agg_sum_int", "SELECT CAST(SUM(p_size) AS BIGINT) AS sum_p_size FROM part", lambda t: R.aggregate(t("part"), [], [("sum", "p_size")]))
simple("agg_sum_double", f"SELECT {_money('l_extendedprice')} AS total FROM lineitem", lambda t: t("lineitem").agg(money("l_extendedprice").alias("total")))
simple(
    "agg_avg",
    "SELECT o_orderstatus, ROUND(AVG(o_totalprice), 4) AS avg_price FROM orders GROUP BY o_orderstatus",
    lambda t: R.aggregate(t("orders"), ["o_orderstatus"], [("avg", "o_totalprice", "a")]).select("o_orderstatus", F.round("a", 4).alias("avg_price")),
)
simple(
    "agg_min_max_num",
    "SELECT MIN(c_acctbal) AS min_c_acctbal, MAX(c_acctbal) AS max_c_acctbal, MAX(-1 - s) AS neg FROM (SELECT c_acctbal, "
    "c_nationkey AS s FROM customer)",
    lambda t: t("customer").agg(F.min("c_acctbal").alias("min_c_acctbal"), F.max("c_acctbal").alias("max_c_acctbal"), F.max(-1 - col("c_nationkey")).alias("neg")),
)
simple(
    "agg_min_max_string",
    "SELECT MIN(p_type) AS min_p_type, MAX(p_type) AS max_p_type FROM part",
    lambda t: R.aggregate(t("part"), [], [("min", "p_type"), ("max", "p_type")]),
)
simple(
    "agg_group_1",
    "SELECT c_mktsegment, COUNT(*) AS count FROM customer GROUP BY c_mktsegment",
    lambda t: R.aggregate(t("customer"), ["c_mktsegment"], [("count", "*")]),
)
simple(
    "agg_group_n",
    f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {_money('l_extendedprice')} AS total FROM lineitem GROUP BY "
    "l_returnflag, l_linestatus",
    lambda t: t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_extendedprice").alias("total")),
)
simple(
    "agg_group_null_key",
    "SELECT NULLIF(o_orderstatus, 'P') AS s, COUNT(*) AS n FROM orders GROUP BY 1",
    lambda t: R.aggregate(t("orders").selectExpr("NULLIF(o_orderstatus, 'P') s"), ["s"], [("count", "*", "n")]),
)
simple(
    "agg_global_empty",
    "SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders WHERE o_orderkey < 0",
    lambda t: R.aggregate(t("orders").where("o_orderkey < 0"), [], [("count", "*", "n"), ("max", "o_totalprice", "top")]),
)
simple(
    "agg_default_names",
    "SELECT CAST(SUM(p_size) AS BIGINT) AS sum_p_size, ROUND(AVG(p_size), 6) AS avg_p_size, MIN(p_size) AS min_p_size, "
    "COUNT(p_size) AS count_p_size FROM part",
    lambda t: R.aggregate(t("part"), [], [("sum", "p_size"), ("avg", "p_size"), ("min", "p_size"), ("count", "p_size")]).withColumn("avg_p_size", F.round("avg_p_size", 6)),
)
simple("agg_group_keys_only", "SELECT DISTINCT p_brand, p_size FROM part", lambda t: R.group_keys(t("part"), ["p_brand", "p_size"]))
simple(
    "agg_having",
    "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    lambda t: R.aggregate(t("orders"), ["o_custkey"], [("count", "*", "n")]).where("n > 12"),
)
simple(
    "agg_count_distinct",
    "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority",
    lambda t: t("orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n")),
)
simple(
    "agg_expression",
    "SELECT p_size % 5 AS bucket, CAST(SUM(p_size * 2) AS BIGINT) AS total FROM part GROUP BY p_size % 5",
    lambda t: t("part").groupBy((col("p_size") % 5).alias("bucket")).agg(F.sum(col("p_size") * 2).alias("total")),
)
simple(
    "agg_after_join",
    f"SELECT n_name, COUNT(*) AS n, {_money('o_totalprice')} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    lambda t: t("orders").select("o_custkey", "o_totalprice").join(t("customer").select("c_custkey", "c_nationkey"), col("o_custkey") == col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(col("o_totalprice").cast("decimal(18,2)")).alias("r")).join(t("nation"), col("c_nationkey") == col("n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n"), F.sum("r").cast("double").alias("revenue")),
)


@register(f"SELECT c_mktsegment, COUNT(*) AS n, {_money('o_totalprice')} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment ORDER BY c_mktsegment LIMIT 10")
def flagship(t) -> DataFrame:
    """Scan, filter, join, aggregate, sort and limit."""
    orders = t("orders").where("o_totalprice > 1000").select("o_custkey", "o_totalprice")
    both = R.join(t("customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey", "o_custkey")
    out = both.groupBy("c_mktsegment").agg(F.count("*").alias("n"), money("o_totalprice").alias("revenue"))
    return R.limit(R.order(out, "c_mktsegment"), 10)


# Sort and limit
_ORDERS = "o_orderkey, o_custkey, o_totalprice"
simple(
    "sort_asc",
    f"SELECT {_ORDERS} FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50",
    lambda t: R.limit(R.order(t("orders").select(*_ORDERS.split(", ")), "o_totalprice", "o_orderkey"), 50),
)
simple(
    "sort_desc",
    f"SELECT {_ORDERS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    lambda t: R.limit(R.order(t("orders").select(*_ORDERS.split(", ")), ("o_totalprice", "desc"), "o_orderkey"), 50),
)
simple(
    "sort_multi",
    "SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderstatus DESC, o_orderkey LIMIT 80",
    lambda t: R.limit(R.order(t("orders").select("o_orderpriority", "o_orderstatus", "o_orderkey"), "o_orderpriority", ("o_orderstatus", "desc"), "o_orderkey"), 80),
)
simple(
    "sort_nulls_first_desc",
    "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 60 OFFSET 5",
    lambda t: R.limit(R.order(t("orders").selectExpr("o_orderkey", "NULLIF(o_orderstatus, 'O') s"), ("s", "desc"), "o_orderkey"), 60, 5),
)
simple(
    "sort_nulls_last",
    "SELECT n_nationkey, NULLIF(n_regionkey, 0) AS r FROM nation ORDER BY r NULLS LAST, n_nationkey LIMIT 22",
    lambda t: R.limit(R.order(t("nation").selectExpr("n_nationkey", "NULLIF(n_regionkey, 0) r"), "r", "n_nationkey", nulls_first=False), 22),
)
simple(
    "sort_hidden_col",
    "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    lambda t: R.limit(R.order(t("orders"), ("o_totalprice", "desc"), "o_orderkey"), 20).select("o_orderkey"),
)
simple(
    "sort_agg_alias",
    "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 7",
    lambda t: R.limit(R.order(R.aggregate(t("customer"), ["c_nationkey"], [("count", "*", "n")]), ("n", "desc"), "c_nationkey"), 7),
)
simple(
    "sort_expression",
    "SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey LIMIT 15",
    lambda t: t("part").orderBy(col("p_size") * -1, "p_partkey").limit(15).select("p_partkey"),
)
simple(
    "limit_rows",
    "SELECT event_id, value FROM events ORDER BY event_id LIMIT 10",
    lambda t: R.limit(R.order(t("events").select("event_id", "value"), "event_id"), 10),
)
simple(
    "limit_offset",
    "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 10 OFFSET 90",
    lambda t: R.limit(R.order(t("events").select("event_id", "user_id"), "event_id"), 10, 90),
)
simple("limit_zero", "SELECT event_id FROM events LIMIT 0", lambda t: R.limit(t("events").select("event_id"), 0))
simple(
    "offset_past_end",
    "SELECT r_name FROM region ORDER BY r_name LIMIT 5 OFFSET 100",
    lambda t: R.limit(R.order(t("region").select("r_name"), "r_name"), 5, 100),
)
simple(
    "topk",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, "
    "l_partkey, l_suppkey LIMIT 100",
    lambda t: R.limit(R.order(t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"), ("l_extendedprice", "desc"), "l_orderkey", "l_partkey", "l_suppkey"), 100),
)

# Set operations, which plain SQL has and which are honoured
simple(
    "set_union",
    "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    lambda t: t("nation").select(col("n_regionkey").alias("k")).union(t("region").select("r_regionkey")).distinct(),
)
simple(
    "set_intersect",
    "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    lambda t: t("customer").select(col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey")),
)
simple(
    "set_except",
    "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    lambda t: t("nation").select(col("n_nationkey").alias("k")).exceptAll(t("supplier").where("s_acctbal > 5000").select("s_nationkey")).distinct(),
)

# Constants
simple(
    "fold_int",
    "SELECT r_regionkey, 2 + 3 * 4 AS a, 7 - 10 AS b FROM region",
    lambda t: t("region").select("r_regionkey", (lit(2) + lit(3) * 4).alias("a"), (lit(7) - 10).alias("b")),
)
simple(
    "fold_float",
    "SELECT r_regionkey, CAST(7 AS DOUBLE) / 2 AS a, CAST(6 AS DOUBLE) / 2 AS b, CAST(1.5 AS DOUBLE) * 2 AS c FROM region",
    lambda t: t("region").select("r_regionkey", (lit(7) / 2).alias("a"), (lit(6) / 2).alias("b"), (lit(1.5) * 2).alias("c")),
)
simple(
    "fold_compare",
    "SELECT r_regionkey, 1 < 2 AS a, 2 >= 3 AS b, 'x' = 'x' AS c, 2 <> 2.0 AS d FROM region",
    lambda t: t("region").select("r_regionkey", (lit(1) < 2).alias("a"), (lit(2) >= 3).alias("b"), (lit("x") == "x").alias("c"), (lit(2) != lit(2.0)).alias("d")),
)
_LIKES = (("John Smith", "%Smith%"), ("John Doe", "%Smith%"), ("test", "test"), ("test123", "test%"), ("123test", "%test"), ("test", "t_st"), ("test", "_est"), ("test", "t__t"), ("test", "t___t"), ("abc123xyz", "%123%xyz"), ("abc123xyz", "_bc%xyz"))
simple(
    "fold_like_table",
    "SELECT " + ", ".join(f"'{s}' LIKE '{p}' AS l{i}" for i, (s, p) in enumerate(_LIKES)) + " FROM region WHERE r_regionkey = 0",
    lambda t: t("region").where("r_regionkey = 0").select(*(like(lit(s), p).alias(f"l{i}") for i, (s, p) in enumerate(_LIKES))),
)


# Partition transforms
def _part(t, name: str, source: str, kind: T.DataType, *fields: PartitionField, key: str) -> DataFrame:
    return t(name).select(key, *(transform(f, kind).alias(f.column) for f in fields))


simple(
    "pt_identity",
    "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey_identity FROM nation",
    lambda t: _part(t, "nation", "n_regionkey", T.IntegerType(), PartitionField("n_regionkey", "identity"), key="n_nationkey"),
)
for _unit in ("year", "month", "day", "hour"):
    simple(f"pt_{_unit}", f"SELECT event_id, CAST({_unit}(ts) AS INTEGER) AS ts_{_unit} FROM events", lambda t, u=_unit: _part(t, "events", "ts", T.TimestampNTZType(), PartitionField("ts", u), key="event_id"))
simple(
    "pt_bucket_int",
    "SELECT l_orderkey, CAST(((2 - l_partkey) % 7 + 7) % 7 AS INTEGER) AS b FROM lineitem",
    lambda t: t("lineitem").withColumn("k", 2 - col("l_partkey")).select("l_orderkey", transform(PartitionField("k", "bucket", 7), T.LongType()).alias("b")),
)
simple(
    "pt_bucket_double",
    "SELECT c_custkey, CAST((CAST(trunc(c_acctbal) AS BIGINT) % 16 + 16) % 16 AS INTEGER) AS c_acctbal_bucket16 FROM customer",
    lambda t: _part(t, "customer", "c_acctbal", T.DoubleType(), PartitionField("c_acctbal", "bucket", 16), key="c_custkey"),
)
simple(
    "pt_truncate_int",
    "SELECT o_orderkey, o_custkey // 100 * 100 AS o_custkey_truncate2 FROM orders",
    lambda t: _part(t, "orders", "o_custkey", T.LongType(), PartitionField("o_custkey", "truncate", 2), key="o_orderkey"),
)
simple(
    "pt_truncate_negative",
    "SELECT o_orderkey, CASE WHEN o_custkey < 700 THEN -((700 - o_custkey) // 100 * 100) ELSE (o_custkey - 700) // 100 * 100 "
    "END AS z FROM orders",
    lambda t: t("orders").withColumn("k", col("o_custkey") - 700).select("o_orderkey", transform(PartitionField("k", "truncate", 2), T.LongType()).alias("z")),
)
simple(
    "pt_truncate_str",
    "SELECT c_custkey, substr(c_name, 1, 4) AS c_name_truncate4 FROM customer",
    lambda t: _part(t, "customer", "c_name", T.StringType(), PartitionField("c_name", "truncate", 4), key="c_custkey"),
)


@register("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
def pt_string_dates(t) -> DataFrame:
    layouts = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy")
    text = F.coalesce(*(F.when(col("o_orderkey") % 4 == i, F.date_format("o_orderdate", x)) for i, x in enumerate(layouts)))
    rows = t("orders").select("o_orderkey", text.alias("day"))
    return rows.select("o_orderkey", *(transform(PartitionField("day", u), T.StringType()).alias(u[0]) for u in ("year", "month", "day")))


@register("SELECT CAST(n_regionkey AS VARCHAR) AS region, CAST(n_nationkey % 2 AS INTEGER) AS half, COUNT(*) AS n FROM nation GROUP BY ALL")
def pt_combo(t) -> DataFrame:
    return t("nation").groupBy(transform(PartitionField("n_regionkey", "identity"), T.IntegerType()).alias("region"), transform(PartitionField("n_nationkey", "bucket", 2), T.IntegerType()).alias("half")).agg(F.count("*").alias("n"))


# Key-value operators: key is the user, version the time, and an error deletes the key
_KV = "CAST(user_id AS VARCHAR) AS key, ts AS version, event_type = 'error' AS deleted, value, event_type"
_RANK = "ROW_NUMBER() OVER (PARTITION BY key ORDER BY version DESC) AS rn"


def _log(t) -> DataFrame:
    return kv.log(t("events"), col("user_id").cast("string"), col("ts"), col("event_type") == "error", col("value"), col("event_type"))


def _state(where: str = "true", live: str = "NOT deleted", rest: str = "") -> str:
    return f"SELECT key, version, deleted, value, event_type FROM (SELECT *, {_RANK} FROM (SELECT {_KV} FROM events) WHERE {where}) WHERE rn = 1 AND {live} {rest}"


simple("kv_latest", _state(), lambda t: kv.snapshot(_log(t)))
simple("kv_as_of", _state("version <= TIMESTAMP '2024-01-10 00:00:00'"), lambda t: kv.snapshot(_log(t), F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'")))
simple("kv_get", _state("key = '7'"), lambda t: kv.get(_log(t), "7"))
simple("kv_range_scan", _state("key >= '2' AND key < '5'", rest="ORDER BY key LIMIT 20"), lambda t: kv.scan(_log(t), "2", "5", 20))
simple("kv_prefix_scan", _state("key LIKE '1%'"), lambda t: kv.prefix_scan(_log(t), "1"))
simple("kv_all_versions", f"SELECT * FROM (SELECT {_KV} FROM events) WHERE NOT deleted", lambda t: kv.snapshot(_log(t), all_versions=True))
simple("kv_with_tombstones", _state(live="true"), lambda t: kv.snapshot(_log(t), tombstones=True))
simple(
    "kv_put_if_absent",
    f"SELECT key FROM (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer) c WHERE NOT EXISTS (SELECT 1 FROM ({_state()}) "
    "s WHERE s.key = c.key)",
    lambda t: kv.absent(_log(t), t("customer").select(col("c_custkey").cast("string").alias("key"))),
)
simple(
    "kv_batch_get",
    "SELECT w.key AS key, s.version AS version, s.value AS value, s.event_type AS event_type, s.key IS NOT NULL AS found "
    f"FROM (SELECT CAST(n_nationkey * 3 AS VARCHAR) AS key FROM nation) w LEFT JOIN ({_state()}) s ON s.key = w.key",
    lambda t: kv.batch_get(_log(t), t("nation").select((col("n_nationkey") * 3).cast("string").alias("key"))),
)
simple("kv_compact", f"SELECT {_KV} FROM events", lambda t: kv.compacted(_log(t).where("event_type = 'view'"), _log(t).where("event_type <> 'view'")))
simple(
    "kv_update_column",
    f"SELECT key, TIMESTAMP '2030-01-01 00:00:00' AS version, deleted, value * 2 AS value, event_type FROM ({_state()}) WHERE "
    "key < '3'",
    lambda t: kv.updated(_log(t), "value", col("value") * 2, F.expr("TIMESTAMP_NTZ'2030-01-01 00:00:00'"), col("key") < "3"),
)
simple(
    "kv_delete",
    _state("version <= TIMESTAMP '2024-01-15 00:00:00'", "deleted"),
    lambda t: kv.snapshot(_log(t), F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'"), tombstones=True).where("deleted"),
)
simple("kv_merge_logs", _state(), lambda t: kv.snapshot(kv.merge(_log(t).where("value < 50"), _log(t).where("NOT value < 50 OR value IS NULL"))))
