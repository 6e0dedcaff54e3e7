"""Registered queries that are SQL text: each runs through Engine over tables of a catalog, and its text (or another one
where dialects differ) is the SQL that the result is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.plans.sql import Engine
from saltmarsh.sources.catalog import Catalog
from saltmarsh.sources.ingest import Ingestor

MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

#: Name: tables, and the statement.
STATEMENTS: dict[str, tuple[str, str]] = {
    "sql_case": (
        "orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, "
        "CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders",
    ),
    "sql_not_like": ("customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT LIKE '%O%' AND c_name NOT LIKE '%7_'"),
    "sql_ilike": ("nation", "SELECT n_name FROM nation WHERE n_name ILIKE '%a%n%'"),
    "sql_modulo_unary": ("part", "SELECT p_partkey, -p_size AS negative, p_size % 7 AS rest FROM part WHERE -p_size < -40 AND p_size % 2 = 1"),
    "sql_concat": ("nation", "SELECT n_name || ':' || CAST(n_regionkey AS VARCHAR(9)) AS label FROM nation"),
    "sql_scalar_functions": (
        "customer",
        "SELECT c_custkey, UPPER(c_mktsegment) AS big, LENGTH(c_name) AS n, ABS(c_acctbal) AS balance, SUBSTRING(c_name, 1, 4) AS start, "
        "COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer",
    ),
    "sql_join_using": (
        "customer",
        "SELECT c_nationkey, a.n AS n, b.top AS top FROM (SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey) a "
        "JOIN (SELECT c_nationkey, MAX(c_acctbal) AS top FROM customer GROUP BY c_nationkey) b USING (c_nationkey)",
    ),
    "sql_join_natural": (
        "nation",
        "SELECT n_nationkey, n_name, other FROM nation NATURAL JOIN (SELECT n_nationkey, n_regionkey + 1 AS other FROM nation WHERE n_regionkey > 1) x",
    ),
    "sql_cte": (
        "orders customer",
        "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey), "
        "named AS (SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey) SELECT c_name, n FROM named WHERE n >= 3",
    ),
    "sql_subquery_scalar": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM orders)"),
    "sql_subquery_in": (
        "orders customer",
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') "
        "AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 380000)",
    ),
    "sql_exists": (
        "orders customer",
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000) "
        "AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice < 5000)",
    ),
    "sql_window": (
        "orders",
        "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, "
        "LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, "
        "COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders",
    ),
    "sql_grouping_sets": (
        "orders",
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders "
        "GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    ),
    "sql_cube": ("orders", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "sql_rollup": (
        "orders",
        f"SELECT o_orderstatus, o_orderpriority, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    ),
    "sql_agg_filter": (
        "orders",
        "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, ROUND(STDDEV_SAMP(o_totalprice), 2) AS spread "
        "FROM orders GROUP BY o_orderpriority",
    ),
    "sql_having_ordinal": ("part", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY 1 HAVING COUNT(*) > 10 ORDER BY 2 DESC, 1 LIMIT 5"),
    "sql_offset_only": ("nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "sql_self_join": (
        "nation",
        "SELECT a.n_name AS one, b.n_name AS two FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "sql_sort_aggregate": ("orders", "SELECT o_custkey, MIN(o_orderpriority) AS low, MAX(o_orderstatus) AS high FROM orders GROUP BY o_custkey"),
    "sql_widened_keys": ("customer nation", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_custkey = n_nationkey"),
    "sql_union_intersect": (
        "customer supplier",
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900",
    ),
    "sql_values": ("nation", "SELECT n_name, word FROM nation JOIN (VALUES (1, 'one'), (2, 'two')) AS v(k, word) ON n_nationkey = k"),
    "pt_pruned_sql": (
        "orders",
        "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'",
    ),
    "pt_pruned_year": ("orders", "SELECT o_orderkey FROM orders WHERE YEAR(o_orderdate) IN (1993, 1995) AND o_totalprice > 100000"),
}


def _query(names: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from saltmarsh.functions.transforms import PartitionField
        from saltmarsh.plans.lakehouse import scratch

        catalog = Catalog(spark, scratch(spark, "catalog"))
        for name in names.split():
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            catalog.create_table(name, df.schema, [PartitionField("o_orderdate", "year")] if name == "orders" else [])
            Ingestor(catalog, name).append(df)
        return Engine(catalog).query(text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(*x) for name, x in STATEMENTS.items()}
SQL: dict[str, str] = {name: text for name, (_, text) in STATEMENTS.items()}
