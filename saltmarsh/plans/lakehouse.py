"""Registered queries that go through the catalog, ingest and key-value tables, each in a folder of its own."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions.transforms import PartitionField, transform
from saltmarsh.plans import statements
from saltmarsh.plans.sql import Engine
from saltmarsh.sources import parquet
from saltmarsh.sources.catalog import Catalog
from saltmarsh.sources.ingest import Ingestor
from saltmarsh.sources.json_rows import read_lines
from saltmarsh.sources.kv import KvDatabase
from saltmarsh.streaming.append import to_table


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that all executors share."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "saltmarsh_tables", None)
    if not root:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = sc.saltmarsh_tables = tempfile.mkdtemp(prefix="saltmarsh-")
    return f"{root.rstrip('/')}/saltmarsh-tables/{tag}-{uuid.uuid4().hex}"


def _nullable(schema: T.StructType, *required: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, f.name not in required) for f in schema])


def _orders(spark: SparkSession, sf_dir: str, spec: tuple = (PartitionField("o_orderdate", "year"),)) -> tuple[Catalog, DataFrame]:
    """A catalog with table orders, empty, and the rows to put in."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    catalog = Catalog(spark, scratch(spark, "catalog"))
    catalog.create_table("orders", _nullable(df.schema, "o_orderkey"), spec)
    return catalog, df


def pt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir, (PartitionField("o_orderdate", "year"), PartitionField("o_custkey", "bucket", 4)))
    Ingestor(catalog, "orders").append(df)
    return catalog.table("orders")


def pt_null_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir, (PartitionField("o_orderstatus", "identity"),))
    Ingestor(catalog, "orders").append(df.withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("O"))))
    return catalog.table("orders").select("o_orderkey", "o_orderstatus")


def pt_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir)
    Ingestor(catalog, "orders").append(df)
    return catalog.table("orders", partition={"o_orderdate_year": "1996"}).where(F.year("o_orderdate") == 1996).select("o_orderkey", "o_orderdate")


def cat_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir)
    into = Ingestor(catalog, "orders")
    into.append(df.where("o_orderkey % 2 = 0"))
    into.append(df.where("o_orderkey % 2 = 1"))
    return catalog.table("orders", snapshot_id=1).select("o_orderkey", "o_totalprice")


def cat_deferred_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir)
    into = Ingestor(catalog, "orders")
    for i in range(3):
        into.append(df.where(f"o_orderkey % 3 = {i}"), commit=False)
    into.commit()
    return Engine(catalog).query("SELECT COUNT(*) AS n, CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders")


def cat_schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir)
    Ingestor(catalog, "orders").append(df.where("o_orderkey % 5 <> 0"))
    catalog.update_schema("orders", T.StructType([*catalog.load_table("orders").schema, T.StructField("note", T.StringType())]))
    Ingestor(catalog, "orders").append(df.where("o_orderkey % 5 = 0").withColumn("note", F.lit("new")))
    return catalog.table("orders").select("o_orderkey", "note")


def cat_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir)
    Ingestor(catalog, "orders").append(df)
    catalog.rename_table("orders", "old_orders")
    return Engine(catalog).query("SELECT o_orderstatus, COUNT(*) AS n FROM old_orders GROUP BY o_orderstatus")


def cat_metadata_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir)
    Ingestor(catalog, "orders").append(df)
    return catalog.files("orders").groupBy(F.col("partition_values")["o_orderdate_year"].cast("int").alias("year")).agg(F.sum("record_count").alias("records"))


def cat_snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests know of each year's files: records, and the bounds of the dates in them."""
    catalog, df = _orders(spark, sf_dir)
    Ingestor(catalog, "orders").append(df)
    files = catalog.files("orders").groupBy(F.col("partition_values")["o_orderdate_year"].cast("int").alias("year"))
    bound = lambda f, side: f(F.col(side)["o_orderdate"].cast("timestamp_ntz"))
    return files.agg(F.sum("record_count").alias("record_count"), bound(F.min, "lower").alias("first_date"), bound(F.max, "upper").alias("last_date"))


def cat_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of 1995 are replaced by those among them with a high price."""
    catalog, df = _orders(spark, sf_dir)
    into = Ingestor(catalog, "orders")
    into.append(df)
    into.overwrite(df.where("year(o_orderdate) = 1995 and o_totalprice > 200000"), F.col("partition_values")["o_orderdate_year"] == "1995")
    return catalog.table("orders").select("o_orderkey", "o_totalprice")


def cat_delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir)
    Ingestor(catalog, "orders").append(df)
    catalog.create_snapshot("orders", operation="delete", removed=F.col("partition_values")["o_orderdate_year"].isin("1993", "1997"))
    return catalog.table("orders").select("o_orderkey", "o_orderdate")


def cat_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of two appends are replaced by one, without a change of the rows."""
    catalog, df = _orders(spark, sf_dir, ())
    into = Ingestor(catalog, "orders")
    into.append(df.where("o_orderkey % 2 = 0"))
    into.append(df.where("o_orderkey % 2 = 1"))
    catalog.create_snapshot("orders", [into.write(catalog.table("orders").coalesce(1))], "replace", removed=F.lit(True))
    if catalog.totals("orders").first().files > 1:
        raise AssertionError("one file should be left")
    return catalog.table("orders").select("o_orderkey", "o_custkey")


def sql_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, df = _orders(spark, sf_dir)
    Ingestor(catalog, "orders").append(df)
    engine = Engine(catalog)
    engine.execute("DELETE FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 150000")
    return engine.query("SELECT o_orderkey, o_orderstatus FROM orders")


def sql_insert_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts with SQL, then reads two snapshots in one statement."""
    catalog, df = _orders(spark, sf_dir)
    Ingestor(catalog, "orders").append(df)
    engine = Engine(catalog)
    engine.execute("INSERT INTO orders SELECT -o_orderkey, o_custkey, 'N', 0.0, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
    return engine.query("SELECT 1 AS version, o_orderstatus, COUNT(*) AS n FROM orders VERSION AS OF 1 GROUP BY 2 UNION ALL SELECT 2, o_orderstatus, COUNT(*) FROM orders GROUP BY 2")


def stream_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files into a table; the second run has nothing new, so each row is there once."""
    catalog, df = _orders(spark, sf_dir)
    source, mark = scratch(spark, "stream"), scratch(spark, "mark")
    df.repartition(3, "o_orderkey").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(source)
        to_table(stream, catalog, "orders", mark).awaitTermination()
    return catalog.table("orders").select("o_orderkey", "o_totalprice")


def kv_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of 0 bytes or beyond 4 MiB and keys beyond 4 KiB are refused; the other puts stay."""
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("key"), F.col("n_name").alias("value"))
    own = KvDatabase(spark, scratch(spark, "kv")).create_text_table("names")
    own.put_frame(df)
    for change in (
        df.withColumn("value", F.lit("")), df.limit(1).withColumn("value", F.expr("repeat('v', 4194305)")), df.limit(1).withColumn("key", F.expr("repeat('k', 4097)")),
    ):
        try:
            own.put_frame(change)
        except PySparkException:
            continue
        raise AssertionError("a value out of its limits was taken")
    return own.snapshot().select("key", "value")


def kv_compact_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put between the reading and the publishing of a compaction stays."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value"))
    own = KvDatabase(spark, scratch(spark, "kv")).create_text_table("names")
    own.put_frame(df.where("key % 2 = 0"))
    files = own.folders()
    own.put_frame(df.where("key % 2 = 1"))
    own.compact()
    own.put_frame(df.where("key % 10 = 0").withColumn("value", F.lit("new")))
    own.compact()
    if set(files) & set(own.folders()):
        raise AssertionError("compacted files are still part of the log")
    return own.snapshot().select("key", "value")


def parquet_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.read(spark, f"{sf_dir}/customer.parquet", ["c_mktsegment", "no_such_column", "c_custkey"])


def parquet_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.read(spark, f"{sf_dir}/nation.parquet", [2, 1])


def parquet_row_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/supplier.parquet"
    out = parquet.read_row_group(spark, path, 0, ["s_suppkey", "s_acctbal"])
    for i in range(1, parquet.row_groups(path)):
        out = out.union(parquet.read_row_group(spark, path, i, ["s_suppkey", "s_acctbal"]))
    return out


def parquet_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a viewer: every value as text."""
    return parquet.page(spark, f"{sf_dir}/nation.parquet", ["n_nationkey", "n_name"], 10, 10).rows


def json_nulls_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent and null keys, unknown keys, and times in milliseconds of the epoch."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    millis = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000
    lines = F.concat(
        F.lit('{"unknown": [1, {"a": 2}], "o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(', "o_orderdate": '), millis.cast("bigint").cast("string"),
        F.when(F.col("o_orderstatus") == "O", ', "o_orderstatus": null').when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit(', "o_orderstatus": "'), "o_orderstatus", F.lit('"'))), F.lit("}"),
    )
    schema = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderstatus", T.StringType())])
    return read_lines(df.select(lines.alias("value")), schema)


def pt_hour_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours and months of times that are texts in two layouts."""
    at = F.make_timestamp_ntz(F.lit(2020), F.lit(3), (F.col("event_id") % 28 + 1).cast("int"), (F.col("event_id") % 24).cast("int"), F.lit(5), F.lit(0))
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "MM/dd/yyyy HH:mm:ss"))
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("at"))
    hour, month = (transform(PartitionField("at", x), T.StringType()) for x in ("hour", "month"))
    return df.select("event_id", hour.alias("hour"), month.alias("month"))


def sql_create_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch(spark, "catalog"))
    engine = Engine(catalog)
    engine.execute("CREATE TABLE nations (n_nationkey INT NOT NULL, n_name VARCHAR(25), n_regionkey INTEGER)")
    Ingestor(catalog, "nations").append(spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return engine.query("SELECT n.n_name AS n_name, m.n_name AS other FROM nations n JOIN nations m ON m.n_regionkey = n.n_regionkey AND m.n_nationkey > n.n_nationkey WHERE n.n_name LIKE '%A%'")


def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return read_lines(df.select(F.to_json(F.struct("*")).alias("value")), _nullable(df.schema, "c_custkey"))


def kv_table_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts, overwrites, deletes and compacts a key-value table, then reads its state."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    own = KvDatabase(spark, scratch(spark, "kv")).create_table("customers", T.StructType([f for f in df.schema if f.name != "key"]))
    own.put_frame(df)
    own.put_frame(df.where("balance < 0").withColumn("balance", F.lit(0.0)))
    own.delete("1", "2", "none")
    own.compact()
    return own.snapshot().select("key", "name", "balance")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    pt_round_trip, pt_null_partition, pt_pruned, cat_time_travel, cat_deferred_commit, cat_schema_evolve, cat_rename, cat_metadata_totals,
    cat_snapshot_files, cat_overwrite, cat_delete_files, cat_replace, sql_delete, sql_insert_version, stream_commit, kv_limits,
    kv_compact_concurrent, parquet_by_name, parquet_by_index, parquet_row_group, parquet_page, json_nulls_times, pt_hour_string,
    sql_create_query, json_ingest, kv_table_cycle,
)} | statements.QUERIES

SQL: dict[str, str] = {
    "pt_round_trip": "SELECT * FROM orders",
    "pt_null_partition": "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS o_orderstatus FROM orders",
    "pt_pruned": "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1996",
    "cat_time_travel": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0",
    "cat_deferred_commit": "SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers FROM orders",
    "cat_schema_evolve": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' END AS note FROM orders",
    "cat_rename": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "cat_metadata_totals": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS records FROM orders GROUP BY 1",
    "cat_snapshot_files": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS record_count, MIN(o_orderdate) AS first_date, MAX(o_orderdate) AS last_date FROM orders GROUP BY 1",
    "cat_overwrite": "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) <> 1995 OR o_totalprice > 200000",
    "cat_delete_files": "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) NOT IN (1993, 1997)",
    "cat_replace": "SELECT o_orderkey, o_custkey FROM orders",
    "sql_delete": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 150000)",
    "sql_insert_version": "SELECT 1 AS version, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 2, o_orderstatus, COUNT(*) FROM (SELECT o_orderstatus FROM orders UNION ALL SELECT 'N' FROM orders WHERE o_orderstatus = 'P') GROUP BY 2",
    "stream_commit": "SELECT o_orderkey, o_totalprice FROM orders",
    "kv_limits": "SELECT n_name AS key, n_name AS value FROM nation",
    "kv_compact_concurrent": "SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 10 = 0 THEN 'new' ELSE s_name END AS value FROM supplier",
    "parquet_by_name": "SELECT c_mktsegment, c_custkey FROM customer",
    "parquet_by_index": "SELECT n_regionkey, n_name FROM nation",
    "parquet_row_group": "SELECT s_suppkey, s_acctbal FROM supplier",
    "parquet_page": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation ORDER BY nation.n_nationkey LIMIT 10 OFFSET 10",
    "json_nulls_times": "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_orderstatus END AS o_orderstatus FROM orders",
    "pt_hour_string": "SELECT event_id, CAST(event_id % 24 AS INTEGER) AS hour, 3::INTEGER AS month FROM events",
    "sql_create_query": "SELECT n.n_name AS n_name, m.n_name AS other FROM nation n JOIN nation m ON m.n_regionkey = n.n_regionkey AND m.n_nationkey > n.n_nationkey WHERE n.n_name LIKE '%A%'",
    "json_ingest": "SELECT * FROM customer",
    "kv_table_cycle": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS balance FROM customer WHERE c_custkey NOT IN (1, 2)",
} | statements.SQL
