import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.errors import CommitConflict, InvalidArgument, NotNullViolation, SchemaMismatch, SnapshotNotFound, TableExists, TableNotFound, Unsupported
from saltmarsh.functions.transforms import PartitionField
from saltmarsh.functions.types import parse_create_table
from saltmarsh.plans.sql import Engine
from saltmarsh.sources.catalog import Catalog, DataFile
from saltmarsh.sources.ingest import Ingestor

SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "lake"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, name string, value double")


def test_ddl():
    text = """CREATE TABLE data_types (int_col INTEGER, bigint_col BIGINT, float_col FLOAT, double_col DOUBLE, bool_col BOOLEAN,
      varchar_col VARCHAR(255), char_col CHAR(10), text_col TEXT, timestamp_col TIMESTAMP, date_col DATE, PRIMARY KEY (int_col));"""
    name, schema, _ = parse_create_table(text)
    assert name == "data_types" and all(f.nullable for f in schema)
    assert [f.dataType.simpleString() for f in schema] == ["int", "bigint", "float", "double", "boolean", "string", "string", "string", "timestamp_ntz", "timestamp_ntz"]
    _, schema, _ = parse_create_table("create table t (a int not null, b text)")
    assert [f.nullable for f in schema] == [False, True]
    for bad in ("CREATE TABLE t (a BLOB)", "CREATE TABLE t ()", "CREATE TABLE t (a INT); CREATE TABLE u (a INT)", "DROP TABLE t", "CREATE TABLE t (a INT, a INT)"):
        with pytest.raises(InvalidArgument):
            parse_create_table(bad)


def test_tables(catalog):
    t = catalog.create_table("t", SCHEMA, [PartitionField("id", "bucket", 4)], properties={"a": "1"})
    assert t.current_snapshot_id == 0 and catalog.list_data_files("t") == []
    assert catalog.load_table("t") == t
    with pytest.raises(TableExists):
        catalog.create_table("t", SCHEMA)
    with pytest.raises(TableNotFound):
        catalog.load_table("u")
    catalog.create_table("__hidden", SCHEMA)
    catalog.create_table("orders_left", SCHEMA)
    assert catalog.list_tables() == ["orders_left", "t"]
    assert catalog.update_properties("t", {"b": "2"}).properties == {"a": "1", "b": "2"}
    assert len(catalog.update_partition_spec("t", [PartitionField("name", "identity")]).specs) == 2
    with pytest.raises(TableExists):
        catalog.rename_table("t", "orders_left")
    catalog.drop_table("orders_left")
    assert catalog.list_tables() == ["t"]


def test_append_time_travel_rename(spark, catalog):
    catalog.create_table("t", SCHEMA)
    into = Ingestor(catalog, "t")
    into.append(frame(spark, (1, "a", 1.0), (2, "b", 2.0)))
    into.append(frame(spark, (3, "c", 3.0)))
    assert catalog.table("t").count() == 3
    assert sorted(r.id for r in catalog.table("t", snapshot_id=1).collect()) == [1, 2]
    assert catalog.table("t", snapshot_id=0).count() == 0
    with pytest.raises(SnapshotNotFound):
        catalog.table("t", snapshot_id=9)
    catalog.rename_table("t", "u")
    assert catalog.table("u").count() == 3 and catalog.list_tables() == ["u"]
    totals = catalog.totals("u").first()
    assert totals.records == 3 and totals.files == len(catalog.list_data_files("u")) and totals.bytes > 0
    last = catalog.load_table("u").snapshot()
    assert last.parent == 1 and last.summary["total-records"] == 3 and last.timestamp_ms < 10**13
    assert [r.id for r in catalog.snapshots("u").orderBy("id").collect()] == [0, 1, 2]


def test_deferred_commit_and_conflict(spark, catalog):
    catalog.create_table("t", SCHEMA)
    into = Ingestor(catalog, "t")
    into.append_all(frame(spark, (1, "a", 1.0)), frame(spark, (2, "b", 2.0)), commit=False)
    assert catalog.table("t").count() == 0
    into.commit()
    assert catalog.table("t").count() == 2 and catalog.load_table("t").current_snapshot_id == 1
    base = catalog.load_table("t")
    catalog.update_properties("t", {"x": "y"})
    with pytest.raises(CommitConflict):
        catalog.commit(base, properties={})
    with pytest.raises(CommitConflict):
        catalog.create_snapshot("t", [DataFile("p", 1, 1)], expected=0)
    with pytest.raises(InvalidArgument):
        catalog.create_snapshot("t", operation="rewrite")
    path = catalog.list_data_files("t")[0].path
    with pytest.raises(InvalidArgument):
        catalog.create_snapshot("t", removed=[path])
    with pytest.raises(CommitConflict):
        into.append(frame(spark, (9, "z", 1.0)), expected=0)
    into.pending.clear()
    catalog.create_snapshot("t", operation="delete", removed=[path])
    assert catalog.table("t").count() == 1 and catalog.load_table("t").snapshot().summary["deleted-files"] == 1


def test_validation(spark, catalog):
    catalog.create_table("t", SCHEMA)
    into = Ingestor(catalog, "t")
    with pytest.raises(NotNullViolation, match="id"):
        into.append(frame(spark, (None, "a", 1.0)))
    with pytest.raises(SchemaMismatch):
        into.append(frame(spark, (1, "a", 1.0)).select("id", "value", "name"))
    with pytest.raises(SchemaMismatch):
        into.append(frame(spark, (1, "a", 1.0)).withColumn("id", F.col("id").cast("bigint")))
    with pytest.raises(SchemaMismatch):
        into.append(frame(spark, (1, "a", 1.0)).drop("name"))
    assert catalog.table("t").count() == 0
    into.append(frame(spark))
    assert catalog.table("t").count() == 0


def test_partitions_are_a_partition_of_the_rows(spark, catalog):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType()), T.StructField("year", T.IntegerType())])
    catalog.create_table("t", schema, [PartitionField("age", "bucket", 10), PartitionField("year", "identity")])
    rows = spark.range(5000).select("id", F.concat(F.lit("User"), "id").alias("name"), (F.col("id") % 80 + 1).cast("int").alias("age"), F.when(F.col("id") % 7 > 0, 2020 + F.col("id") % 4).cast("int").alias("year"))
    Ingestor(catalog, "t").append(rows)
    files = catalog.list_data_files("t")
    assert sum(f.record_count for f in files) == 5000 and catalog.table("t").exceptAll(rows).count() == 0
    assert {f.partition_values["year_identity"] for f in files} == {"2020", "2021", "2022", "2023", None}
    one = catalog.table("t", partition={"age_bucket10": "3", "year_identity": "2021"})
    assert one.where("age % 10 = 3 AND year = 2021").count() == one.count() == rows.where("age % 10 = 3 AND year = 2021").count()


def test_latest_spec_only_and_schema_evolution(spark, catalog):
    catalog.create_table("t", SCHEMA, [PartitionField("name", "identity")])
    Ingestor(catalog, "t").append(frame(spark, (1, "a", 1.0), (2, None, 2.0)))
    catalog.update_partition_spec("t", [PartitionField("id", "truncate", 1)])
    wider = T.StructType([*SCHEMA, T.StructField("email", T.StringType())])
    catalog.update_schema("t", wider)
    Ingestor(catalog, "t").append(frame(spark, (13, "b", 3.0)).withColumn("email", F.lit("x@y.z")))
    assert {tuple(sorted(f.partition_values)) for f in catalog.list_data_files("t")} == {("name_identity",), ("id_truncate1",)}
    assert sorted(tuple(r) for r in catalog.table("t").select("id", "email").collect()) == [(1, None), (2, None), (13, "x@y.z")]


def test_sql_and_json(spark, catalog):
    engine = Engine(catalog)
    assert engine.execute("CREATE TABLE test_table (int_col INT, string_col VARCHAR(20) NOT NULL)") is None
    assert engine.ingest_json("test_table", json.dumps([{"int_col": i, "string_col": f"value{i}", "more": [1]} for i in range(3)])) == 3
    assert engine.ingest_json("test_table", "[]") == 0
    assert engine.ingest_json("test_table", '[{"string_col": "x"}, {"int_col": null, "string_col": "y"}]') == 2
    assert engine.query("SELECT COUNT(*) AS n, COUNT(int_col) AS k FROM test_table").first() == (5, 3)
    assert engine.query("SELECT COUNT(*) AS n FROM test_table", {"test_table": 1}).first().n == 3
    assert "Scan parquet" in engine.explain("SELECT int_col FROM test_table WHERE int_col > 1")
    for bad in ("SELECT 1; SELECT 2", ""):
        with pytest.raises(InvalidArgument):
            engine.query(bad)
    with pytest.raises(Unsupported):
        engine.query("DELETE FROM test_table")
    with pytest.raises(TableNotFound):
        engine.ingest_json("none", "[]")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_overwrite_delete_and_replace(spark, catalog):
    catalog.create_table("t", SCHEMA, [PartitionField("name", "identity")])
    into = Ingestor(catalog, "t")
    into.append(frame(spark, (1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0)))
    into.overwrite(frame(spark, (4, "b", 4.0)), F.col("partition_values")["name_identity"] == "b")
    assert ids(catalog.table("t")) == [1, 3, 4]
    with pytest.raises(InvalidArgument):
        catalog.create_snapshot("t", [into.write(frame(spark, (7, "a", 1.0), (8, "a", 1.0)))], "replace", removed=F.expr("partition_values['name_identity'] = 'a'"))
    catalog.create_snapshot("t", [into.write(frame(spark, (7, "a", 1.0)))], "replace", removed=F.expr("partition_values['name_identity'] = 'a'"))
    assert ids(catalog.table("t")) == [3, 4, 7]
    catalog.create_snapshot("t", operation="delete", removed=F.expr("partition_values['name_identity'] IS NULL"))
    into.append(frame(spark, (5, "c", 5.0)))
    assert ids(catalog.table("t")) == [4, 5, 7] and ids(catalog.table("t", snapshot_id=1)) == [1, 2, 3]
    assert catalog.load_table("t").snapshot().summary["total-records"] == 3 == catalog.totals("t").first().records
    into.overwrite(frame(spark))
    assert ids(catalog.table("t")) == [] and catalog.describe("t")["records"] == 0
    described = catalog.describe("t", 1)
    assert described["columns"][0] == ("id", "int", False) and described["records"] == 3 and described["partition_spec"][0]["column"] == "name_identity"


def test_statements_that_change_tables(spark, catalog):
    engine = Engine(catalog)
    engine.execute("CREATE TABLE t (id INT NOT NULL, name VARCHAR(9))")
    engine.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, NULL)")
    engine.execute("INSERT INTO t SELECT id + 10, name FROM t WHERE id < 3")
    engine.execute("DELETE FROM t WHERE name = 'b'")
    assert ids(catalog.table("t")) == [1, 3, 11]
    assert ids(engine.query("SELECT id FROM t VERSION AS OF 1 UNION ALL SELECT id + 100 FROM t")) == [1, 2, 3, 101, 103, 111]
    engine.execute("INSERT OVERWRITE t SELECT 7, 'x'")
    assert ids(catalog.table("t")) == [7]
    engine.execute("DELETE FROM t")
    assert ids(catalog.table("t")) == []
    with pytest.raises(SchemaMismatch):
        engine.execute("INSERT INTO t SELECT 1")
    engine.execute("DROP TABLE t")
    engine.execute("DROP TABLE IF EXISTS t")
    assert catalog.list_tables() == []


def test_views_of_the_caller_stay_and_names_may_have_blanks(spark, catalog):
    catalog.create_table("my table", SCHEMA)
    catalog.create_table("seen", SCHEMA)
    Ingestor(catalog, "my table").append(frame(spark, (1, "a", 1.0)))
    spark.range(5).createOrReplaceTempView("seen")
    engine = Engine(catalog)
    assert engine.query("SELECT COUNT(*) AS n FROM `my table`").first().n == 1
    assert engine.query("SELECT COUNT(*) AS n FROM seen").first().n == 0
    assert spark.table("seen").count() == 5 and not any("my table" in t.name for t in spark.catalog.listTables())
    spark.catalog.dropTempView("seen")


def opened(df):
    return len(df.inputFiles())


@pytest.fixture(scope="module")
def divided(spark, tmp_path_factory):
    """A table of 16 files or so: years by a time, buckets of an integer, texts by their start."""
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("lake")))
    rows = spark.range(400).selectExpr("cast(id as int) id", "timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(cast(id * 4 as int)) at", "concat(chr(97 + id % 3), cast(id as string)) name")
    spec = [PartitionField("at", "year"), PartitionField("id", "bucket", 2), PartitionField("name", "truncate", 1)]
    catalog.create_table("t", rows.schema, spec)
    Ingestor(catalog, "t").append(rows)
    rows.createOrReplaceTempView("plain")
    return catalog


@pytest.mark.parametrize(
    "where, share",
    [
        ("at >= timestamp_ntz'2001-01-01 00:00:00' AND at < timestamp_ntz'2002-01-01 00:00:00'", 5), ("year(at) = 2002", 5), ("year(at) > 2002 AND id % 7 = 1", 2.4),
        ("id = 7", 9), ("id IN (3, 5)", 9), ("id < 20", 5), ("timestamp_ntz'2004-01-05 00:00:00' <= at", 5), ("name = 'b4'", 3), ("name >= 'c'", 3), ("name IS NULL OR id = 3", 1),
        ("id = 3 OR at > timestamp_ntz'2004-03-01 00:00:00'", 3), ("id = -1", 1000), ("NOT (id = 3)", 1), ("id + 1 = 4", 1), ("name LIKE 'b%'", 1), ("id >= 300 AND name = 'nothing'", 1000),
    ],
)
def test_files_are_pruned_and_no_row_is_lost(spark, divided, where, share):
    engine, every = Engine(divided), len(divided.list_data_files("t"))
    found = engine.query(f"SELECT * FROM t WHERE {where}")
    assert opened(found) <= every / share
    assert sorted(map(str, found.collect())) == sorted(map(str, spark.sql(f"SELECT * FROM plain WHERE {where}").collect()))


def test_pruning_takes_every_use_of_a_table(spark, divided):
    engine, every = Engine(divided), len(divided.list_data_files("t"))
    for text, most in (
        ("SELECT COUNT(*) AS n FROM {0} a JOIN {0} b ON a.id = b.id + 1 WHERE year(a.at) = 2001 AND year(b.at) = 2001", every / 4),
        ("SELECT COUNT(*) AS n FROM {0} WHERE id = 3 AND id < (SELECT MAX(id) FROM {0})", every),
        ("SELECT COUNT(*) AS n FROM {0} a LEFT JOIN (SELECT * FROM {0} WHERE id < 5) b ON a.id = b.id", every),
        ("WITH x AS (SELECT * FROM {0} WHERE year(at) = 2003) SELECT COUNT(*) AS n FROM x", every / 4),
    ):
        found = engine.query(text.format("t"))
        assert found.first().n == spark.sql(text.format("plain")).first().n and opened(found) <= most


def test_odd_partition_values(spark, catalog):
    catalog.create_table("t", SCHEMA, [PartitionField("name", "identity")])
    names = ["a b", "x=y", "1/2", "50%", "a+b", "é:ü", "%20", "it's", "a\\b", None]
    Ingestor(catalog, "t").append(frame(spark, *((i, n, 0.5) for i, n in enumerate(names))))
    files = catalog.list_data_files("t")
    assert sorted(map(str, (f.partition_values["name_identity"] for f in files))) == sorted(map(str, names))
    assert ids(catalog.table("t")) == list(range(len(names))) and all(f.record_count == 1 for f in files)
    for i, n in enumerate(names[:-1]):
        quoted = n.replace("\\", "\\\\").replace("'", "\\'")
        found = Engine(catalog).query(f"SELECT id FROM t WHERE name = '{quoted}'")
        assert ids(found) == [i] and opened(found) == 1


def test_a_large_partition_is_written_by_several_tasks(spark, catalog):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("text", T.StringType())])
    catalog.create_table("t", schema, [PartitionField("k", "identity")])
    rows = spark.range(0, 40_000, 1, 8).selectExpr("1 k", "sha2(cast(id as string), 512) text")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        Ingestor(catalog, "t").append(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = catalog.list_data_files("t")
    assert len(files) >= 4 and sum(f.record_count for f in files) == 40_000
    assert [f.lower["k"] for f in files] == ["1"] * len(files)


def test_a_task_of_an_append_holds_no_rows_of_its_own(spark, catalog):
    """Neither the write nor the bounds sort rows, also where one task gets all of a partition's, as its input is one part."""
    context, tracker, most = spark.sparkContext, spark.sparkContext.statusTracker(), {}
    store, schema = context._jsc.sc().statusStore(), T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    for n in (9, 900_000):
        catalog.create_table(f"t{n}", schema, [PartitionField("name", "identity")])
        rows = spark.range(0, n, 1, 1).selectExpr("id", "element_at(array('a', 'b', NULL), cast(id % 3 as int) + 1) name")
        context.setJobGroup(f"append{n}", "")
        try:
            Ingestor(catalog, f"t{n}").append(rows)
            context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        stages = {s for j in tracker.getJobIdsForGroup(f"append{n}") for s in tracker.getJobInfo(j).stageIds}
        most[n] = max(store.lastStageAttempt(s).peakExecutionMemory() for s in stages)
        files = catalog.list_data_files(f"t{n}")
        assert sorted((f.lower["name"], f.upper["name"], f.record_count, f.file_size > 0) for f in files if f.lower["name"]) == [(x, x, n // 3, True) for x in "ab"]
        assert sum(f.record_count for f in files) == n == catalog.table(f"t{n}").distinct().count()
    assert most[900_000] <= most[9]


def test_a_task_may_have_more_partitions_than_open_files(spark, catalog):
    catalog.create_table("t", SCHEMA, [PartitionField("name", "identity")])
    rows = spark.range(0, 1200, 1, 1).selectExpr("cast(id as int) id", "concat('n', id % 40) name", "cast(id as double) value")
    Ingestor(catalog, "t").append(rows.coalesce(1))
    files = catalog.list_data_files("t")
    assert catalog.table("t").exceptAll(rows).count() == 0 and catalog.table("t").count() == 1200
    assert len(files) == 40 and {f.record_count for f in files} == {30} and all(f.lower["name"] == f.upper["name"] == f.partition_values["name_identity"] for f in files)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
