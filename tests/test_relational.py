import pytest
from pyspark.sql import functions as F

from saltmarsh.errors import InvalidArgument, SchemaMismatch
from saltmarsh.functions.scalar import interval_text, like, result_text, time_text
from saltmarsh.operators import relational as R

USERS = [(1, "Alice", 25, 75000.0), (2, "Bob", 30, 85000.0), (3, "Charlie", 35, 95000.0), (4, "David", 40, 105000.0), (5, "Eve", 45, 115000.0)]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "id int, name string, age int, salary double")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_filter_and_global_aggregates(users):
    assert users.where("age > 30").count() == 3
    out = R.aggregate(users, [], [("count", "*"), ("sum", "age"), ("avg", "age"), ("min", "age"), ("max", "age"), ("min", "name")])
    assert out.columns == ["count", "sum_age", "avg_age", "min_age", "max_age", "min_name"]
    assert rows(out) == [(5, 175, 35.0, 25, 45, "Alice")]


def test_group_by_nulls(spark):
    df = spark.createDataFrame([(1, 10), (1, None), (2, 30), (None, 40)], "a int, b int")
    calls = [("sum", "b"), ("avg", "b"), ("count", "b")]
    assert sorted(rows(R.aggregate(df, ["a"], calls)), key=str) == [(1, 10, 10.0, 1), (2, 30, 30.0, 1), (None, 40, 40.0, 1)]
    assert {r.a: r.count_b for r in R.aggregate(df, ["a"], calls, "all").collect()} == {1: 2, 2: 1, None: 1}
    empty = df.where("a > 9")
    assert rows(R.aggregate(empty, [], [("count", "b", "n"), ("sum", "b")])) == [(0, None)]
    nulls = spark.createDataFrame([(None,)] * 3, "x int")
    assert rows(R.aggregate(nulls, [], [("count", "x", "n")])) == [(0,)]
    assert rows(R.aggregate(nulls, [], [("count", "x", "n")], "all")) == [(3,)]
    assert rows(R.aggregate(spark.createDataFrame([(-5.0,), (-2.5,)], "x double"), [], [("max", "x")])) == [(-2.5,)]
    with pytest.raises(InvalidArgument):
        R.aggregate(df, [], [("median", "a")])


def test_join_names_and_nulls(spark):
    left = spark.createDataFrame([(1, "A", "d1", 10.0), (2, "B", "d2", 20.0), (None, "C", "d3", 5.0)], "id int, name string, dept string, salary double")
    right = spark.createDataFrame([(1, "x", 1.0, "north"), (2, "y", 2.0, "south"), (None, "z", 3.0, "west"), (4, "w", 4.0, "east")], "id int, dept string, salary double, location string")
    out = R.join(left, right, "id", "id")
    assert out.columns == ["id", "name", "dept", "salary", "right_dept", "right_salary", "location"]
    assert sorted(r.id for r in out.collect()) == [1, 2]
    full = R.join(left, right, "id", "id", "full")
    assert sorted(rows(full.select("id", "name", "location")), key=str) == sorted([(1, "A", "north"), (2, "B", "south"), (None, "C", None), (None, None, "west"), (4, None, "east")], key=str)
    assert R.join(left, right, "id", "id", "left").count() == 3
    assert R.join(left, right, "id", "id", "right").count() == 4
    assert rows(R.join(left, right, "id", "id", "anti").select("name")) == [("C",)]
    keyed = R.join(left.select("id", "name"), right.withColumnRenamed("id", "dept_id"), "id", "dept_id")
    assert keyed.columns == ["id", "name", "dept_id", "dept", "salary", "location"]


def test_join_duplicates_and_theta(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "key int")
    b = spark.createDataFrame([(1,), (1,), (3,)], "key int")
    assert R.join(a, b, "key", "key").count() == 4
    assert R.theta_join(a.withColumnRenamed("key", "x"), b, F.col("x") > F.col("key")).count() == 2
    with pytest.raises(InvalidArgument):
        R.join(a, b, "key", "key", "sideways")


def test_sort_and_limit(spark):
    people = spark.createDataFrame([("Bob", 30), ("Alice", 30), ("Charlie", 25), ("David", 25), ("Eve", 35)], "name string, age int")
    assert [r.name for r in R.order(people, "age", ("name", "desc")).collect()] == ["David", "Charlie", "Bob", "Alice", "Eve"]
    ages = spark.createDataFrame([(25,), (None,), (35,), (None,), (45,)], "age int")
    assert [r.age for r in R.order(ages, "age").collect()] == [None, None, 25, 35, 45]
    assert [r.age for r in R.order(ages, ("age", "desc")).collect()] == [None, None, 45, 35, 25]
    assert [r.age for r in R.order(ages, "age", nulls_first=False).collect()] == [25, 35, 45, None, None]
    ordered = R.order(people, "name")
    assert [r.name for r in R.limit(ordered, 2, 1).collect()] == ["Bob", "Charlie"]
    assert R.limit(ordered, 0).count() == 0 and R.limit(ordered, 5, 9).count() == 0
    with pytest.raises(InvalidArgument):
        R.limit(ordered, -1)
    with pytest.raises(InvalidArgument):
        R.order(people, "height")


def test_concat_needs_equal_columns(spark, users):
    assert R.concat(users, users.limit(2)).count() == 7
    with pytest.raises(SchemaMismatch):
        R.concat(users, users.select("id", "name"))


LIKES = [
    ("John Smith", "%Smith%", True), ("John Doe", "%Smith%", False), ("test", "test", True), ("test123", "test%", True), ("123test", "%test", True), ("test", "t_st", True),
    ("test", "_est", True), ("test", "t__t", True), ("test", "t___t", False), ("abc123xyz", "%123%xyz", True), ("abc123xyz", "_bc%xyz", True), ("a\\b", "a\\b", True), ("a.b", "a_b", True), ("axb", "a.b", False),
]


def test_like_table(spark):
    one = spark.range(1)
    assert list(one.select(*(like(F.lit(s), p).alias(str(i)) for i, (s, p, _) in enumerate(LIKES))).first()) == [x for _, _, x in LIKES]


def test_texts(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2020-06-15 12:30:45.123' t, 1.5D d, true b, CAST(NULL AS DOUBLE) n, 1500L us, 90000000L s, 7L z").select(
        time_text(F.col("t")), result_text(F.col("d"), "double"), result_text(F.col("b"), "boolean"), interval_text(F.col("us")), interval_text(F.col("s")), interval_text(F.col("z"))
    )
    assert list(row.first()) == ["2020-06-15 12:30:45.123000", "1.500000", "true", "1.5ms", "1.5m", "7us"]


def test_plans_push_down_and_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 v", "cast(id as string) s").write.parquet(path)
    plan = spark.read.parquet(path).where("v > 10").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,10)]" in plan and "struct<id:bigint,v:bigint>" in plan
