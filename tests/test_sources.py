import datetime as dt

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from saltmarsh.errors import InvalidArgument, SchemaMismatch
from saltmarsh.sources import parquet
from saltmarsh.sources.json_rows import parse_array, read_lines
from saltmarsh.sources.storage import Storage

ALL = T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("u", T.DecimalType(20, 0)), T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()),
    T.StructField("b", T.BooleanType()), T.StructField("s", T.StringType()), T.StructField("x", T.BinaryType()), T.StructField("t", T.TimestampNTZType()),
])
GOOD = '{"i": -5, "l": 9007199254740993, "u": 18446744073709551615, "f": 1, "d": 2.5, "b": true, "s": "é \\"q\\" {}", "x": "raw", "t": 1500, "unknown": {"a": 1}}'
WANTED = (-5, 9007199254740993, 18446744073709551615, 1.0, 2.5, True, 'é "q" {}', bytearray(b"raw"), dt.datetime(1970, 1, 1, 0, 0, 1, 500000))


def lines(spark, *texts):
    return spark.createDataFrame([(x,) for x in texts], "value string")


def test_json_values(spark):
    for df in (parse_array(spark, f"[{GOOD}, {{}}]", ALL), read_lines(lines(spark, GOOD, "{}"), ALL)):
        found = df.collect()
        assert tuple(found[0]) == WANTED
        assert tuple(found[1]) == (None,) * 9


@pytest.mark.parametrize("text", ['{"i": 1.5}', '{"i": 3000000000}', '{"i": "1"}', '{"b": "true"}', '{"s": 5}', '{"s": {"a": 1}}', '{"t": "2020-01-01"}', '{"u": -1}', '{"d": "1"}', '{"x": 7}', '{"u": 18446744073709551616}'])
def test_json_strictness(spark, text):
    with pytest.raises((PySparkException, Py4JJavaError)):
        parse_array(spark, f"[{text}]", ALL).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_lines(lines(spark, text), ALL).collect()


def test_json_shapes(spark):
    assert parse_array(spark, "[]", ALL).count() == 0
    for bad in ("{", '{"i": 1}', "[1]", "5"):
        with pytest.raises(InvalidArgument):
            parse_array(spark, bad, ALL)
    needed = T.StructType([T.StructField("i", T.IntegerType(), False)])
    for make in (lambda t: parse_array(spark, f"[{t}]", needed), lambda t: read_lines(lines(spark, t), needed)):
        for text in ("{}", '{"i": null}'):
            with pytest.raises((PySparkException, Py4JJavaError), match="NOT NULL"):
                make(text).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_lines(lines(spark, "[1]"), ALL).collect()


def test_parquet_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id * 1.5D d", "nullif(cast(id as string), '3') s").coalesce(1).write.parquet(path)
    assert parquet.read(spark, path, ["s", "id", "none"]).columns == ["s", "id"]
    assert parquet.read(spark, path, [2, 0]).columns == ["s", "id"]
    with pytest.raises(InvalidArgument):
        parquet.read(spark, path, ["none"])
    with pytest.raises(InvalidArgument):
        parquet.read(spark, path, [3])
    file = next(x.path for x in Storage(spark).list(path) if x.path.endswith(".parquet"))
    assert parquet.row_groups(file) == 1 and parquet.read_row_group(spark, file, 0, ["id"]).count() == 10
    with pytest.raises(InvalidArgument):
        parquet.read_row_group(spark, file, 1)
    page = parquet.page(spark, path, None, 2, 3)
    assert page.total_rows == 10 and page.has_more
    assert [tuple(r) for r in page.rows.collect()] == [("2", "3.000000", "2"), ("3", "4.500000", None), ("4", "6.000000", "4")]
    assert not parquet.page(spark, path, ["id"], 9, 5).has_more
    with pytest.raises(SchemaMismatch):
        parquet.write(spark.range(1).select(), str(tmp_path / "u"))
    size, files, folders = Storage(spark).directory_info(path)
    assert size > 0 and files >= 2 and folders == 0
