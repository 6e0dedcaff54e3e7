import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from saltmarsh.errors import InvalidArgument
from saltmarsh.functions.transforms import PartitionField, check_field, transform


def values(spark, data, kind, field):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("c", kind)]))
    return [r.v for r in df.select("i", transform(field, kind).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("kind", "field", "given_", "wanted"),
    [
        (T.StringType(), PartitionField("c", "year"), ["2020-01-15", "06/20/2020", "2021/03/10", "30-11-2021", None], [2020, 2020, 2021, 2021, None]),
        (T.StringType(), PartitionField("c", "month"), ["2020-01-15", "06/20/2020", "2021/03/10", "30-11-2021"], [1, 6, 3, 11]),
        (T.StringType(), PartitionField("c", "hour"), ["2020-01-15 13:00:00", "2020-01-15"], [13, 0]),
        (T.IntegerType(), PartitionField("c", "bucket", 3), [1, 11, 21, 31, 41, -1, None], [1, 2, 0, 1, 2, 2, None]),
        (T.LongType(), PartitionField("c", "bucket", 3), [100, 200, 300, 400, 500], [1, 2, 0, 1, 2]),
        (T.DoubleType(), PartitionField("c", "bucket", 3), [1.5, 2.5, 3.5, 4.5, 5.5, -1.5], [1, 2, 0, 1, 2, 2]),
        (T.IntegerType(), PartitionField("c", "truncate", 3), [12345, 67890, 11111, 22222, -12345, None], [12000, 67000, 11000, 22000, -12000, None]),
        (T.StringType(), PartitionField("c", "truncate", 4), ["hello", "world", "test", "long_string", "é", None], ["hell", "worl", "test", "long", "é", None]),
        (T.BooleanType(), PartitionField("c", "identity"), [True, None], ["true", None]),
    ],
)
def test_transforms(spark, kind, field, given_, wanted):
    assert values(spark, given_, kind, field) == wanted


def test_times(spark):
    times = [dt.datetime(2020, 1, 1), dt.datetime(2020, 6, 15, 12, 30, 45, 123000), dt.datetime(2021, 12, 31, 23, 59, 59)]
    for unit, wanted in (("year", [2020, 2020, 2021]), ("month", [1, 6, 12]), ("day", [1, 15, 31]), ("hour", [0, 12, 23])):
        assert values(spark, times, T.TimestampNTZType(), PartitionField("c", unit)) == wanted


def test_errors(spark):
    with pytest.raises(PySparkException, match="not a date"):
        values(spark, ["soon"], T.StringType(), PartitionField("c", "year"))
    schema = T.StructType([T.StructField("c", T.DoubleType())])
    for bad in (PartitionField("c", "bucket"), PartitionField("c", "bucket", 0), PartitionField("c", "truncate", 2), PartitionField("d", "identity"), PartitionField("c", "week"), PartitionField("c", "year")):
        with pytest.raises(InvalidArgument):
            check_field(bad, schema)
    assert PartitionField("c", "bucket", 4, "c").column == "c_bucket4"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=50), st.integers(1, 1000), st.integers(1, 20))
def test_bucket_and_truncate_agree_with_arithmetic(spark, data, n, w):
    assert values(spark, data, T.LongType(), PartitionField("c", "bucket", n)) == [x % n for x in data]
    width = 10**w
    assert values(spark, data, T.LongType(), PartitionField("c", "truncate", w)) == [(abs(x) // width * width) * (1 if x >= 0 else -1) for x in data]


def test_other_types_have_a_bucket(spark):
    found = values(spark, ["a", "b", None, "a"], T.StringType(), PartitionField("c", "bucket", 5))
    assert found[0] == found[3] and found[2] is None and all(0 <= x < 5 for x in found if x is not None)
