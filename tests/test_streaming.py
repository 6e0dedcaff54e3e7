import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import types as T

from saltmarsh.sources.catalog import Catalog
from saltmarsh.sources.ingest import Ingestor
from saltmarsh.sources.kv import KvDatabase
from saltmarsh.streaming.append import to_log, to_table

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def test_stream_to_table_commits_each_batch_once(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    catalog = Catalog(spark, str(tmp_path / "lake"))
    catalog.create_table("t", SCHEMA)
    for i in range(2):
        spark.createDataFrame([(i, "a"), (i + 10, "b")], SCHEMA).write.mode("append").parquet(source)
        to_table(spark.readStream.schema(SCHEMA).parquet(source), catalog, "t", mark).awaitTermination()
    assert sorted(r.id for r in catalog.table("t").collect()) == [0, 1, 10, 11]
    assert sorted(r.id for r in catalog.table("t", snapshot_id=1).collect()) == [0, 10]


def test_a_batch_that_fails_around_its_commit_is_committed_once(spark, tmp_path, monkeypatch):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    catalog = Catalog(spark, str(tmp_path / "lake"))
    catalog.create_table("t", SCHEMA)
    spark.createDataFrame([(i, "a") for i in range(5)], SCHEMA).write.parquet(source)
    plain = Catalog.create_snapshot

    def run():
        to_table(spark.readStream.schema(SCHEMA).parquet(source), catalog, "t", mark).awaitTermination()

    def before(self, *args, **more):
        raise OSError("lost before")

    def after(self, *args, **more):
        plain(self, *args, **more)
        raise OSError("lost after")

    for broken, rows in ((before, 0), (after, 5)):
        monkeypatch.setattr(Catalog, "create_snapshot", broken)
        with pytest.raises(StreamingQueryException):
            run()
        monkeypatch.undo()
        assert catalog.table("t").count() == rows
    run()
    assert catalog.table("t").count() == 5 and len(catalog.load_table("t").snapshots) == 2
    number = int(next(v for k, v in catalog.load_table("t").properties.items() if k.startswith("stream.")))
    key = next(k for k in catalog.load_table("t").properties if k.startswith("stream."))
    Ingestor(catalog, "t").append(spark.createDataFrame([(9, "z")], SCHEMA), once=(key, number))
    assert catalog.table("t").count() == 5


def test_stream_to_log(spark, tmp_path):
    source = str(tmp_path / "in")
    table = KvDatabase(spark, str(tmp_path / "kv")).create_text_table("t")
    spark.createDataFrame([("k", 1, False, "a"), ("k", 2, False, "b"), ("x", 1, True, None)], table.log_schema).write.parquet(source)
    to_log(spark.readStream.schema(table.log_schema).parquet(source), table, str(tmp_path / "mark")).awaitTermination()
    assert [(r.key, r.value) for r in table.scan().collect()] == [("k", "b")]
