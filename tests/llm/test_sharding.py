from collections import defaultdict

import duckdb
import pytest

from saltmarsh.llm import sharding


def check(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for shard, own in by.items():
        assert sum(r.n_bytes for r in own) <= limit or len(own) == 1, shard
        assert all(r.shard_bytes == sum(x.n_bytes for x in own) and r.shard_rows == len(own) for r in own)
        assert not any(o != shard and shard and "-" not in o and o.startswith(shard) for o in by)
    return by


@pytest.mark.parametrize("limit", [500, 20_000, 10_000_000])
def test_shards_fit_and_split_only_when_oversized(docs, plain, limit):
    found = sharding.sharded(docs.withColumnRenamed("fp", "shard"), limit)
    assert found.columns == [c for c in docs.columns if c != "fp"] + ["n_bytes", "depth", "shard", "shard_bytes", "shard_rows"]
    rows = found.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, plain))
    by = check(rows, limit)
    # Two buckets of one parent together are too large: else the parent wouldn't have split.
    for shard, own in by.items():
        if shard and "-" not in shard:
            parent = [r for r in rows if r.shard.startswith(shard[:-1])]
            assert sum(r.n_bytes for r in parent) > limit and len(own) <= len(parent)


def test_equal_rows_fill_pages(spark):
    rows = [(None, "x" * 1000)] * 500 + [(i, "y" * (i % 50)) for i in range(300)] + [(7, None)] * 3 + [(8, "z" * 9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sharding.sharded(df, 5000).collect()
    assert len(found) == len(rows)
    by = check(found, 5000)
    assert len(by) < 140
    assert sharding.sharded(df.limit(0), 5000).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ["__g", "sharding_group", "sharding_hash", "sharding_place", "sharding_total", "sharding_page", "sharding_cell0", "sharding_depth0", "a b"]
    rows = [(i % 3, "x" * 900, *range(9)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    for limit in (2000, 10**6):
        found = sharding.sharded(df, limit)
        assert found.columns == [*df.columns, "n_bytes", "depth", "shard", "shard_bytes", "shard_rows"]
        assert {tuple(r)[2:11] for r in found.collect()} == {tuple(range(9))} and found.count() == 120


def test_sql_agrees_where_many_shards_are_needed(spark, tmp_path):
    rows = [(i, "ü" * (i * 37 % 400)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    wanted = con.execute(sharding.OP2_SQL.replace(str(sharding.LIMIT), "3000")).fetchall()
    found = sharding.sharded(df, 3000).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_rows").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_written_shards_are_read_back(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs.drop("fp", "score"), path, 20_000)
    assert spark.read.parquet(path).count() == docs.count()


def test_plan_is_native(docs):
    plan = sharding.sharded(docs, 20_000)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
