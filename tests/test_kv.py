import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from saltmarsh.errors import InvalidArgument, KeyNotFound, TableExists, TableNotFound
from saltmarsh.operators import kv
from saltmarsh.sources.kv import KvDatabase
from saltmarsh.sources.storage import Storage

USER = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])


@pytest.fixture
def db(spark, tmp_path):
    return KvDatabase(spark, str(tmp_path / "kv"))


def keys(df):
    return [r.key for r in df.collect()]


def test_registry(db):
    db.create_table("a.b-c_1", USER)
    with pytest.raises(TableExists):
        db.create_table("a.b-c_1", USER)
    for bad in ("", "a b", "a/b"):
        with pytest.raises(InvalidArgument):
            db.create_table(bad, USER)
    with pytest.raises(InvalidArgument):
        db.create_text_table("t", USER)
    db.create_text_table("t")
    assert db.list_tables() == ["a.b-c_1", "t"]
    db.drop_table("t")
    with pytest.raises(TableNotFound):
        db.table("t")


def test_versions_and_tombstones(db):
    t = db.create_text_table("t")
    t1 = t.put_batch([("key1", {"value": "v1"}), ("key2", {"value": "v1"})])
    t.put("key1", value="v2")
    t2 = t.delete("key2")
    t.put_batch([("key1", {"value": "v3"}), ("key2", {"value": "v2"})])
    state = lambda at, **more: sorted(((r.key, r.value, r.deleted) for r in t.snapshot(at, **more).collect()), key=str)
    assert state(t1) == [("key1", "v1", False), ("key2", "v1", False)]
    assert state(t2) == [("key1", "v2", False)]
    assert state(t2, tombstones=True) == [("key1", "v2", False), ("key2", None, True)]
    assert len(state(None, all_versions=True, tombstones=True)) == 6
    assert t.get("key1") == {"value": "v3"} and t.get("key1", t1) == {"value": "v1"}
    with pytest.raises(KeyNotFound):
        t.get("key2", t2)
    before = sorted(map(str, t.log().collect()))
    assert t.compact()["files_before"] >= 4
    assert sorted(map(str, t.log().collect())) == before


def test_scans_updates_and_absence(spark, db):
    t = db.create_table("t", USER)
    t.put_batch([(f"user:{i}", {"id": i, "name": f"n{i}"}) for i in (3, 1, 2)] + [(f"post:{i}", {"id": i}) for i in (2, 1)])
    assert keys(t.prefix_scan("user:")) == ["user:1", "user:2", "user:3"]
    assert keys(t.scan("post:2", "user:2")) == ["post:2", "user:1"]
    assert keys(t.scan(limit=2)) == ["post:1", "post:2"] and keys(t.scan("z")) == []
    assert t.put_if_absent("new", id=9) is True and t.put_if_absent("new", id=8) is False and t.get("new")["id"] == 9
    t.update_column("new", "name", "x")
    assert t.get("new") == {"id": 9, "name": "x"}
    with pytest.raises(InvalidArgument):
        t.update_column("new", "none", 1)
    t.delete("new", "never")
    assert t.put_if_absent("new", id=1) is True
    assert t.batch_get(["user:1", "nobody", "new"]) == {"user:1": {"id": 1, "name": "n1"}, "nobody": None, "new": {"id": 1, "name": None}}
    t.put_frame(spark.createDataFrame([("user:1", 100, "z")], "key string, id int, name string"))
    assert t.get("user:1") == {"id": 100, "name": "z"}
    with pytest.raises(InvalidArgument):
        t.put_frame(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, id int, name string"))


def test_limits(spark, db):
    t = db.create_text_table("t")
    for bad in ("", "k" * 4097):
        with pytest.raises(Exception, match="1 to 4096 bytes"):
            t.put(bad, value="v")
    t.put("k" * 4096, value="v")
    assert t.scan().count() == 1
    for bad in ("", "v" * (4 << 20) + "v", None):
        with pytest.raises(Exception, match="value must have 1 to 4194304 bytes"):
            t.put("k", value=bad)
    t.put("k", value="v" * (4 << 20))
    t.delete("k")
    assert t.scan().count() == 1
    u = db.create_table("u", USER)
    u.put("k", id=None, name=None)
    with pytest.raises(Exception, match="value must have"):
        u.put("k", id=1, name="n" * (4 << 20))
    assert u.get("k") == {"id": None, "name": None}


def test_compaction_keeps_what_is_appended_meanwhile(spark, db, monkeypatch):
    t = db.create_text_table("t")
    t.put("a", value="1")
    t.put("b", value="2")
    whole = kv.compacted

    def slow(*logs, **more):
        t.put("c", value="3")
        return whole(*logs, **more)

    monkeypatch.setattr(kv, "compacted", slow)
    t.compact()
    assert keys(t.scan()) == ["a", "b", "c"]
    monkeypatch.undo()
    assert t.compact()["files_before"] >= 2 and keys(t.scan()) == ["a", "b", "c"]
    t.put("a", value="4")
    old = t.log()
    t.compact()
    assert old.count() == 4, "the files that a compaction replaces stay for those who read them"
    t.compact()
    assert t.get("a") == {"value": "4"} and t.log().count() == 4 and len(t._appended()) == 0


def test_compaction_that_fails_loses_nothing(spark, db, monkeypatch):
    t = db.create_text_table("t")
    t.put_batch([("a", {"value": "1"}), ("b", {"value": "2"})])
    store = Storage

    def refused(self, path, text):
        raise OSError("lost")

    monkeypatch.setattr(store, "create", refused)
    with pytest.raises(OSError, match="lost"):
        t.compact()
    monkeypatch.undo()
    assert keys(t.scan()) == ["a", "b"]
    taken = store.create

    def late(self, path, text):
        taken(self, path, text)
        raise OSError("died after it was published")

    monkeypatch.setattr(store, "create", late)
    with pytest.raises(OSError, match="published"):
        t.compact()
    monkeypatch.undo()
    assert keys(t.scan()) == ["a", "b"] and t.log().count() == 2
    t.compact()
    assert keys(t.scan()) == ["a", "b"] and t.log().count() == 2


def test_an_append_that_fails_is_not_read(spark, db):
    t = db.create_text_table("t")
    t.put("a", value="1")
    df = spark.range(100).selectExpr("cast(id as string) key", "id version", "false deleted", "if(id = 99, '', 'v') value")
    with pytest.raises(Exception, match="value must have"):
        t.append(df.repartition(4))
    assert keys(t.scan()) == ["a"]


def test_equal_versions_have_one_defined_row(spark):
    rows = [("k", 1, False, v) for v in "abcdefgh"]
    ddl = "key string, version bigint, deleted boolean, value string"
    found = {kv.snapshot(spark.createDataFrame(r, ddl).repartition(3)).first().value for r in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(found) == 1
    assert kv.snapshot(spark.createDataFrame(rows + rows, ddl), all_versions=True).count() == 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.booleans(), st.integers(0, 9)), min_size=1, max_size=30), st.integers(0, 30))
def test_snapshot_is_a_replay(spark, changes, at):
    rows = [(k, i, d, None if d else v) for i, (k, d, v) in enumerate(changes)]
    state = {}
    for k, i, d, v in rows:
        if i <= at:
            state[k] = None if d else (i, v)
    found = kv.snapshot(spark.createDataFrame(rows, "key string, version bigint, deleted boolean, value int"), at)
    assert {r.key: (r.version, r.value) for r in found.collect()} == {k: v for k, v in state.items() if v}
