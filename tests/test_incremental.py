import pytest
from pyspark.sql import functions as F

from quire.operators.incremental import CommitConflict, Manifest, VersionedTable, import_log, pending, process_new

RECORDS = "key string, run_id int, action string"
RUNS = "run_id int, status string"


def keys(df):
    return sorted(r[0] for r in df.collect())


def pending_keys(now, rec, runs, path):
    return pending(now, rec, runs, str(path)).added


def test_pending_keys(spark, tmp_path):
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "succeeded"), (4, "running"), (None, "succeeded"), (5, None), (1, "succeeded")], RUNS)
    rec = spark.createDataFrame(
        [("A", 1, "put"), ("b", 1, "put"), ("B", 3, "drop"), ("c", 2, "put"), ("d", 3, "put"), ("d", 1, "drop"), ("e", 4, "put"), ("f", 3, "put"), ("f", 3, "drop"), (None, 1, "put"), ("A", 1, "put"), ("g", 1, None)],
        RECORDS,
    )
    now = spark.createDataFrame([(k,) for k in ["a", "A", "b", "c", "D", "e", "f", "g", "h", None]], "key string")
    assert keys(pending_keys(now, rec, runs, tmp_path / "0")) == ["b", "c", "e", "f", "g", "h"]
    gone = spark.createDataFrame([("a", 1, "put"), ("a", 3, "put"), ("h", 3, "put"), ("h", 1, "put")], RECORDS)
    assert keys(pending(now.where("key <> 'h'"), gone, runs, str(tmp_path / "gone")).removed) == ["h"]
    assert keys(pending_keys(now.limit(0), rec, runs, tmp_path / "1")) == []
    assert keys(pending_keys(now, rec.limit(0), runs, tmp_path / "2")) == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert keys(pending_keys(now, rec, runs.limit(0), tmp_path / "3")) == ["a", "b", "c", "d", "e", "f", "g", "h"]


def test_extra_columns_with_clashing_names(spark, tmp_path):
    runs = spark.createDataFrame([(1, "succeeded", "x")], RUNS + ", key string")
    rec = spark.createDataFrame([("a", 1, "put", 9)], RECORDS + ", _written_by int")
    now = spark.createDataFrame([("a", "put"), ("b", "put")], "key string, action string")
    assert keys(pending_keys(now, rec, runs, tmp_path)) == ["b"]


@pytest.fixture
def pair(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v int").schema
    return VersionedTable(spark, str(tmp_path / "src"), schema, "k"), VersionedTable(spark, str(tmp_path / "out"), schema, "k")


def rows(df):
    return sorted((r.k or "", r.v) for r in df.collect())


def test_versions_and_changes(spark, pair):
    t, _ = pair
    make = lambda *r: spark.createDataFrame(list(r), t.schema)
    assert t.latest() == 0 and rows(t.read()) == []
    t.commit(make(("a", 1), ("b", 2), (None, 3)))
    t.commit(make(("c", 4)), deleted_keys=spark.createDataFrame([("a",), (None,)], "k string"))
    assert rows(t.read()) == [("", 3), ("b", 2), ("c", 4)]
    assert rows(t.read(1)) == [("", 3), ("a", 1), ("b", 2)]
    d = t.changes(1)
    assert (rows(d.added), rows(d.removed)) == ([("c", 4)], [("a", 1)])
    t.commit(make(("a", 7)), drop_files=sorted(set(t.manifest().files) - set(t.manifest(1).files)))
    d = t.changes(1)
    assert (rows(d.added), rows(d.removed)) == ([("a", 7)], [("a", 1)])
    d = t.changes(2)
    assert (rows(d.added), rows(d.removed)) == ([("a", 7)], [("c", 4)])
    with pytest.raises(CommitConflict):
        t.publish(Manifest(2))


def test_process_new_survives_failures(spark, pair):
    src, out = pair
    make = lambda *r: spark.createDataFrame(list(r), src.schema)
    seen = []

    def step(delta):
        seen.append((rows(delta.added), rows(delta.removed)))
        return delta.added.withColumn("v", F.col("v") * 10), delta.removed.select("k")

    def broken(delta):
        out._write(delta.added, "data", 1)  # files of a run that dies belong to no version
        raise OSError("lost")

    src.commit(make(("a", 1), ("b", 2)))
    with pytest.raises(OSError):
        process_new(src, out, broken)
    assert out.latest() == 0
    process_new(src, out, step)
    assert process_new(src, out, step) is None
    src.commit(make(("b", 5)), deleted_keys=make(("b", 0)))
    src.commit(make(("c", 6)))
    with pytest.raises(OSError):
        process_new(src, out, broken)
    process_new(src, out, step)
    assert rows(out.read()) == [("a", 10), ("b", 50), ("c", 60)]
    assert seen == [([("a", 1), ("b", 2)], []), ([("b", 5), ("c", 6)], [("b", 2)])]


def test_rewrites_are_no_change(spark, pair):
    t, _ = pair
    make = lambda *r: spark.createDataFrame(list(r), t.schema)
    t.commit(make(*((f"k{i}", i) for i in range(50)), ("a", 1), ("a", 1)))
    t.commit(t.read(), rewrite=True)
    d = t.changes(1)
    assert rows(d.added) == rows(d.removed) == []
    t.commit(make(("b", 2)), deleted_keys=make(("a", 0)))
    t.commit(t.read(), rewrite=True)
    t.commit(make(("c", 3)))
    for since in (1, 2):
        d = t.changes(since)
        assert (rows(d.added), rows(d.removed)) == ([("b", 2), ("c", 3)], [("a", 1), ("a", 1)])
    d = t.changes(4)
    assert (rows(d.added), rows(d.removed)) == ([("c", 3)], [])
    t.commit(make(("c", 3), ("d", 4)), replace=True)
    d = t.changes(5)
    assert rows(d.added) == [("d", 4)] and len(rows(d.removed)) == 51 and rows(t.read()) == [("c", 3), ("d", 4)]


def test_of_two_writers_one_fails(spark, pair):
    from concurrent.futures import ThreadPoolExecutor

    t, _ = pair

    def attempt(i):
        try:
            return t.publish(Manifest(1, meta={"by": i}))
        except CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sorted(filter(None, pool.map(attempt, range(8)))) == [1]
    assert t.latest() == 1


def test_many_commits_are_one_plan(spark, pair):
    t, _ = pair
    make = lambda *r: spark.createDataFrame(list(r), t.schema)
    for i in range(4):
        t.commit(make((f"k{i}", i), ("x", i)), deleted_keys=make(("x", 0)))
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and rows(t.read()) == [("k0", 0), ("k1", 1), ("k2", 2), ("k3", 3), ("x", 3)]


def test_log_grows_and_changes(spark, tmp_path):
    from pyspark.sql.types import StructType

    t = VersionedTable(spark, str(tmp_path), StructType.fromDDL("key string"), "key", True)
    rec = spark.createDataFrame([("a", 1, "put"), ("b", 1, "put"), ("c", 2, "put"), ("a", 3, "drop"), ("d", 3, "put"), ("B", 4, "drop"), ("c", 3, "put")], RECORDS)
    runs = lambda *ok: spark.createDataFrame([(i, "succeeded" if i in ok else "failed") for i in range(1, 5)], RUNS)
    assert import_log(t, rec, runs(1)) == 2 and keys(t.read()) == ["a", "b"]
    assert import_log(t, rec, runs(1)) == 2
    assert import_log(t, rec, runs(1, 3)) == 4 and keys(t.read()) == ["b", "c", "d"]
    assert import_log(t, rec, runs(1, 2, 3)) == 10 and keys(t.read()) == ["b", "c", "d"]  # an older run came to success: built anew
    d = t.changes(4)
    assert (keys(d.added), keys(d.removed)) == ([], [])
    import_log(t, rec, runs(1, 2, 3, 4))
    assert keys(t.read()) == ["c", "d"] and keys(t.read(2)) == ["a", "b"]
