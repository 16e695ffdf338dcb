import pytest
from pyspark.sql import functions as F

from speechgrain.sources import audits
from conftest import rows

SCHEMA = "session_id long, text string, n int"


def counted(calls):
    def audit(df):
        out = df.groupBy("session_id").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
        calls.append(sorted(r.session_id for r in out.collect()))
        return out

    return audit


def test_digests_tell_every_change_apart(spark):
    base = [(1, "a", 1), (1, "b", 2)]
    digest = lambda data, settings=None: audits.digests(spark.createDataFrame(data, SCHEMA), settings=settings).first().digest
    known = digest(base)
    assert digest(base[::-1]) == known
    others = [base[:1], base + base[:1], [(1, "a", 2), (1, "b", 1)], [(1, None, 1), (1, "b", 2)], [(1, "", 1), (1, "b", 2)], [(1, "a", None), (1, "b", 2)], base * 2]
    assert len({known, digest(base, {"k": 1}), digest(base, {"k": 2}), *map(digest, others)}) == len(others) + 3
    swapped = spark.createDataFrame([(1, None, 5), (1, 5, None)], "session_id long, a int, b int")
    assert audits.digests(swapped.where("a is null")).first() != audits.digests(swapped.where("b is null")).first()


def test_only_changed_sessions_are_audited(spark, tmp_path):
    store, calls = audits.AuditStore(spark, "file://" + str(tmp_path / "store")), []
    assert store.read() is None
    data = [(s, f"t{k}", k) for s in range(6) for k in range(3)]
    frame = lambda d: spark.createDataFrame(d, SCHEMA)
    assert store.update(frame(data), counted(calls)) == (6, 0)
    assert store.update(frame(data[::-1]), counted(calls)) == (0, 0) and len(calls) == 1 and len(store.commits()) == 1
    later = [r for r in data if r[0] != 4 and r != (2, "t1", 1)] + [(9, "new", 7)]
    assert store.update(frame(later), counted(calls)) == (2, 1) and calls[1] == [2, 9]
    assert rows(store.read().select("session_id", "rows", "total", "run"), "session_id") == [(0, 3, 3, 1), (1, 3, 3, 1), (2, 2, 2, 2), (3, 3, 3, 1), (5, 3, 3, 1), (9, 1, 7, 2)]
    assert store.update(frame(data), counted(calls)) == (2, 1) and calls[2] == [2, 4]  # one comes back
    assert store.update(frame(data), counted(calls), {"ratio": 3}) == (6, 0)  # other settings
    before = rows(store.read().drop("run"), "session_id")
    store.fold()
    assert len(store.commits()) == 1 and rows(store.read().drop("run"), "session_id") == before
    assert store.update(frame(data), counted(calls), {"ratio": 3}) == (0, 0)
    assert store.update(frame([]), counted(calls)) == (0, 6) and store.read().count() == 0


def test_a_second_run_reads_digests_alone(spark, tmp_path):
    store = audits.AuditStore(spark, "file://" + str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    store.update(df, counted([]))
    files = store._latest(store.commits()).inputFiles()
    assert files and all("/digests/" in f for f in files)

    def never(_):
        raise AssertionError("audited again")

    assert store.update(df, never) == (0, 0)


def test_a_run_that_dies_or_comes_second_changes_nothing(spark, tmp_path):
    store = audits.AuditStore(spark, "file://" + str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    store.update(df, counted([]))

    def dies(_):
        raise OSError("lost")

    other = df.withColumn("n", F.lit(5))
    with pytest.raises(OSError):
        store.update(other, dies)

    def overtaken(rows_):
        audits.AuditStore(spark, store.path).update(df.withColumn("n", F.lit(8)), counted([]))
        return counted([])(rows_)

    with pytest.raises(RuntimeError):
        store.update(other, overtaken)
    assert rows(store.read().select("total", "run")) == [(8, 2)]
