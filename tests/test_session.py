from pathlib import Path

from pyspark.sql import functions as F

from arborloom import session


def folder(df):
    return Path(df._arborloom_path.removeprefix("file:"))


def test_written_tables_are_dropped(spark):
    t = session.written(spark.range(10), "test")
    assert folder(t).exists() and t.count() == 10
    session.dropped(t)
    assert not folder(t).exists()
    session.dropped(spark.range(3))  # nothing to remove


def test_small_sides_are_measured(spark):
    calls = []
    side = spark.range(100).select("id", F.lit("x").alias("x"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(session.small_side(side)) and not hinted(session.small_side(side, rows=99)) and not hinted(session.small_side(side, size=10))
    t = session.written(side, "side")
    assert session.small_side(t, rows=1) is t and calls == []


def test_each_key_once(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d"), (3, None), (3, None)], "k int, v string")
    pick = lambda d: d.groupBy("k").agg(F.min("v").alias("v"))
    assert sorted(session.once_each(rows, "k", pick).collect()) == [(1, "a"), (2, "c"), (3, None)]
    assert session.once_each(rows.limit(0), "k", pick).count() == 0
