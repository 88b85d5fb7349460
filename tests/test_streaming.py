from arborloom.plans.grammar import hmm
from arborloom.streaming import lines


def test_lines_are_parsed_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x y y\n\nx z\n")
    stream = lines.parsed_lines(spark, str(tmp_path / "in"), hmm(), {"x": 0, "y": 1}, unknown=1)
    q = stream.writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    paths = sorted(r.path for r in spark.table("parsed").collect())
    assert len(paths) == 3 and paths[0] == [] and [0, 1, 1] in paths


def test_windows_over_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:20:00", "a", 2.0), (2, "2024-01-01 03:00:00", "b", 5.0)]
    df = spark.createDataFrame(rows, "user_id bigint, t string, event_type string, value double").selectExpr("user_id", "cast(t as timestamp) ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = lines.tumbling_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("hours").collect()) == [("a", 2, 3.0), ("b", 1, 5.0)]
    assert sorted((r.user_id, r.n) for r in lines.session_counts(df).collect()) == [(1, 2), (2, 1)]
