from siftline import api
from siftline.streaming.scan import arriving, findings_per_window, scan_stream

S = "Zx9" + "kQ2vB7" * 4


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a.env", f"API_TOKEN={S}\n"), ("b.env", "MODE=x\n")], "file string, text string").write.parquet(str(tmp_path / "in"))
    source = arriving(spark, str(tmp_path / "in"), "file string, text string")
    scan_stream(source, "file", "text", api.default_rules(), str(tmp_path / "out"), str(tmp_path / "check"), now=0).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.file, r.name) for r in found.collect()] == [("a.env", "API_TOKEN")]


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 00:11:00", "b")]
    frame = spark.createDataFrame(rows, "t string, reason string").selectExpr("cast(t as timestamp) as t", "reason")
    assert sorted((r.reason, r.n) for r in findings_per_window(frame, "t").collect()) == [("a", 2), ("b", 1)]
