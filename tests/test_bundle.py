"""A bundle of very many events: few files, all rows, keys as they were."""

from pathlib import Path

from pyspark.sql import functions as F

from vanewright.sources import writers


def test_files_follow_from_rows_not_from_events(spark, tmp_path):
    df = spark.range(0, 3000, 1, 8).select((F.col("id") % 100).alias("event"), "id")
    writers.write_bundle({"rows": df, "events": df.select("event", F.lit("normal").alias("decision")).distinct()}, str(tmp_path / "b"), "event")
    for name, n in (("rows", 3000), ("events", 100)):
        back = spark.read.parquet(str(tmp_path / "b" / name))
        assert back.count() == n and back.select("event").distinct().count() == 100
        assert len(list(Path(tmp_path / "b" / name).rglob("*.parquet"))) <= 8
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "b" / "rows")).where("event = 13").collect()) == list(range(13, 3000, 100))


def test_keys_stay_as_they_were(spark, tmp_path):
    rows = [("007", 1), ("7", 2), ("", 3), (None, 4), ("a/b=c", 5), ("2024-01-01", 6)]
    writers.write_bundle({"rows": spark.createDataFrame(rows, "event string, v int")}, str(tmp_path / "b"), "event")
    assert sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "b" / "rows")).select("event", "v").collect()), key=lambda r: r[1]) == rows
