import pytest

from vanewright.sources import readers, writers


@pytest.fixture
def files(tmp_path):
    (tmp_path / "e.csv").write_text("time_stamp;asset_id; id;status_type_id;sensor_1_avg;power_2_std\n2024-01-01 00:00:00;7;1;0;1.5;x\n2024-01-01 00:00:00;7;2;0;2.5;nan\nbad;7;3;0;1;1\n2024-01-01 00:10:00;7;4;5.0;inf;4\n")
    (tmp_path / "info.csv").write_text("event_id,event_label,event_start,event_end\n1.0,Anomaly,2024-01-01,2024-01-02\n2,normal,2024-01-03,2024-01-03\n1,normal,2024-01-04,2024-01-05\n")
    (tmp_path / "f.csv").write_text("sensor_name\tdescription\tis_angle\nSensor 1\tGear oil temp\tTrue\nsensor-1\tother\tFalse\n")
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    return tmp_path


def test_series(spark, files):
    s = readers.read_series(spark, str(files / "e.csv"))
    rows = [tuple(r) for r in s.orderBy("ts").select("id", "status", "sensor_1_avg", "power_2_std").collect()]
    assert rows == [(2, "0", 2.5, None), (4, "5", None, 4.0)]
    assert readers.read_series(spark, str(files / "e.csv"), keep="first").orderBy("ts").first()["id"] == 1
    assert readers.long_series(s, ["sensor_1_avg", "power_2_std"]).count() == 2
    assert readers.valid_columns(s, ["sensor_1_avg", "power_2_std"], 0.6) == []


def test_event_info(spark, files):
    rows = readers.read_event_info(spark, str(files / "info.csv"), "C").collect()
    assert [(r["event_id"], r["label"], r["farm_id"]) for r in rows] == [("1", "normal", "C")]
    with pytest.raises(Exception, match="invalid interval"):
        readers.read_event_info(spark, str(files / "info.csv"), strict=True).collect()


def test_descriptions_and_missing_columns(spark, files):
    r = readers.read_feature_descriptions(spark, str(files / "f.csv")).collect()
    assert len(r) == 1 and r[0]["name"] == "sensor_1" and r[0]["is_angle"]
    with pytest.raises(ValueError):
        readers.read_series(spark, str(files / "f.csv"))


def test_json_and_resume(spark, files, tmp_path):
    df = readers.read_json_lines(spark, str(files / "x.jsonl"), "id long")
    assert readers.pending(df, df.where("id = 1"), ["id"]).count() == 1
    assert readers.read_manifest(spark, str(tmp_path / "none.json")) == {}
    writers.write_manifest(spark, {"a": float("nan"), "b": [1, (2,)]}, str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ['{"a": null, "b": [1, [2]]}'] and readers.read_manifest(spark, str(tmp_path / "m"))["b"] is not None
    writers.write_delimited(spark.createDataFrame([(1.0, [1, 2]), (float("inf"), None)], "v double, a array<int>"), str(tmp_path / "c"), ";")
    back = readers.read_delimited(spark, str(tmp_path / "c"))
    assert back.columns == ["v", "a"] and back.where("v is null").count() == 1


def test_resolving_files(spark, files):
    assert readers.resolve_one(spark, str(files), ["none.csv", "e.csv"]).endswith("/e.csv") and readers.resolve_one(spark, str(files), [], "x.*").endswith("x.jsonl")
    with pytest.raises(FileNotFoundError):
        readers.resolve_one(spark, str(files), [], "*.csv")
    with pytest.raises(FileNotFoundError):
        readers.resolve_one(spark, str(files), ["none"])
    assert readers.resolve_one(spark, str(files), ["none"], required=False) is None and set(readers.discover(spark, str(files))) == {"e", "info", "f"}


def test_one_asset_and_cached_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "asset string, v int")
    assert readers.one_asset(df.where("v = 1"), "asset").count() == 1
    with pytest.raises(Exception, match="several assets"):
        readers.one_asset(df, "asset").collect()
    at = str(tmp_path / "cache")
    assert [writers.append_rows(x, at, "asset") for x in (df.where("v = 1"), df, df)] == [1, 1, 0] and spark.read.parquet(at).count() == 2


def test_manifest_text():
    import datetime as dt

    import numpy as np

    assert writers.manifest_text({"n": np.float64("nan"), "i": np.int64(3), "t": dt.date(2024, 1, 2), "s": {2, 1}}) == '{"n": null, "i": 3, "t": "2024-01-02", "s": [1, 2]}'
