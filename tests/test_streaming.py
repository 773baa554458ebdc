import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vanewright.streaming.replay import episodes, replay, stream
from vanewright.streaming.step import Baseline, State, StreamConfig, step

CFG = StreamConfig(warmup=24, persistent_run=3, recovery_rows=2, merge_hours=0.5, trend_hours=2, localized_points=3, level=6, extreme=40, persistent_mean=2)
T0 = dt.datetime(2024, 1, 1)
SIGNALS = ["power_1_avg", "sensor_1_avg", "sensor_2_avg", "sensor_2_std", "sensor_3_avg"]


def table(spark, n=80, shift=(40, 55), dips=(44,)):
    """A shift of the sensors, and dips of power in it: what the localized detector confirms."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        x = rng.normal(100, 1, 5) + (np.array([0, 60, 60, 60, 60]) if shift[0] <= i < shift[1] else 0)
        x[0] = 20 if i in dips else x[0]
        rows.append(("s1", T0 + dt.timedelta(minutes=10 * i), "0", dict(zip(SIGNALS, map(float, x), strict=True))))
    return spark.createDataFrame(rows, "source string, ts timestamp, status string, values map<string,double>")


def test_baseline_update_uses_new_mean_and_clipped_step():
    b = Baseline(np.array([0.0]), np.array([1.0]))
    b.update(np.array([100.0]), 0.1, 6.0)
    assert np.isclose(b.mean[0], 0.6) and np.isclose(b.var[0], 0.9 + 0.1 * (100 - 0.6) ** 2)


def test_shift_opens_and_closes_one_episode(spark):
    rows = replay(table(spark), SIGNALS, ["power_1_avg"], cfg=CFG).cache()
    assert rows.count() == 80 and rows.where("error is not null").count() == 0
    assert rows.where("not warmup_complete").count() == 24
    e = episodes(rows).collect()
    assert len(e) >= 1 and T0 + dt.timedelta(minutes=400) <= e[0]["start"] <= T0 + dt.timedelta(minutes=550)


def test_broad_deviation_alone_never_opens_an_alert(spark):
    """Persistent deviation is review evidence: it marks candidates, whatever its size."""
    cfg = StreamConfig(warmup=24, persistent_run=3, recovery_rows=2, merge_hours=0.5)
    rows = replay(table(spark, dips=()), SIGNALS, ["power_1_avg"], cfg=cfg).cache()
    assert rows.where("active").count() == 0 and rows.where("state = 'candidate' and review and extreme_fraction > 0.5").count() > 5
    assert rows.where("ts > timestamp '2024-01-01 09:20:00' and state <> 'normal'").count() == 0


def test_open_episode_is_censored(spark):
    e = episodes(replay(table(spark, 48, (40, 60)), SIGNALS, ["power_1_avg"], cfg=CFG)).collect()
    assert e and e[-1]["right_censored"]


def test_failing_source_does_not_stop_others(spark):
    df = table(spark, 30).unionByName(table(spark, 30).withColumn("source", F.lit("bad")).withColumn("values", F.lit(None).cast("map<string,double>")))
    rows = replay(df, SIGNALS, cfg=CFG)
    assert rows.where("source = 'bad' and error is not null").count() == 1 and rows.where("source = 's1' and error is null").count() == 30


def test_missing_values_and_repeated_rows():
    s = State()
    lay = {"bases": np.array([0, 1]), "power": np.array([], int), "groups": {}}
    for i in range(40):
        out = step(s, {"time": 600.0 * (i // 2), "x": [float("nan"), None if i % 3 else 1.0], "status": None, **lay}, CFG)
    assert out["warmup_complete"] and np.isfinite(out["score"])


def streamed(spark, parts, folder, name):
    """Row scores of the parts, which come one after another."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k == 0:
            src = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
            q = stream(src, SIGNALS, ["power_1_avg"], cfg=CFG).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/ck").start()
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def scores(df):
    return sorted((r["ts"], r["state"], round(r["score"], 9)) for r in df.select("ts", "state", "score").collect())


def test_stream_with_late_rows_equals_batch(spark, tmp_path):
    df = table(spark)
    at = lambda i: F.lit(T0 + dt.timedelta(minutes=10 * i))
    late = F.col("ts").isin(*[T0 + dt.timedelta(minutes=10 * i) for i in (36, 38, 39)])
    end = df.limit(1).withColumn("ts", at(200))
    parts = [df.where((F.col("ts") <= at(40)) & ~late), df.where((F.col("ts") > at(40)) & (F.col("ts") <= at(41)) | late), df.where(F.col("ts") > at(41)), end]
    got = scores(streamed(spark, parts, str(tmp_path), "rows").where(F.col("ts") < at(200)))
    assert got == scores(replay(df, SIGNALS, ["power_1_avg"], cfg=CFG)) and len(got) == 80
