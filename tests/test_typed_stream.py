import datetime as dt
import random

from pyspark.sql import functions as F

from vanewright.streaming import causal, typed
from vanewright.streaming.step import StreamConfig

T0 = dt.datetime(2024, 1, 1)
CFG = StreamConfig(sampling_minutes=60, recovery_rows=2, merge_hours=3, rearm_hours=2, fusion_rows=2, fusion_quiet_hours=3, targeted_rows=2, targeted_quiet_hours=2)
SCHEMA = "source string, ts timestamp, trigger boolean, review boolean, support boolean, qualified boolean, low boolean, fusion boolean, groups string"


def evidence(spark, sources, n):
    rng = random.Random(7)
    rows = []
    for s in range(sources):
        for i in range(n):
            on = [rng.random() < p for p in (0.1, 0.3, 0.4, 0.25, 0.5, 0.5)]
            rows.append((f"s{s}", T0 + dt.timedelta(hours=i), *on, ";".join(g for g in ("oil", "yaw") if rng.random() < 0.5)))
    return spark.createDataFrame(rows, SCHEMA)


def batch(df):
    """The same by the folds over whole sources."""
    phases = causal.alert_phases(df, ["source"], "ts", CFG)
    cluster = causal.latched(df, ["source"], "ts", "qualified", F.col("low"), 1, CFG.rows(CFG.rearm_hours)).withColumnRenamed("fired", "cluster")
    fused = causal.latched(df, ["source"], "ts", "fusion", ~F.col("fusion"), CFG.fusion_rows, CFG.rows(CFG.fusion_quiet_hours)).withColumnRenamed("fired", "fused")
    return phases.join(cluster, ["source", "ts"]).join(fused, ["source", "ts"]).withColumn("at", F.unix_micros("ts"))


COLUMNS = ["source", "at", "phase", "closed", "cluster", "fused"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def flush(spark, hours):
    return spark.createDataFrame([("end", T0 + dt.timedelta(hours=hours), *[False] * 6, "")], SCHEMA)


def test_stream_with_late_rows_and_restart_equals_batch(spark, tmp_path):
    df = evidence(spark, 3, 40)
    at = lambda i: F.lit(T0 + dt.timedelta(hours=i))
    late = F.col("ts").isin(*[T0 + dt.timedelta(hours=i) for i in (12, 18, 19)])
    parts = [df.where((F.col("ts") <= at(20)) & ~late), df.where(late | (F.col("ts") > at(20)) & (F.col("ts") <= at(26))), df.where(F.col("ts") > at(24)), flush(spark, 200)]
    for part in parts:  # each run goes on from the checkpoint of the one before
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = typed.run_available(spark, df, str(tmp_path), CFG, "10 hours")
    got = rows(out.where("source <> 'end'"))
    assert got == rows(batch(df)) and len(got) == 120 and {r[2] for r in got} > {"active_alert", "inactive_pending"} and any(r[3] for r in got) and any(r[5] for r in got)
    assert out.where("targeted <> ''").count() > 0


def test_many_sources_keep_small_states(spark, tmp_path):
    base = evidence(spark, 1, 3).drop("source")
    df = base.crossJoin(spark.range(2000).select(F.col("id").cast("string").alias("source"))).select("source", *base.columns)
    df.write.parquet(f"{tmp_path}/in")
    flush(spark, 100).write.mode("append").parquet(f"{tmp_path}/in")
    out = typed.run_available(spark, df, str(tmp_path), CFG, "1 hour", 100)
    assert out.where("source <> 'end'").count() in (0, 6000)
    flush(spark, 101).write.mode("append").parquet(f"{tmp_path}/in")
    assert typed.run_available(spark, df, str(tmp_path), CFG, "1 hour", 100).where("source <> 'end'").count() == 6000
