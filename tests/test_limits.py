"""Comparisons with limits agree with their SQL at the limit and one double to both sides of it."""

import datetime as dt
import math

import duckdb

from vanewright.plans import catalog


def test_confidence_at_its_limits(spark, tmp_path):
    values = [v for limit in (40.0, 48.0, 60.0) for v in (limit, math.nextafter(limit, 0), math.nextafter(limit, 99), limit - 0.01, limit + 0.01)] + [0.0, None, float("nan"), -1.0, 560.21]
    rows = [(i, dt.datetime(2024, 1, 1), v) for i, v in enumerate(v for v in values for _ in range(4 * 9 * 14))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    name = "d07_confidence"
    got = {r["event_id"]: r["band"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(db.sql(catalog.ORACLE[name]).fetchall()) and len(got) == len(rows)
