"""Rounded scores agree with their SQL to the last decimal, next to ties too."""

import datetime as dt

import duckdb

from vanewright.plans import catalog


def test_weighted_score_is_exact(spark, tmp_path):
    values = [15.99, 11.37, 31.59, 11.85, 31.83, 76.77, 96.63, 0.0, None, 130.0, -3.21]
    rows = [(i, dt.datetime(2024, 1, 1), v) for i, v in enumerate(v for v in values for _ in range(400))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    name = "r18_weighted_score"
    got = {r["event_id"]: r["score"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(db.sql(catalog.ORACLE[name]).fetchall())
