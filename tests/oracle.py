"""Runs a query and its oracle SQL on the same tables and compares them without regard to order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        try:
            return round(float(v), 5)
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=str)


def differences(spark, sf_dir: str, query, sql: str) -> list:
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    return [(a, b) for a, b in zip(got, want, strict=True) if a != b]
