"""The driver's tables seen as monitoring data, and the same views as DuckDB CTEs for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import keyed

STATS = ("avg", "max", "min", "std")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with a zoned timestamp; only the named columns are read."""
    df = table(spark, sf_dir, "events")
    return df.select(*(F.col("ts").cast("timestamp").alias("ts") if c == "ts" else c for c in (columns or df.columns)))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, base, avg, max, min, std, n): hourly statistics of each event type's value."""
    e = events(spark, sf_dir, "ts", "event_type", "value")
    return e.groupBy(F.date_trunc("hour", "ts").alias("t"), F.col("event_type").alias("base")).agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def grid_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, base, stat, value)."""
    return grid(spark, sf_dir).unpivot(["t", "base"], list(STATS), "stat", "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(base, t, pos, value): hourly means with their row number from 1."""
    g = grid(spark, sf_dir).select("base", "t", F.col("avg").alias("value"))
    return g.withColumn("pos", F.row_number().over(keyed(["base"], ["t"])))


def source_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, base, t, value): hourly means by a third of the users and event type."""
    e = events(spark, sf_dir, "user_id", "ts", "event_type", "value")
    return e.groupBy((F.col("user_id") % 3).cast("string").alias("source"), F.col("event_type").alias("base"), F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("value"))


def source_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, t, base, avg, max, min, std): the hourly grid by a third of the users."""
    e = events(spark, sf_dir, "user_id", "ts", "event_type", "value")
    g = e.groupBy((F.col("user_id") % 3).cast("string").alias("source"), F.date_trunc("hour", "ts").alias("t"), F.col("event_type").alias("base"))
    return g.agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, start, end): an interval of 0 to 11 hours after each event."""
    e = events(spark, sf_dir, "event_id", "user_id", "event_type", "ts")
    return e.select("user_id", "event_id", "event_type", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 12).cast("int"))).alias("end"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, w_id, w_label, w_start, w_end): a day from every 97th event, labelled 0 or 1."""
    e = events(spark, sf_dir, "event_id", "user_id", "ts").where(F.col("event_id") % 97 == 0)
    return e.select("user_id", F.col("event_id").alias("w_id"), (F.floor(F.col("event_id") / 97) % 2).cast("int").alias("w_label"), F.col("ts").alias("w_start"), (F.col("ts") + F.expr("interval 24 hours")).alias("w_end"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, repeat, actual, probability, threshold, predicted): five synthetic repeats for each labelled document."""
    x = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("actual"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("repeat"))
    p = ((F.col("doc_id") * 37 + F.col("repeat") * 101) % 100) / 100.0
    x = x.withColumns({"probability": F.least(F.lit(1.0), p * 0.7 + F.col("actual") * 0.3), "threshold": 0.4 + (F.col("repeat") % 3) / 20.0})
    return x.withColumn("predicted", (F.col("probability") >= F.col("threshold")).cast("int"))


def sec(c: Column | str) -> Column:
    """A timestamp as whole seconds, the way results carry it."""
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


def r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def scaled_round(c: Column) -> Column:
    """Six decimals of a double as SQL engines round it: the scaled double is rounded. Spark's own ``round`` takes the
    shortest decimal form instead, which differs where a product lies next to a tie."""
    return F.round(c * 1e6, 0) / 1e6


# The same as SQL, to stand behind WITH.
GRID = "grid AS (SELECT date_trunc('hour', ts) AS t, event_type AS base, avg(value) AS avg, max(value) AS max, min(value) AS min, coalesce(stddev_samp(value), 0) AS std, count(*) AS n FROM events GROUP BY 1, 2)"
LONG = GRID + ", long AS (SELECT t, base, 'avg' AS stat, avg AS value FROM grid UNION ALL SELECT t, base, 'max', max FROM grid UNION ALL SELECT t, base, 'min', min FROM grid UNION ALL SELECT t, base, 'std', std FROM grid)"
HOURLY = GRID + ", h AS (SELECT base, t, avg AS value, row_number() OVER (PARTITION BY base ORDER BY t) AS pos FROM grid)"
SOURCES = "sh AS (SELECT CAST(user_id % 3 AS VARCHAR) AS source, event_type AS base, date_trunc('hour', ts) AS t, avg(value) AS value FROM events GROUP BY 1, 2, 3)"
SPANS = "spans AS (SELECT user_id, event_id, event_type, ts AS s, ts + to_hours(CAST(event_id % 12 AS INTEGER)) AS e FROM events)"
WINDOWS = "win AS (SELECT user_id, event_id AS w_id, CAST((event_id // 97) % 2 AS INTEGER) AS w_label, ts AS w_s, ts + INTERVAL 24 HOUR AS w_e FROM events WHERE event_id % 97 = 0)"
PREDICTIONS = """x AS (SELECT doc_id, CAST(toxic AS INTEGER) AS actual, unnest([1,2,3,4,5]) AS repeat FROM labels),
p0 AS (SELECT *, least(1.0::DOUBLE, ((doc_id * 37 + repeat * 101) % 100) / 100.0::DOUBLE * 0.7::DOUBLE + actual * 0.3::DOUBLE) AS probability, 0.4::DOUBLE + (repeat % 3) / 20.0::DOUBLE AS threshold FROM x),
p AS (SELECT *, CAST(probability >= threshold AS INTEGER) AS predicted FROM p0)"""
#: Z of each base signal against the first ten days, for detectors.
REFERENCE = "TIMESTAMP '2024-01-11 00:00:00'"
BASE_Z = (
    LONG
    + f""",
ref AS (SELECT base, stat, median(value) AS centre, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_samp(value) AS sd FROM long WHERE t < {REFERENCE} GROUP BY 1, 2),
mad AS (SELECT l.base, l.stat, 1.4826::DOUBLE * median(abs(l.value - r.centre)) AS m FROM long l JOIN ref r USING (base, stat) WHERE l.t < {REFERENCE} GROUP BY 1, 2),
sc AS (SELECT base, stat, centre, CASE WHEN m > 1e-9 THEN m WHEN (q3 - q1) / 1.349::DOUBLE > 1e-9 THEN (q3 - q1) / 1.349::DOUBLE WHEN sd > 1e-9 THEN sd END AS scale FROM ref JOIN mad USING (base, stat)),
z AS (SELECT l.t, l.base, max(coalesce(abs(l.value - sc.centre) / sc.scale, 0)) AS z FROM long l LEFT JOIN sc USING (base, stat) GROUP BY 1, 2)"""
)
