"""Queries of the operators for keys of any length: one group with all rows of a table, joins of intervals by sweeps,
ranks over ranges, and the life cycle as a streaming query."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, ranges, stats
from ..operators.baselines import calibrated_threshold
from ..operators.decisions import weighted_alert_score
from ..operators.ml import neighbour_information
from ..sources import writers
from ..sources.shared import shared_folder
from ..streaming.step import StreamConfig
from ..streaming.typed import run_available
from .fixtures import HOURLY, SPANS, WINDOWS, events, hourly, r, scaled_round, sec, spans, table, windows
from .queries_streaming import PHASES, W, _latch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    """All order lines as one group."""
    li = table(spark, d, "lineitem")
    return li.select(F.lit("all").alias("fleet"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), "l_orderkey", "l_linenumber")


ITEMS = "li AS (SELECT CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, l_orderkey, l_linenumber FROM lineitem)"


@query("a01_bracketed_scale", f"WITH {ITEMS}, m AS (SELECT median(price) AS c FROM li) SELECT count(price) AS n, round(min(c), 6) AS centre, round(1.4826::DOUBLE * median(abs(price - c)), 6) AS scale FROM li, m")
def a01_bracketed(spark: SparkSession, d: str) -> DataFrame:
    return stats.bracketed_scale(_items(spark, d), ["fleet"], "price").select("n", r("centre").alias("centre"), r("scale").alias("scale"))


@query("a04_bracketed_reference", f"WITH {ITEMS}, k AS (SELECT * FROM li WHERE discount < 0.05), m AS (SELECT median(quantity) AS c FROM k) SELECT round(avg(quantity), 6) AS mean, round(stddev_samp(quantity), 6) AS std, min(c) AS median, min(quantity) AS min, max(quantity) AS max, median(abs(quantity - c)) AS mad FROM k, m")
def a04_bracketed(spark: SparkSession, d: str) -> DataFrame:
    x = stats.bracketed_reference(_items(spark, d), F.col("discount") < 0.05, ["fleet"], "quantity")
    return x.select(r("mean").alias("mean"), r("std").alias("std"), "median", "min", "max", "mad")


@query("a14_bracketed_threshold", f"WITH {ITEMS} SELECT round(greatest(1000, quantile_cont(price, 0.995) FILTER (WHERE discount < 0.05)), 6) AS threshold FROM li")
def a14_bracketed(spark: SparkSession, d: str) -> DataFrame:
    return stats.bracketed_threshold(_items(spark, d), ["fleet"], "price", 0.995, 1000.0, F.col("discount") < 0.05).select(r("threshold").alias("threshold"))


@query("w13_ranged_percentile_rank", f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, round((rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2) / count(*) OVER (), 9) AS price_rank, round((rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2) / count(*) OVER (), 9) AS quantity_rank FROM li")
def w13_ranged(spark: SparkSession, d: str) -> DataFrame:
    x = ranges.percent_rank(ranges.percent_rank(_items(spark, d), ["fleet"], "price", "_p"), ["fleet"], "quantity", "_q")
    return x.select("l_orderkey", "l_linenumber", F.round("_p", 9).alias("price_rank"), F.round("_q", 9).alias("quantity_rank"))


@query("m15_ranged_spearman", f"WITH {ITEMS}, k AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS a, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2 AS b FROM li) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM k")
def m15_ranged(spark: SparkSession, d: str) -> DataFrame:
    return ranges.spearman(_items(spark, d), ["fleet"], "price", "quantity").select("n", r("rho").alias("rho"))


@query("p27_swept_distance", f"WITH {SPANS}, {WINDOWS} SELECT event_id, round(min(CASE WHEN w_s IS NOT NULL THEN greatest(0, (epoch_us(w_s) - epoch_us(e)) / 3.6e9, (epoch_us(s) - epoch_us(w_e)) / 3.6e9) END), 5) AS nearest_hours FROM spans LEFT JOIN win USING (user_id) GROUP BY 1")
def p27_swept(spark: SparkSession, d: str) -> DataFrame:
    n = ranges.nearest_hours(spans(spark, d), windows(spark, d), ["user_id"], ("start", "end"), ("w_start", "w_end"), ["event_id"])
    return n.select("event_id", F.round("nearest_hours", 5).alias("nearest_hours"))


@query("j07_swept_parent", f"WITH {SPANS}, {WINDOWS}, j AS (SELECT event_id, w_id, row_number() OVER (PARTITION BY event_id ORDER BY w_label NULLS LAST, w_s NULLS LAST, w_id) AS n FROM spans LEFT JOIN win ON spans.user_id = win.user_id AND s >= w_s AND e <= w_e) SELECT event_id, w_id AS parent FROM j WHERE n = 1")
def j07_swept(spark: SparkSession, d: str) -> DataFrame:
    p = windows(spark, d).withColumnsRenamed({"w_start": "p_start", "w_end": "p_end"})
    c = ranges.contained_parent(spans(spark, d), p, ["user_id"], "event_id", "w_id", ["w_label", "p_start"])
    return c.select("event_id", F.col("w_id").alias("parent"))


@query(
    "j11_swept_context",
    f"""WITH {SPANS}, {WINDOWS}, j AS (SELECT event_id, w_id, s, e, w_s, w_e, greatest(0, (epoch_us(w_s) - epoch_us(e)) / 3.6e9, (epoch_us(s) - epoch_us(w_e)) / 3.6e9) AS d FROM spans LEFT JOIN win USING (user_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d NULLS LAST, w_id) AS n FROM j)
SELECT event_id, w_id, CASE WHEN w_id IS NULL THEN 'none' WHEN least(e, w_e) > greatest(s, w_s) THEN 'overlapping' WHEN e <= w_s THEN 'before' ELSE 'after' END AS position, round(CASE WHEN w_id IS NOT NULL THEN d END, 5) AS distance_hours FROM k WHERE n = 1""",
)
def j11_swept(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).select("user_id", F.col("w_id").alias("event_id"), F.col("w_start").alias("e_start"), F.col("w_end").alias("e_end"))
    c = spans(spark, d).select("user_id", F.col("event_id").alias("span_id"), "start", "end")
    x = ranges.own_context(c, w, ["user_id"], "span_id")
    return x.select(F.col("span_id").alias("event_id"), F.col("event_id").alias("w_id"), "position", F.round("distance_hours", 5).alias("distance_hours"))


PAIRS = ("click", "error", "purchase", "signup", "view")


@query("m16_neighbour_information")
def m16_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Of each pair of event types' hourly means, over the hours that have all of them. No SQL: means of few values make
    ties that rounding breaks either way; a test holds it against brute force."""
    wide = hourly(spark, d).groupBy("t").pivot("base", list(PAIRS)).agg(F.first("value")).withColumn("s", sec("t"))
    return neighbour_information(wide, PAIRS, "s").select("i", "j", r("mi").alias("mi"), r("weight").alias("weight"))


QS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.97)


@query(
    "m17_calibrated_warnings",
    f"""WITH {HOURLY}, l AS (SELECT t, count(*) FILTER (WHERE value >= 51) AS loc FROM h GROUP BY 1), v AS (SELECT base, t, pos, value, loc, median(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM h JOIN l USING (t)),
c AS (SELECT base, quantile_cont(value, [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.97]) AS a, (epoch_us(max(t)) - epoch_us(min(t))) / 8.64e10 AS days FROM v GROUP BY 1), th AS (SELECT base, days, unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.97]) AS q, unnest(a) AS th FROM c),
x AS (SELECT v.base, t, q, th, days, s > th AND loc >= 2 AS hit FROM v JOIN th USING (base)), y AS (SELECT *, count(*) OVER w = 4 AND sum(CAST(hit AS INTEGER)) OVER w >= 2 AS warned FROM x WINDOW w AS (PARTITION BY base, q ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
e AS (SELECT base, q, sum(CASE WHEN epoch(t) - epoch(b) <= 10800 THEN 0 ELSE 1 END) AS n FROM (SELECT *, lag(t) OVER (PARTITION BY base, q ORDER BY t) AS b FROM y WHERE warned) GROUP BY 1, 2),
f AS (SELECT y.base, y.q, y.th, any_value(days) AS days, avg(CAST(warned AS INTEGER)) AS far FROM y GROUP BY 1, 2, 3), g AS (SELECT f.*, coalesce(e.n, 0) * 30 / days AS per, far <= 0.05 AND coalesce(e.n, 0) * 30 / days <= 9 AS met FROM f LEFT JOIN e USING (base, q)),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY CASE WHEN met THEN q ELSE 3 - q END) AS k FROM g)
SELECT base, round(q, 3) AS q, round(th, 6) AS threshold, round(far, 6) AS far, round(per, 5) AS episodes_30d, met FROM k WHERE k = 1""",
)
def m17_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The least strict threshold whose warnings, decided as online, keep within a share and a number of episodes."""
    h = hourly(spark, d)
    h = h.join(h.groupBy("t").agg(F.count_if(F.col("value") >= 51).alias("local")), "t")
    x = calibrated_threshold(h, ["base"], "t", "value", "local", QS, 0.05, 9.0, 3, 2, 4, 2, 10_800.0)
    return x.select("base", F.round("q", 3).alias("q"), r("threshold").alias("threshold"), r("far").alias("far"), F.round("episodes_30d", 5).alias("episodes_30d"), "met")


ID = "event_id"
RATES = {"short": 7, "cluster": 11, "persistent": 13, "localized": 17, "communication": 19, "trend": 23, "status": 5, "control": 29, "targeted": 31, "semantic": 3}


@query(
    "r18_weighted_score",
    """WITH s AS (SELECT event_id AS i, least(1.0::DOUBLE, value / 120.0::DOUBLE) AS v FROM events), f AS (SELECT *, CAST(i % 7 = 2 AS INTEGER) + CAST(i % 11 = 2 AS INTEGER) + CAST(i % 13 = 2 AS INTEGER) + CAST(i % 17 = 2 AS INTEGER) AS k FROM s)
SELECT i AS event_id, round(greatest(0, CASE i % 7 WHEN 1 THEN 0.60 * v WHEN 2 THEN 0.70 * v ELSE 0 END, CASE i % 11 WHEN 1 THEN 0.65 * v WHEN 2 THEN 0.90 * v ELSE 0 END, CASE i % 13 WHEN 1 THEN 0.55 * v WHEN 2 THEN 0.95 * v ELSE 0 END,
CASE i % 17 WHEN 1 THEN 0.55 * v WHEN 2 THEN 0.95 * v ELSE 0 END, CASE i % 19 WHEN 1 THEN 0.60 WHEN 2 THEN 0.98 ELSE 0 END, CASE i % 23 WHEN 1 THEN 0.58 WHEN 2 THEN 0.92 ELSE 0 END, CASE WHEN i % 5 = 2 THEN v ELSE 0.65 * v END,
CASE i % 29 WHEN 2 THEN 0.98 ELSE 0 END, CASE i % 31 WHEN 2 THEN 0.97 * v ELSE 0 END, CASE i % 3 WHEN 1 THEN 0.55 * v WHEN 2 THEN 0.96 * v ELSE 0 END, CASE WHEN k >= 2 THEN least(1, 0.55 + 0.20 * k) ELSE 0 END), 6) AS score FROM f""",
)
def r18_weighted(spark: SparkSession, d: str) -> DataFrame:
    """All terms of the alert score, on evidence that is made up from the event ids."""
    e = events(spark, d, ID, "value")
    v = F.least(F.lit(1.0), F.col("value") / 120.0)
    stage = {n: F.when(F.col(ID) % m == 1, "candidate").when(F.col(ID) % m == 2, "confirmed") for n, m in RATES.items()}
    families = sum(((F.col(ID) % RATES[n] == 2).cast("int") for n in ("short", "cluster", "persistent", "localized")), F.lit(0))
    score = weighted_alert_score({n: v for n in ("short", "cluster", "persistent", "localized", "status", "targeted", "semantic")}, stage, families)
    return e.select(ID, scaled_round(score).alias("score"))


@query("r19_typed_stream", f"WITH RECURSIVE {PHASES}, c AS (SELECT *, sum(CAST(value >= 54 AS INTEGER)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c6 FROM h), xl AS (SELECT base, t, pos, value >= 54 AND c6 >= 2 AS want, c6 <= 1 AND value < 54 AS calm FROM c), {_latch('xl', 'base', 1, 6)} SELECT x.base, CAST(floor(epoch(x.t)) AS BIGINT) AS t, phase, closed, lat.fired AS cluster FROM f JOIN x ON x.base = f.base AND x.pos = f.pos JOIN lat ON lat.base = f.base AND lat.pos = f.pos")
def r19_typed(spark: SparkSession, d: str) -> DataFrame:
    """Phases and cluster latch of a stream of files; a row a year on lets the watermark pass the last ones."""
    v = F.col("value")
    count = F.sum((v >= 54).cast("int")).over(frames.trailing(frames.keyed(["base"], ["t"]), 6))
    h = hourly(spark, d).withColumn("c6", count)
    no = F.lit(False)
    x = h.select(F.col("base").alias("source"), F.col("t").alias("ts"), (v >= 58).alias("trigger"), (v >= 54).alias("review"), (v >= 50).alias("support"), ((v >= 54) & (F.col("c6") >= 2)).alias("qualified"), ((F.col("c6") <= 1) & (v < 54)).alias("low"), no.alias("fusion"), F.lit("").alias("groups"))
    root = shared_folder(spark, "typed-stream")
    x.write.parquet(f"{root}/in")
    last = events(spark, d, "ts").agg((F.max("ts") + F.expr("interval 1 year")).alias("ts"))
    last.select(F.lit("end").alias("source"), "ts", *(no.alias(c) for c in ("trigger", "review", "support", "qualified", "low", "fusion")), F.lit("").alias("groups")).write.mode("append").parquet(f"{root}/in")
    out = run_available(spark, x, root, StreamConfig(sampling_minutes=60, recovery_rows=3, merge_hours=6, rearm_hours=6), "1 hour", 1000)
    return out.where("source <> 'end'").select(F.col("source").alias("base"), sec(F.timestamp_micros("at")).alias("t"), "phase", "closed", "cluster")


@query("k09_streamed_bundle", "SELECT event_type, count(*) AS n, count(*) AS n_rows, round(sum(value), 4) AS total FROM events GROUP BY 1")
def k09_streamed(spark: SparkSession, d: str) -> DataFrame:
    """A bundle of rows and of counts by batch, streamed from files. The first run breaks off after the rows of its second
    batch; the next goes on from the checkpoint. No row is there twice, none is missing."""
    root = shared_folder(spark, "streamed-bundle")
    events(spark, d, "event_id", "event_type", "value").repartition(6, "event_id").write.parquet(f"{root}/in")
    schema = "event_id bigint, event_type string, value double"
    tables = {"rows": lambda b: b, "counts": lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))}
    sink = writers.bundle_sink(f"{root}/out", tables)

    def broken(batch: DataFrame, number: int) -> None:
        if number == 1:
            batch.write.mode("overwrite").parquet(f"{root}/out/rows/batch=1")
            raise RuntimeError("broken off")
        sink(batch, number)

    for take in (broken, sink):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        q = source.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            pass
    counts = writers.read_bundle(spark, f"{root}/out", "counts").groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
    rows = writers.read_bundle(spark, f"{root}/out", "rows").groupBy("event_type").agg(F.count("*").alias("n_rows"))
    return counts.join(rows, "event_type")
