"""Queries of baselines, annotation, fusion and candidates outside the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines, fusion
from .fixtures import HOURLY, REFERENCE, SPANS, WINDOWS, events, hourly, r, sec, spans, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
T = "CAST(floor(epoch(t)) AS BIGINT) AS t"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _ref():
    return F.col("t") < F.lit("2024-01-11 00:00:00").cast("timestamp")


MODES = f"{HOURLY}, m AS (SELECT base, t, pos, value, CASE WHEN value >= 52 THEN 'high' ELSE 'low' END AS mode FROM h)"


@query("w28_dual_baseline", f"""WITH {MODES},
a AS (SELECT base, mode, count(value) AS n, median(value) AS c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_samp(value) AS sd FROM m WHERE t < {REFERENCE} GROUP BY 1, 2),
am AS (SELECT m.base, m.mode, 1.4826::DOUBLE * median(abs(value - c)) AS d FROM m JOIN a ON m.base = a.base AND m.mode = a.mode WHERE t < {REFERENCE} GROUP BY 1, 2),
f AS (SELECT a.base, a.mode, c, CASE WHEN d > 1e-9 THEN d WHEN (q3 - q1) / 1.349::DOUBLE > 1e-9 THEN (q3 - q1) / 1.349::DOUBLE WHEN sd > 1e-9 THEN sd END AS s, n FROM a JOIN am ON a.base = am.base AND a.mode = am.mode),
dy AS (SELECT base, t, count(value) OVER w AS k, median(value) OVER w AS med, (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w) / 1.349::DOUBLE AS iqr FROM m WINDOW w AS (PARTITION BY base, mode ORDER BY pos RANGE BETWEEN 48 PRECEDING AND 1 PRECEDING)),
z AS (SELECT m.base, m.t, abs(m.value - f.c) / f.s AS fz, CASE WHEN k >= 6 AND iqr > 1e-9 THEN abs(m.value - med) / iqr END AS dz FROM m JOIN f ON m.base = f.base AND m.mode = f.mode JOIN dy ON m.base = dy.base AND m.t = dy.t)
SELECT base, {T}, round(fz, 5) AS fixed_z, round(dz, 5) AS dynamic_z, coalesce(fz >= 2, false) AS fixed, coalesce(dz >= 2, false) AS dynamic, coalesce(fz >= 2, false) AND coalesce(dz >= 2, false) AS dual FROM z""")
def w28(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("mode", F.when(F.col("value") >= 52, "high").otherwise("low"))
    out = baselines.dual_baseline(h.drop("pos"), ["base"], "t", "mode", "value", _ref(), 48, 6, 1, 2.0)
    return out.select("base", sec("t").alias("t"), F.round("fixed_z", 5).alias("fixed_z"), F.round("dynamic_z", 5).alias("dynamic_z"), "fixed", "dynamic", "dual")


@query("w29_recovery", f"""WITH {HOURLY}, f AS (SELECT *, value >= 50 AS flag FROM h),
l AS (SELECT base, flag, row_number() OVER (PARTITION BY base ORDER BY t DESC) AS k FROM f WHERE t < {REFERENCE}),
e AS (SELECT base, avg(CAST(flag AS DOUBLE)) AS ts, count(*) FILTER (WHERE flag) >= ceil(count(*) * 0.67) AS ta FROM l WHERE k <= 3 GROUP BY 1),
q AS (SELECT base, t, flag, sum(CAST(flag AS INTEGER)) OVER a = 0 AND count(*) OVER a = 3 AS quiet FROM f WHERE t >= {REFERENCE} WINDOW a AS (PARTITION BY base ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
p AS (SELECT base, avg(CAST(flag AS DOUBLE)) AS ps, min(t) FILTER (WHERE quiet) AS ra FROM q GROUP BY 1)
SELECT base, round(ts, 6) AS tail_share, ta AS tail_active, round(ps, 6) AS post_share, CAST(epoch(ra) AS BIGINT) AS recovered_at FROM e LEFT JOIN p USING (base)""")
def w29(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("flag", F.col("value") >= 50)
    out = baselines.recovery(h, ["base"], "t", "flag", _ref(), ~_ref())
    return out.select("base", r("tail_share").alias("tail_share"), "tail_active", r("post_share").alias("post_share"), sec("recovered_at").alias("recovered_at"))


@query("w18_comparison_scale", f"WITH {HOURLY}, x AS (SELECT base, value, abs(value - lag(value) OVER (PARTITION BY base ORDER BY t)) AS d FROM h) SELECT base, round(greatest(median(d), 0.01::DOUBLE * (quantile_cont(value, 0.95) - quantile_cont(value, 0.05)), 1e-6 * greatest(abs(median(value)), 1)), 6) AS scale FROM x GROUP BY 1")
def w18(spark: SparkSession, d: str) -> DataFrame:
    return baselines.comparison_scale(hourly(spark, d), ["base"], "t", "value").select("base", r("scale").alias("scale"))


@query("w31_transition_score", f"WITH {HOURLY}, x AS (SELECT base, t, avg(value / 100) OVER (PARTITION BY base ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS f, value FROM h) SELECT base, {T}, round(f, 9) AS rolling_fraction, round(f * (1 + ln(1 + value)), 9) AS transition_score, f >= 0.5 AS transition_flag FROM x")
def w31(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("f", F.col("value") / 100)
    out = baselines.transition_score(h, ["base"], "t", "f", "value", 6, 0.5)
    return out.select("base", sec("t").alias("t"), F.round("rolling_fraction", 9).alias("rolling_fraction"), F.round("transition_score", 9).alias("transition_score"), "transition_flag")


@query("w32_state_score", f"WITH {HOURLY} SELECT base, {T}, round(median(value / 100 + 0.01::DOUBLE * value) OVER (PARTITION BY base ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 8) AS score FROM h")
def w32(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("f", F.col("value") / 100)
    return baselines.state_score(h, ["base"], "t", "f", "value").select("base", sec("t").alias("t"), F.round("state_score", 8).alias("score"))


@query("w35_boundary_power", f"""WITH {HOURLY}, s AS (SELECT unnest([100, 300, 500]) AS first, unnest([110, 320, 505]) AS last, unnest([1, 2, 3]) AS segment),
p AS (SELECT segment, base, median(value) FILTER (WHERE pos < first) AS b, min(value) FILTER (WHERE pos BETWEEN first - 2 AND first + 2) AS lo, median(value) FILTER (WHERE pos > last) AS af FROM s JOIN h ON pos BETWEEN first - 6 AND last + 6 GROUP BY 1, 2),
c AS (SELECT segment, count(*) AS n_signals, count(*) FILTER (WHERE b > 0 AND lo <= 0.8 * b) AS n_drop, count(*) FILTER (WHERE b > 0 AND lo <= 0.8 * b AND af >= 0.9 * b) AS n_back FROM p GROUP BY 1)
SELECT CAST(segment AS BIGINT) AS segment, n_signals, n_drop, n_back, n_drop >= ceil(n_signals * 0.5) AND n_back >= ceil(n_signals * 0.5) AS confirmed FROM c""")
def w35(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([("all", 1, 100, 110), ("all", 2, 300, 320), ("all", 3, 500, 505)], "fleet string, segment long, first int, last int")
    h = hourly(spark, d).withColumn("fleet", F.lit("all"))
    return baselines.boundary_power(s, h, ["fleet"], "pos", drop=0.8, back=0.9, need=0.5).select("segment", "n_signals", "n_drop", "n_back", "confirmed")


@query("p21_row_annotation", f"WITH {WINDOWS}, j AS (SELECT event_id, w_id, w_label, row_number() OVER (PARTITION BY event_id ORDER BY w_id DESC NULLS LAST) AS n FROM events LEFT JOIN win ON events.user_id = win.user_id AND ts BETWEEN w_s AND w_e) SELECT event_id, w_id, w_label FROM j WHERE n = 1")
def p21(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "ts")
    return baselines.annotate(e, windows(spark, d), ["user_id"], "ts", "w_start", "w_end", "w_id", ["w_id", "w_label"]).select("event_id", "w_id", "w_label")


@query("p23_exclusion_hull", "WITH x AS (SELECT event_id, user_id, ts, CAST(event_type = 'error' AS INTEGER) AS y FROM events), w AS (SELECT *, min(ts) FILTER (WHERE y = 1) OVER (PARTITION BY user_id) AS a, max(ts) FILTER (WHERE y = 1) OVER (PARTITION BY user_id) AS b FROM x) SELECT event_id FROM w WHERE y = 1 OR NOT coalesce(ts BETWEEN a - INTERVAL 12 HOUR AND b + INTERVAL 12 HOUR, false)")
def p23(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "ts", "event_type").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return baselines.exclusion_hull(e, ["user_id"], "ts", "y", 12).select("event_id")


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select("user_id", F.col("start").alias("ep_start"), F.col("end").alias("ep_end"), F.col("event_type").alias("families"))


@query("a30_stream_summary", f"""WITH {SPANS}, {WINDOWS}, j AS (SELECT w_id, w_s, w_e, greatest(w_s, s) AS a, least(w_e, e) AS b, s, event_type FROM win JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e),
k AS (SELECT *, max(b) OVER (PARTITION BY w_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM j WHERE b > a),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY w_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM k),
hh AS (SELECT w_id, sum(h) AS h FROM (SELECT w_id, (epoch_us(max(b)) - epoch_us(min(a))) / 3.6e9 AS h FROM g GROUP BY w_id, grp) GROUP BY 1),
f AS (SELECT w_id, count(*) AS n, min(s) AS fs, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS fam FROM j GROUP BY 1)
SELECT win.w_id, coalesce(n, 0) AS n_episodes, round(coalesce(h, 0), 5) AS overlap_hours, round(least(1, coalesce(h, 0) / 24), 5) AS coverage, round((epoch_us(fs) - epoch_us(w_s)) / 3.6e9, 5) AS delay_hours, coalesce(fam, '') AS families, CASE WHEN n IS NULL THEN 'none' WHEN coalesce(h, 0) / 24 >= 0.25 THEN 'strong' WHEN coalesce(h, 0) > 0 THEN 'partial' ELSE 'touching' END AS tier FROM win LEFT JOIN f USING (w_id) LEFT JOIN hh USING (w_id)""")
def a30(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).withColumnsRenamed({"w_start": "start", "w_end": "end"})
    s = fusion.stream_summary(w, _episodes(spark, d), ["user_id"], "w_id")
    return s.select("w_id", "n_episodes", *(F.round(c, 5).alias(c) for c in ("overlap_hours", "coverage", "delay_hours")), "families", "tier")


@query("d17_early_warning", f"""WITH {SPANS}, {WINDOWS}, j AS (SELECT w_id, w_s, greatest(w_s - INTERVAL 30 DAY, s) AS a, least(w_s, e) AS b FROM win JOIN spans ON win.user_id = spans.user_id AND e >= w_s - INTERVAL 30 DAY AND s <= w_s WHERE event_type = 'error'),
f AS (SELECT w_id, bool_or(b >= w_s - INTERVAL 7 DAY) AS d7, bool_or(b >= w_s - INTERVAL 14 DAY) AS d14, max((epoch_us(w_s) - epoch_us(a)) / 3.6e9) / 24 AS lead FROM j GROUP BY 1)
SELECT w_id, lead IS NOT NULL AS warned, coalesce(d7, false) AS within_7, coalesce(d14, false) AS within_14, round(lead, 6) AS lead_days FROM win LEFT JOIN f USING (w_id)""")
def d17(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).withColumnsRenamed({"w_start": "start", "w_end": "end"})
    x = spans(spark, d).where("event_type = 'error'").select("user_id", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    return fusion.early_warning_summary(w, x, ["user_id"], "w_id").select("w_id", "warned", "within_7", "within_14", r("lead_days").alias("lead_days"))


@query("d18_offlog_candidates")
def d18(spark: SparkSession, d: str) -> DataFrame:
    e = spans(spark, d).select("user_id", "start", "end", (0.85 + (F.col("event_id") % 16) / 100.0).alias("score"), F.array("event_type").alias("families"))
    log = windows(spark, d).select("user_id", F.col("w_start").alias("l_start"), F.col("w_end").alias("l_end"))
    return fusion.offlog_candidates(e, log, ["user_id"], least_priority=0.4).withColumn("families", F.array_join("families", ";"))


@query("d13_explanations", "SELECT event_id, 'The event is judged ' || CASE event_id % 3 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'review' ELSE 'normal' END || CASE WHEN event_id % 2 = 0 THEN ' because of ' || replace('persistent;cluster', ';', ', ') ELSE ' without specific evidence' END || printf('; persistent for %.1f hours.', (event_id % 7) * 1.0) AS text FROM events")
def d13(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    decision = F.when(i % 3 == 0, "anomaly").when(i % 3 == 1, "review").otherwise("normal")
    return events(spark, d, "event_id").select("event_id", fusion.explanation(decision, F.when(i % 2 == 0, "persistent;cluster").otherwise(""), (i % 7) * F.lit(1.0)).alias("text"))


@query("d19_payloads", "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS payload FROM events")
def d19(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "event_type").withColumn("label", F.lit(1))
    return fusion.payload(e, "event_id", ["event_id", "event_type", "label"])


@query("j11_own_context", f"""WITH {SPANS}, {WINDOWS}, c AS (SELECT event_id, user_id, s, e FROM spans),
j AS (SELECT event_id, w_id, CASE WHEN w_id IS NULL THEN 'none' WHEN least(e, w_e) > greatest(s, w_s) THEN 'overlapping' WHEN e <= w_s THEN 'before' ELSE 'after' END AS position, CASE WHEN w_id IS NOT NULL THEN greatest(0, (epoch_us(w_s) - epoch_us(e)) / 3.6e9, (epoch_us(s) - epoch_us(w_e)) / 3.6e9) END AS dist FROM c LEFT JOIN win USING (user_id))
SELECT event_id, w_id AS nearest, position, round(dist, 5) AS distance_hours FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist NULLS LAST, w_id) AS n FROM j) WHERE n = 1""")
def j11c(spark: SparkSession, d: str) -> DataFrame:
    c = spans(spark, d).select("user_id", F.col("event_id").alias("c_id"), "start", "end")
    e = windows(spark, d).select("user_id", F.col("w_id").alias("event_id"), F.col("w_start").alias("e_start"), F.col("w_end").alias("e_end"))
    o = fusion.own_context(c, e, ["user_id"], "c_id")
    return o.select(F.col("c_id").alias("event_id"), F.col("event_id").alias("nearest"), "position", F.round("distance_hours", 5).alias("distance_hours"))
