"""Queries of further survey operators, mostly compositions of the library's functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import detectors, frames, intervals, metrics, ranking
from .fixtures import HOURLY, LONG, PREDICTIONS, REFERENCE, SPANS, WINDOWS, events, grid_long, hourly, predictions, r, sec, spans, table, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
T = "CAST(floor(epoch(t)) AS BIGINT) AS t"
W = "PARTITION BY base ORDER BY t"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _ref():
    return F.col("t") < F.lit("2024-01-11 00:00:00").cast("timestamp")


@query("p10_measurement_selection", f"WITH {LONG}, x AS (SELECT base || '_' || stat AS name, CASE WHEN stat = 'min' AND value < 5 THEN NULL ELSE value END AS v FROM long) SELECT name, round(count(v) / count(*), 6) AS valid FROM x GROUP BY 1 HAVING count(v) / count(*) >= 0.5")
def p10(spark: SparkSession, d: str) -> DataFrame:
    x = grid_long(spark, d).select(F.concat_ws("_", "base", "stat").alias("name"), F.when(~((F.col("stat") == "min") & (F.col("value") < 5)), F.col("value")).alias("v"))
    return x.groupBy("name").agg((F.count("v") / F.count("*")).alias("valid")).where("valid >= 0.5").select("name", r("valid").alias("valid"))


@query("p19_reference_windows", f"WITH {WINDOWS}, c AS (SELECT w_id, count(*) FILTER (WHERE ts >= w_s - INTERVAL 48 HOUR) AS near, count(*) AS pre FROM win JOIN events ON events.user_id = win.user_id AND ts < w_s GROUP BY 1) SELECT w_id, near, pre, CASE WHEN near >= 4 THEN 'window' WHEN pre >= 4 THEN 'all_before' ELSE 'none' END AS reference FROM c")
def p19(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "user_id", "ts")
    w = windows(spark, d).withColumnRenamed("user_id", "u")
    j = w.join(e, (F.col("u") == F.col("user_id")) & (F.col("ts") < F.col("w_start")))
    c = j.groupBy("w_id").agg(F.count_if(F.col("ts") >= F.col("w_start") - F.expr("interval 48 hours")).alias("near"), F.count("*").alias("pre"))
    return c.withColumn("reference", F.when(F.col("near") >= 4, "window").when(F.col("pre") >= 4, "all_before").otherwise("none"))


@query("p20_context_restriction", f"WITH {WINDOWS} SELECT w_id, count(*) AS n, count(*) FILTER (WHERE ts BETWEEN w_s AND w_e) AS inside FROM win JOIN events ON events.user_id = win.user_id AND ts BETWEEN w_s - INTERVAL 48 HOUR AND w_e + INTERVAL 12 HOUR GROUP BY 1")
def p20(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "user_id", "ts").withColumn("ts2", F.col("ts"))
    w = windows(spark, d).withColumns({"a": F.col("w_start") - F.expr("interval 48 hours"), "z": F.col("w_end") + F.expr("interval 12 hours")})
    j = intervals.overlap_join(w, e, ["user_id"], ("a", "z"), ("ts", "ts2"))
    return j.groupBy("w_id").agg(F.count("*").alias("n"), F.count_if(F.col("ts").between(F.col("w_start"), F.col("w_end"))).alias("inside"))


@query("a18_detector_intervals", f"WITH {SPANS}, p AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE e > s), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM p), m AS (SELECT user_id, event_type, (epoch_us(max(e)) - epoch_us(min(s))) / 3.6e9 AS h, count(*) AS n FROM g GROUP BY user_id, event_type, k) SELECT user_id, event_type, CAST(sum(n) AS BIGINT) AS n_intervals, count(*) AS n_merged, round(max(h), 5) AS max_hours, round(sum(h), 5) AS total_hours FROM m GROUP BY 1, 2")
def a18(spark: SparkSession, d: str) -> DataFrame:
    u = intervals.union_hours(spans(spark, d), ["user_id", "event_type"], "start", "end", 1200)
    return u.select("user_id", "event_type", "n_intervals", "n_merged", F.round("max_hours", 5).alias("max_hours"), F.round("total_hours", 5).alias("total_hours"))


@query("a20_segment_aggregates", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_error, round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS mean_error, round(max(value) FILTER (WHERE event_type = 'view'), 6) AS max_view, round(count(*) FILTER (WHERE value >= 50) / count(*), 6) AS high_share FROM events GROUP BY 1")
def a20(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("value"), F.col("event_type")
    return events(spark, d, "user_id", "event_type", "value").groupBy("user_id").agg(F.count_if(k == "error").alias("n_error"), r(F.avg(F.when(k == "error", v))).alias("mean_error"), r(F.max(F.when(k == "view", v))).alias("max_view"), r(F.count_if(v >= 50) / F.count("*")).alias("high_share"))


@query("a23_series_summary", f"WITH {HOURLY}, i AS (SELECT *, sum(CASE WHEN (value >= 50) IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER ({W}) AS k FROM (SELECT *, lag(value >= 50) OVER ({W}) AS p FROM h)), c AS (SELECT base, value, CASE WHEN value >= 50 THEN row_number() OVER (PARTITION BY base, k ORDER BY t) ELSE 0 END AS run FROM i) SELECT base, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(quantile_cont(value, 0.95), 9) AS p95, round(avg(CAST(value >= 50 AS INTEGER)), 6) AS coverage, CAST(max(run) AS BIGINT) AS longest FROM c GROUP BY 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    h = frames.run_length(hourly(spark, d).withColumn("flag", F.col("value") >= 50), "flag", ["base"], ["t"])
    return h.groupBy("base").agg(r(F.avg("value")).alias("mean"), r(F.max("value")).alias("max"), F.round(F.percentile("value", 0.95), 9).alias("p95"), r(F.avg(F.col("flag").cast("int"))).alias("coverage"), F.max("run").cast("bigint").alias("longest"))


@query("a24_mode_aggregates", f"WITH {HOURLY}, m AS (SELECT base, t, value, CASE WHEN value <= 45 THEN 'stopped' WHEN value >= 55 THEN 'generating' ELSE 'transition' END AS mode FROM h), c AS (SELECT *, CASE WHEN mode <> lag(mode) OVER ({W}) THEN 1 ELSE 0 END AS ch FROM m) SELECT base, round(count(*) FILTER (WHERE mode = 'generating') / count(*), 6) AS generating, CAST(sum(ch) AS BIGINT) AS changes, round(avg(value) FILTER (WHERE mode = 'stopped'), 6) AS stopped_mean FROM c GROUP BY 1")
def a24(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("mode", detectors.operating_mode(F.col("value"), 45, 55))
    h = h.withColumn("ch", F.when(F.col("mode") != F.lag("mode").over(frames.keyed(["base"], ["t"])), 1).otherwise(0))
    return h.groupBy("base").agg(r(F.count_if(F.col("mode") == "generating") / F.count("*")).alias("generating"), F.sum("ch").alias("changes"), r(F.avg(F.when(F.col("mode") == "stopped", F.col("value")))).alias("stopped_mean"))


@query("a33_detection_metrics", f"WITH {SPANS}, {WINDOWS}, j AS (SELECT w_id, w_s, s FROM win LEFT JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e AND event_type = 'error') SELECT w_id, count(s) > 0 AS detected, round(greatest(0, min((epoch_us(s) - epoch_us(w_s)) / 3.6e9)), 5) AS delay_hours FROM j GROUP BY w_id HAVING count(s) > 0 UNION ALL SELECT w_id, false, NULL FROM j GROUP BY w_id HAVING count(s) = 0")
def a33(spark: SparkSession, d: str) -> DataFrame:
    e = spans(spark, d).where("event_type = 'error'")
    j = intervals.overlap_join(windows(spark, d), e, ["user_id"], ("w_start", "w_end"), ("start", "end"), "left")
    delay = F.min(scalars.hours_between(F.col("w_start"), F.col("start")))
    return j.groupBy("w_id").agg((F.count("start") > 0).alias("detected"), delay.alias("d")).select("w_id", "detected", F.round(F.when(F.col("d").isNotNull(), F.greatest(F.lit(0.0), "d")), 5).alias("delay_hours"))


@query("a37_fold_stability", f"WITH {PREDICTIONS}, f AS (SELECT repeat, avg(CAST(actual = predicted AS INTEGER)) AS acc FROM p GROUP BY 1) SELECT round(median(acc), 6) AS median, round(stddev_samp(acc), 6) AS std, round(avg(CAST(acc < 0.6 AS INTEGER)), 6) AS violations FROM f")
def a37(spark: SparkSession, d: str) -> DataFrame:
    f = predictions(spark, d).groupBy("repeat").agg(F.avg((F.col("actual") == F.col("predicted")).cast("int")).alias("acc"))
    return f.agg(r(F.percentile("acc", 0.5)).alias("median"), r(F.stddev_samp("acc")).alias("std"), r(F.avg((F.col("acc") < 0.6).cast("int"))).alias("violations"))


@query("a38_holdout_summary", f"WITH {PREDICTIONS} SELECT doc_id, count(*) AS appearances, CAST(sum(predicted) AS BIGINT) AS detected, round(median(probability) FILTER (WHERE predicted = 1), 6) AS median_when_detected FROM p GROUP BY 1")
def a38(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).groupBy("doc_id")
    return p.agg(F.count("*").alias("appearances"), F.sum("predicted").cast("bigint").alias("detected"), r(F.percentile(F.when(F.col("predicted") == 1, F.col("probability")), 0.5)).alias("median_when_detected"))


@query("a42_episode_mode", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS q FROM c) SELECT user_id, event_type AS dominant FROM k WHERE q = 1")
def a42(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "user_id", "event_type").groupBy("user_id").agg(F.mode("event_type", True).alias("dominant"))


@query("a45_top_signals", f"WITH {LONG}, a AS (SELECT base || '_' || stat AS name, avg(value) AS m, max(value) AS x FROM long WHERE t >= {REFERENCE} GROUP BY 1) SELECT name, round(m, 6) AS mean, round(x, 6) AS max, row_number() OVER (ORDER BY m DESC, name) AS rank FROM a QUALIFY rank <= 5")
def a45(spark: SparkSession, d: str) -> DataFrame:
    a = grid_long(spark, d).where(~_ref()).groupBy(F.concat_ws("_", "base", "stat").alias("name")).agg(F.avg("value").alias("m"), F.max("value").alias("x"))
    return ranking.top_n(a, [], [F.desc("m"), "name"], 5).select("name", r("m").alias("mean"), r("x").alias("max"), F.col("rank").cast("bigint").alias("rank"))


@query("a47_candidate_ranking", f"WITH {PREDICTIONS}, c AS (SELECT repeat, sum(CAST(actual = 1 AND predicted = 1 AS INTEGER)) / sum(actual) AS rec, sum(CAST(actual = 0 AND predicted = 1 AS INTEGER)) / sum(1 - actual) AS fpr FROM p GROUP BY 1) SELECT repeat, round(rec, 6) AS recall, round(fpr, 6) AS fpr, row_number() OVER (ORDER BY CAST(fpr <= 0.55 AS INTEGER) DESC, rec DESC, fpr, repeat) AS rank FROM c")
def a47(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.confusion(predictions(spark, d), ["repeat"], "actual", "predicted")
    # one row for each candidate
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc((F.col("fpr") <= 0.55).cast("int")), F.desc("recall"), "fpr", "repeat")
    return c.select("repeat", r("recall").alias("recall"), r("fpr").alias("fpr"), F.row_number().over(w).cast("bigint").alias("rank"))


@query("w30_tail_flag", f"WITH {HOURLY}, k AS (SELECT base, value >= 50 AS f, row_number() OVER (PARTITION BY base ORDER BY t DESC) AS n FROM h) SELECT base, count(*) FILTER (WHERE f) >= ceil(count(*) * 0.67) AS active FROM k WHERE n <= 3 GROUP BY 1")
def w30(spark: SparkSession, d: str) -> DataFrame:
    h = ranking.top_n(hourly(spark, d), ["base"], [F.desc("t")], 3)
    return h.groupBy("base").agg((F.count_if(F.col("value") >= 50) >= F.ceil(F.count("*") * 0.67)).alias("active"))


@query("w37_control_state", f"WITH {HOURLY}, w AS (SELECT t, avg(value) FILTER (WHERE base IN ('click', 'view')) AS a, max(value) FILTER (WHERE base = 'error') AS b FROM h GROUP BY 1) SELECT {T}, coalesce(a > 55, false) OR coalesce(b < 30, false) AS control FROM w")
def w37(spark: SparkSession, d: str) -> DataFrame:
    w = hourly(spark, d).groupBy("t").agg(F.avg(F.when(F.col("base").isin("click", "view"), F.col("value"))).alias("a"), F.max(F.when(F.col("base") == "error", F.col("value"))).alias("b"))
    no = F.lit(False)
    return w.select(sec("t").alias("t"), (F.coalesce(F.col("a") > 55, no) | F.coalesce(F.col("b") < 30, no)).alias("control"))


@query("r11_streaming_persistent", f"WITH {HOURLY}, m AS (SELECT *, count(*) OVER f = 6 AND avg(value / 100) OVER f >= 0.5 AS hit FROM h WINDOW f AS ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), i AS (SELECT *, sum(CASE WHEN hit IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER ({W}) AS k FROM (SELECT *, lag(hit) OVER ({W}) AS p FROM m)) SELECT base, {T}, hit AND row_number() OVER (PARTITION BY base, k ORDER BY t) >= 4 AS persistent FROM i")
def r11(spark: SparkSession, d: str) -> DataFrame:
    f = frames.trailing(frames.keyed(["base"], ["t"]), 6)
    h = hourly(spark, d).withColumn("hit", (F.count(F.lit(1)).over(f) == 6) & (F.avg(F.col("value") / 100).over(f) >= 0.5))
    return frames.run_length(h, "hit", ["base"], ["t"]).select("base", sec("t").alias("t"), (F.col("run") >= 4).alias("persistent"))


@query("t03_unique_contributors", "WITH k AS (SELECT event_type, user_id % 10 AS g, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) SELECT event_type, g, min(n) AS best FROM k WHERE n <= 20 GROUP BY 1, 2 ORDER BY best, event_type, g LIMIT 15")
def t03(spark: SparkSession, d: str) -> DataFrame:
    k = ranking.top_n(events(spark, d, "event_id", "user_id", "event_type", "value"), ["user_id"], [F.desc("value"), "event_id"], 20)
    return k.groupBy("event_type", (F.col("user_id") % 10).alias("g")).agg(F.min("rank").cast("bigint").alias("best")).orderBy("best", "event_type", "g").limit(15)


@query("t04_primary_episode", f"WITH {SPANS}, {WINDOWS}, j AS (SELECT w_id, event_id, row_number() OVER (PARTITION BY w_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, epoch_us(least(e, w_e)) - epoch_us(greatest(s, w_s)) DESC, s, event_id) AS n FROM win JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e) SELECT w_id, event_id FROM j WHERE n = 1")
def t04(spark: SparkSession, d: str) -> DataFrame:
    j = intervals.overlap_join(windows(spark, d), spans(spark, d), ["user_id"], ("w_start", "w_end"), ("start", "end"))
    by = [F.when(F.col("event_type") == "error", 0).otherwise(1), F.desc(F.unix_micros(F.least("end", "w_end")) - F.unix_micros(F.greatest("start", "w_start"))), "start", "event_id"]
    return ranking.top_n(j, ["w_id"], by, 1).select("w_id", "event_id")


@query("u01_union_by_name", "SELECT event_id, event_type, NULL::DOUBLE AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, round(value, 6) FROM events WHERE event_id % 2 = 1")
def u01(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "event_type", "value")
    return e.where("event_id % 2 = 0").select("event_id", "event_type").unionByName(e.where("event_id % 2 = 1").select("event_id", r("value").alias("value")), allowMissingColumns=True)


@query("u03_boundary_union", f"WITH {SPANS} SELECT user_id, CAST(floor(epoch(b)) AS BIGINT) AS boundary FROM (SELECT user_id, s AS b FROM spans UNION SELECT user_id, e FROM spans)")
def u03(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    return s.select("user_id", F.col("start").alias("b")).union(s.select("user_id", "end")).distinct().select("user_id", sec("b").alias("boundary"))


@query("u06_disjoint_parts", "SELECT count(*) AS shared FROM (SELECT doc_id FROM labels WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM labels WHERE doc_id % 3 = 1)")
def u06(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").select("doc_id")
    return x.where("doc_id % 3 = 0").intersect(x.where("doc_id % 3 = 1")).agg(F.count("*").alias("shared"))


@query("j15_signal_pairs", f"WITH {HOURLY} SELECT a.base AS i, b.base AS j, round(corr(a.value, b.value), 6) AS rho FROM h a JOIN h b ON a.t = b.t AND a.base < b.base GROUP BY 1, 2")
def j15(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).select("base", "t", "value")
    j = h.select(F.col("base").alias("i"), "t", F.col("value").alias("x")).join(h.select(F.col("base").alias("j"), "t", F.col("value").alias("y")), "t").where("i < j")
    return j.groupBy("i", "j").agg(r(F.corr("x", "y")).alias("rho"))


@query("m17_calibrated_threshold", f"WITH {HOURLY}, v AS (SELECT base, t, value, median(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM h WHERE t < {REFERENCE}), qs AS (SELECT base, quantile_cont(s, [0.9, 0.95, 0.99, 0.995]) AS a FROM v GROUP BY 1), th AS (SELECT base, unnest([0.9, 0.95, 0.99, 0.995]) AS q, unnest(a) AS th FROM qs), f AS (SELECT v.base, th.q, th.th, avg(CAST(s >= th.th AS INTEGER)) AS far FROM v JOIN th USING (base) GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY CASE WHEN far <= 0.02 THEN q ELSE 2 - q END) AS n FROM f) SELECT base, round(q, 3) AS q, round(th, 6) AS threshold, round(far, 6) AS far FROM k WHERE n = 1")
def m17(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).where(_ref())
    v = h.withColumn("s", frames.rolling(F.col("value"), frames.trailing(frames.keyed(["base"], ["t"]), 3), "median"))
    qs = (0.9, 0.95, 0.99, 0.995)
    th = v.groupBy("base").agg(F.percentile("s", F.array(*map(F.lit, qs))).alias("p")).select("base", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("p").alias("th"))).alias("z")).select("base", F.col("z.q").alias("q"), F.col("z.th").alias("th"))
    f = v.join(th, "base").groupBy("base", "q", "th").agg(F.avg((F.col("s") >= F.col("th")).cast("int")).alias("far"))
    # the first quantile that meets the false-alarm limit, else the strictest
    best = ranking.top_n(f, ["base"], [F.when(F.col("far") <= 0.02, F.col("q")).otherwise(2 - F.col("q"))], 1)
    return best.select("base", F.round("q", 3).alias("q"), r("th").alias("threshold"), r("far").alias("far"))


@query("m07_row_sampling", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR))) AS n FROM events) WHERE n <= 20")
def m07(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id")
    return ranking.top_n(e, ["user_id"], [F.md5(F.col("event_id").cast("string").cast("binary"))], 20).select("event_id")


@query("d20_error_categories", f"WITH {PREDICTIONS} SELECT doc_id, repeat, CASE WHEN actual = predicted THEN 'correct' WHEN predicted = 1 AND probability - threshold < 0.1 THEN 'false_positive_near' WHEN predicted = 1 THEN 'false_positive_clear' WHEN threshold - probability < 0.1 THEN 'false_negative_near' ELSE 'false_negative_clear' END AS category FROM p")
def d20(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("probability") - F.col("threshold")
    p = F.col("predicted")
    c = F.when(F.col("actual") == p, "correct").when((p == 1) & (m < 0.1), "false_positive_near").when(p == 1, "false_positive_clear").when(F.col("threshold") - F.col("probability") < 0.1, "false_negative_near").otherwise("false_negative_clear")
    return predictions(spark, d).select("doc_id", "repeat", c.alias("category"))
