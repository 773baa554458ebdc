"""Queries of event-level tables, joins of feature tables, and statistics side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, scalars
from ..operators import decisions, detectors, frames, intervals, joins, metrics, ranking, stats, tables
from .fixtures import BASE_Z, HOURLY, LONG, PREDICTIONS, REFERENCE, SPANS, WINDOWS, events, grid_long, hourly, predictions, r, sec, spans, table, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
T = "CAST(floor(epoch(t)) AS BIGINT) AS t"
W = "PARTITION BY base ORDER BY t"
SW = f"{SPANS}, {WINDOWS}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _ref() -> Column:
    return F.col("t") < F.lit("2024-01-11 00:00:00").cast("timestamp")


def _h(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 3.6e9"


@query("j01_event_features", f"WITH {SW}, a AS (SELECT w_id, count(*) AS n FROM win JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e GROUP BY 1), b AS (SELECT w_id, max({_h('s', 'e')}) AS longest FROM win JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e AND event_type = 'error' GROUP BY 1) SELECT w_id, w_label, coalesce(n, 0) AS n, round(coalesce(longest, 0), 5) AS longest FROM win LEFT JOIN a USING (w_id) LEFT JOIN b USING (w_id)")
def j01(spark: SparkSession, d: str) -> DataFrame:
    j = intervals.overlap_join(windows(spark, d), spans(spark, d), ["user_id"], ("w_start", "w_end"), ("start", "end"))
    a = j.groupBy("w_id").agg(F.count("*").alias("n"))
    b = j.where("event_type = 'error'").groupBy("w_id").agg(F.max(scalars.hours_between(F.col("start"), F.col("end"))).alias("longest"))
    out = joins.left_chain(windows(spark, d).select("w_id", "w_label"), [(a, ["w_id"]), (b, ["w_id"])], zeros=["n", "longest"])
    return out.select("w_id", "w_label", "n", F.round("longest", 5).alias("longest"))


@query("j04_ranking_descriptions", "SELECT l_partkey, l_linenumber, CASE WHEN p_size > 10 THEN p_name ELSE 'UNKNOWN' END AS description FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey")
def j04(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "lineitem").select("l_partkey", "l_linenumber").distinct().withColumn("base", F.concat(F.lit("part_"), F.col("l_partkey").cast("string")))
    known = table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("base"), F.col("p_name").alias("description"))
    return ranked.join(known, "base", "left").select("l_partkey", "l_linenumber", F.coalesce("description", F.lit("UNKNOWN")).alias("description"))


@query("j05_predictions_features", f"WITH {PREDICTIONS}, y AS (SELECT doc_id, any_value(n_chars) AS n FROM documents GROUP BY 1) SELECT p.doc_id, repeat, predicted, coalesce(y.n, -1) AS n_chars FROM p LEFT JOIN y ON y.doc_id = p.doc_id AND p.doc_id % 4 > 0")
def j05(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", "n_chars").where("doc_id % 4 > 0").dropDuplicates(["doc_id"])
    j = predictions(spark, d).select("doc_id", "repeat", "predicted").join(x, "doc_id", "left")
    return j.select("doc_id", "repeat", "predicted", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@query("j10_atomic_active", f"WITH {SPANS}, x AS (SELECT * FROM spans WHERE e > s), b AS (SELECT user_id, s AS t FROM x UNION SELECT user_id, e FROM x), atoms AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS z FROM b) SELECT atoms.user_id, epoch_us(a) AS a, epoch_us(z) AS z, count(*) AS n FROM atoms JOIN x ON atoms.user_id = x.user_id AND x.s < atoms.z AND x.e > atoms.a WHERE z IS NOT NULL GROUP BY ALL")
def j10(spark: SparkSession, d: str) -> DataFrame:
    x = spans(spark, d).where(F.col("end") > F.col("start"))
    return intervals.active_counts(x, ["user_id"], "start", "end").select("user_id", F.unix_micros("start").alias("a"), F.unix_micros("end").alias("z"), "n")


@query("j12_source_scope", f"WITH {SW}, x AS (SELECT w_id, win.user_id AS wu, spans.user_id AS su, event_id, CAST(spans.user_id % 4 AS VARCHAR) AS farm, CASE WHEN spans.user_id % 3 = 0 THEN '' ELSE CAST(spans.user_id AS VARCHAR) END AS source FROM win JOIN spans ON spans.user_id % 8 = win.user_id % 8 AND e >= w_s AND s <= w_s + INTERVAL 6 HOUR), f AS (SELECT *, max(CAST(farm = CAST(wu % 4 AS VARCHAR) AS INTEGER)) OVER (PARTITION BY w_id) AS af FROM x), g AS (SELECT * FROM f WHERE af = 0 OR farm = CAST(wu % 4 AS VARCHAR)), h AS (SELECT *, max(CAST(source <> '' AS INTEGER)) OVER (PARTITION BY w_id) AS an FROM g) SELECT w_id, event_id FROM h WHERE an = 0 OR source = CAST(wu AS VARCHAR)")
def j12(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).select("w_id", F.col("user_id").alias("wu"), (F.col("user_id") % 8).alias("k"), "w_start", (F.col("w_start") + F.expr("interval 6 hours")).alias("w_6"))
    s = spans(spark, d).select("event_id", (F.col("user_id") % 8).alias("k"), (F.col("user_id") % 4).cast("string").alias("farm"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("user_id").cast("string")).alias("source"), "start", "end")
    return tables.scoped_overlap(w, s, ["k"], ("w_start", "w_6"), ("start", "end"), "farm", "source", F.col("wu").cast("string"), (F.col("wu") % 4).cast("string"), ["w_id"], 86_400).select("w_id", "event_id")


DRAWS = """u AS (SELECT *, (CAST('0x' || substr(md5('0:' || resample || ':' || doc_id), 1, 10) AS BIGINT) + 0.5::DOUBLE) / 1099511627776.0::DOUBLE AS u FROM wide, (SELECT unnest(generate_series(1, 1000)) AS resample)),
cdf AS (SELECT k, sum(exp(-1.0::DOUBLE) / factorial(CAST(k AS INTEGER))) OVER (ORDER BY k) AS c FROM (SELECT unnest(generate_series(0, 8)) AS k)),
d AS (SELECT resample, a - b AS d, (SELECT count(*) FROM cdf WHERE u.u > cdf.c) AS w FROM u)"""
WIDE = f"WITH {PREDICTIONS}, wide AS (SELECT doc_id, max(CASE WHEN repeat = 1 THEN CAST(actual = predicted AS INTEGER) END) AS a, max(CASE WHEN repeat = 2 THEN CAST(actual = predicted AS INTEGER) END) AS b FROM p GROUP BY 1)"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).where("repeat <= 2")
    right = (F.col("actual") == F.col("predicted")).cast("int")
    return p.groupBy("doc_id").agg(F.max(F.when(F.col("repeat") == 1, right)).alias("a"), F.max(F.when(F.col("repeat") == 2, right)).alias("b"))


@query("j14_resample_cross", f"{WIDE}, {DRAWS} SELECT resample, CAST(sum(w) AS BIGINT) AS drawn, round(sum(w * d) / nullif(sum(w), 0), 6) AS difference FROM d GROUP BY 1")
def j14(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.resampled(_wide(spark, d), "a", "b", "doc_id", 1000)
    return m.select("resample", F.col("drawn").cast("bigint").alias("drawn"), r("m").alias("difference"))


@query("a39_bootstrap_difference", f"{WIDE}, {DRAWS}, m AS (SELECT resample, sum(w * d) / nullif(sum(w), 0) AS m FROM d GROUP BY 1) SELECT round(avg(m), 6) AS mean_difference, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CAST(m > 0 AS INTEGER)), 6) AS support FROM m")
def a39(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.bootstrap_difference(_wide(spark, d), "a", "b", "doc_id", 1000)
    return out.select(*(r(c).alias(c) for c in out.columns))


@query("a02_scale_of_one_series", "WITH q AS (SELECT median(value) AS c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM events), m AS (SELECT 1.4826::DOUBLE * median(abs(value - c)) AS m FROM events, q) SELECT n, round(c, 6) AS centre, round(CASE WHEN m > 1e-9 THEN m ELSE (q3 - q1) / 1.349::DOUBLE END, 6) AS scale FROM q, m")
def a02(spark: SparkSession, d: str) -> DataFrame:
    s = stats.robust_scale(events(spark, d, "value").withColumn("series", F.lit(0)), ["series"], "value")
    return s.select("n", r("centre").alias("centre"), r("scale").alias("scale"))


@query("a04_reference_statistics", f"WITH {LONG}, q AS (SELECT base, stat, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median, min(value) AS min, max(value) AS max FROM long WHERE t < {REFERENCE} GROUP BY 1, 2), m AS (SELECT l.base, l.stat, median(abs(l.value - q.median)) AS mad FROM long l JOIN q USING (base, stat) WHERE l.t < {REFERENCE} GROUP BY 1, 2), z AS (SELECT l.base, l.stat, max(CASE WHEN mad > 1e-9 THEN abs(l.value - median) / (1.4826::DOUBLE * mad) WHEN std > 1e-9 THEN abs(l.value - mean) / std ELSE 0 END) AS top FROM long l JOIN q USING (base, stat) JOIN m USING (base, stat) GROUP BY 1, 2) SELECT base, stat, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(mad, 6) AS mad, round(min, 6) AS min, round(max, 6) AS max, round(top, 5) AS top_z FROM q JOIN m USING (base, stat) JOIN z USING (base, stat)")
def a04(spark: SparkSession, d: str) -> DataFrame:
    x = stats.reference_z(grid_long(spark, d), _ref(), ["base", "stat"], "value")
    g = x.groupBy("base", "stat", "mean", "std", "median", "mad", "min", "max").agg(F.max("z").alias("z"))
    return g.select("base", "stat", *(r(c).alias(c) for c in ("mean", "std", "median", "mad", "min", "max")), F.round("z", 5).alias("top_z"))


ROWS = f"{LONG}, rows AS (SELECT t, list(value ORDER BY base, stat) AS a FROM long GROUP BY 1)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return grid_long(spark, d).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("base", "stat", "value"))), lambda x: x["value"]).alias("a"))


@query("a12_row_percentiles", f"WITH {ROWS} SELECT {T}, round(list_aggregate(a, 'quantile_cont', 0.95), 9) AS p95, round(list_aggregate(a, 'quantile_cont', 0.99), 9) AS p99, round(list_aggregate(a, 'median'), 6) AS median FROM rows")
def a12(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return _rows(spark, d).select(sec("t").alias("t"), F.round(arrays.quantile(a, 0.95), 9).alias("p95"), F.round(arrays.quantile(a, 0.99), 9).alias("p99"), r(arrays.quantile(a, 0.5)).alias("median"))


@query("a13_row_aggregates", f"WITH {ROWS} SELECT {T}, round(list_max(a), 6) AS max, round(list_aggregate(a, 'median'), 6) AS median, round(list_avg(a), 6) AS mean FROM rows")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(sec("t").alias("t"), *(r(arrays.row_aggregate(F.col("a"), how)).alias(how) for how in ("max", "median", "mean")))


def _clipped_union(where: str, gap: str = "") -> str:
    return f"""c AS (SELECT w_id, greatest(s, w_s) AS a, least(e, w_e) AS b, e, w_e FROM win JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e WHERE {where}),
k AS (SELECT *, max(b) OVER (PARTITION BY w_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE b > a),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY w_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM k),
m AS (SELECT w_id, {_h('min(a)', 'max(b)')} AS h, count(*) AS n FROM g GROUP BY w_id, grp),
u AS (SELECT w_id, CAST(sum(n) AS BIGINT) AS n_segments, count(*) AS n_merged, round(max(h), 5) AS max_hours, round(sum(h), 5) AS total_hours FROM m GROUP BY 1)"""


@query("a17_union_per_event", f"WITH {SW}, {_clipped_union('true')} SELECT * FROM u")
def a17(spark: SparkSession, d: str) -> DataFrame:
    u = tables.event_hours(windows(spark, d), spans(spark, d), ["user_id"], "w_id")
    return u.select("w_id", "n_segments", "n_merged", F.round("max_hours", 5).alias("max_hours"), F.round("total_hours", 5).alias("total_hours"))


@query("a19_rejected_candidates", f"WITH {SW}, {_clipped_union('event_id % 3 = 0', '+ INTERVAL 20 MINUTE')}, x AS (SELECT w_id, bool_or(abs(epoch_us(b) - epoch_us(w_e)) <= 1200000000) AS touches_end FROM c GROUP BY 1) SELECT u.*, touches_end FROM u JOIN x USING (w_id)")
def a19(spark: SparkSession, d: str) -> DataFrame:
    u = tables.rejected_candidates(windows(spark, d), spans(spark, d).where("event_id % 3 = 0"), ["user_id"], "w_id")
    return u.select("w_id", "n_segments", "n_merged", F.round("max_hours", 5).alias("max_hours"), F.round("total_hours", 5).alias("total_hours"), "touches_end")


TIMELINE = f"""{SW}, x AS (SELECT * FROM spans WHERE e > s), b AS (SELECT user_id, s AS t FROM x UNION SELECT user_id, e FROM x), atoms AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS z FROM b),
j AS (SELECT atoms.user_id, a, z, array_to_string(list_sort(list(DISTINCT x.event_type)), ';') AS active, count(DISTINCT x.event_type) AS n_active FROM atoms JOIN x ON atoms.user_id = x.user_id AND x.s < atoms.z AND x.e > atoms.a WHERE z IS NOT NULL GROUP BY ALL),
n AS (SELECT *, CASE WHEN lag(active) OVER w = active AND lag(z) OVER w = a THEN 0 ELSE 1 END AS fresh FROM j WINDOW w AS (PARTITION BY user_id ORDER BY a)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS grp FROM n),
tl AS (SELECT user_id, active, n_active, min(a) AS s, max(z) AS e FROM g GROUP BY user_id, grp, active, n_active)"""


@query("a21_timeline_facts", f"WITH {TIMELINE}, c AS (SELECT w_id, n_active, {_h('greatest(tl.s, w_s)', 'least(tl.e, w_e)')} AS h FROM win JOIN tl ON win.user_id = tl.user_id AND tl.e > w_s AND tl.s < w_e) SELECT w_id, count(*) AS n_intervals, count(*) FILTER (WHERE n_active >= 2) AS n_multi, max(n_active) AS max_active, round(avg(n_active), 6) AS mean_active, round(sum(h), 5) AS active_hours, round(sum(h) / 24, 5) AS coverage FROM c WHERE h > 0 GROUP BY 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    x = spans(spark, d).where(F.col("end") > F.col("start"))
    f = tables.timeline_facts(windows(spark, d), intervals.timeline(x, ["user_id"], "start", "end", "event_type"), ["user_id"], "w_id")
    return f.select("w_id", "n_intervals", "n_multi", "max_active", r("mean_active").alias("mean_active"), F.round("active_hours", 5).alias("active_hours"), F.round("coverage", 5).alias("coverage"))


@query("a22_model_dataset", "WITH a AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_error, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours, round(sum(value) FILTER (WHERE event_type = 'view') / 100, 6) AS view_hours, bool_or(value > 99) AS peak FROM events GROUP BY 1) SELECT user_id, round(n / (hours / 24), 5) AS n_per_day, round(n_error / (hours / 24), 5) AS n_error_per_day, round(view_hours / hours, 6) AS view_hours_share, round(ln(1 + n), 6) AS log_n, round(ln(1 + n_error), 6) AS log_n_error, round(ln(1 + view_hours), 6) AS log_view_hours, CAST(peak AS INTEGER) AS peak FROM a")
def a22(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_type")
    a = events(spark, d, "user_id", "event_type", "ts", "value").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(k == "error").alias("n_error"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("hours"), r(F.sum(F.when(k == "view", F.col("value"))) / 100).alias("view_hours"), F.bool_or(F.col("value") > 99).alias("peak"), F.lit(1).alias("constant"), F.lit(None).cast("int").alias("empty"))
    x = tables.model_features(a, "hours", ["n", "n_error"], ["view_hours"], ["peak"])
    made = ["n_per_day", "n_error_per_day", "view_hours_share", "log_n", "log_n_error", "log_view_hours", "peak"]
    kept = tables.varying(x, [*made, "constant", "empty"])
    return x.select("user_id", *((c if c == "peak" else F.round(c, 5 if c.endswith("_day") else 6).alias(c)) for c in made if c in kept or c == "peak"))


@query("a26_channel_summaries", f"WITH {SW}, j AS (SELECT w_id, event_type AS channel, value, row_number() OVER (PARTITION BY w_id, event_type ORDER BY ts, event_id) AS pos FROM win JOIN events ON events.user_id = win.user_id AND ts BETWEEN w_s - INTERVAL 240 HOUR AND w_e) SELECT w_id, channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 5) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(CASE WHEN count(*) > 1 THEN regr_slope(value, pos) ELSE 0 END, 5) AS slope, count(*) AS n FROM j GROUP BY 1, 2")
def a26(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "event_type", "ts", "value").withColumn("ts2", F.col("ts"))
    w = windows(spark, d).withColumn("a", F.col("w_start") - F.expr("interval 240 hours"))
    j = intervals.overlap_join(w, e, ["user_id"], ("a", "w_end"), ("ts", "ts2")).withColumn("pos", F.row_number().over(frames.keyed(["w_id", "event_type"], ["ts", "event_id"])))
    g = j.groupBy("w_id", F.col("event_type").alias("channel")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.coalesce(F.regr_slope("value", "pos"), F.lit(0.0)).alias("slope"), F.count("*").alias("n"))
    return g.select("w_id", "channel", r("mean").alias("mean"), F.round("std", 5).alias("std"), r("min").alias("min"), r("max").alias("max"), F.round("slope", 5).alias("slope"), "n")


RELATED = f"""{SW}, ep AS (SELECT event_id, user_id, s, e FROM spans WHERE event_type IN ('error', 'signup')),
meta AS (SELECT user_id, arg_min(w_id, w_id) AS w_id, arg_min(w_label, w_id) AS w_label, arg_min(w_s, w_id) AS w_s, arg_min(w_e, w_id) AS w_e FROM win GROUP BY 1),
rel AS (SELECT event_id, w_id, {_h('s', 'e')} AS hours, greatest(0, {_h('greatest(s, w_s)', 'least(e, w_e)')}) AS overlap, CASE WHEN w_s IS NULL THEN 'background' WHEN epoch_us(least(e, w_e)) > epoch_us(greatest(s, w_s)) THEN CASE WHEN w_label = 1 THEN 'overlap_anomaly' ELSE 'overlap_normal' END WHEN e < w_s THEN 'before_metadata' WHEN s > w_e THEN 'after_metadata' ELSE 'background' END AS relation FROM ep LEFT JOIN meta USING (user_id))"""


def _related(spark: SparkSession, d: str) -> DataFrame:
    ep = spans(spark, d).where("event_type in ('error', 'signup')")
    meta = windows(spark, d).groupBy("user_id").agg(F.min_by(F.struct("w_id", "w_label", "w_start", "w_end"), "w_id").alias("m")).select("user_id", "m.*")
    j = ep.join(meta, "user_id", "left")
    s, e, a, z = (F.col(c) for c in ("start", "end", "w_start", "w_end"))
    rel = decisions.episode_relation(s, e, a, z, F.when(F.col("w_label") == 1, "anomaly").otherwise("normal"))
    return j.select("event_id", "w_id", scalars.hours_between(s, e).alias("hours"), F.coalesce(scalars.overlap_hours(s, e, a, z), F.lit(0.0)).alias("overlap"), rel.alias("relation"))


@query("a48_episode_table", f"WITH {RELATED} SELECT event_id, w_id, round(coalesce(overlap, 0), 5) AS overlap_hours, relation FROM rel")
def a48(spark: SparkSession, d: str) -> DataFrame:
    return _related(spark, d).select("event_id", "w_id", F.round("overlap", 5).alias("overlap_hours"), "relation")


@query("a31_streaming_metrics", f"""WITH {RELATED}, ev AS (SELECT meta.w_id, w_label, count(s) > 0 AS detected, min({_h('w_s', 's')}) AS delay FROM meta LEFT JOIN ep ON ep.user_id = meta.user_id AND e >= w_s AND s <= w_e GROUP BY 1, 2),
a AS (SELECT count(*) AS n_events, count(*) FILTER (WHERE w_label = 1) AS n_anomalies, count(*) FILTER (WHERE w_label = 1 AND detected) AS n_detected, count(*) FILTER (WHERE w_label = 0 AND detected) AS n_normal_alerted, median(delay) FILTER (WHERE w_label = 1 AND detected) AS md, avg(delay) FILTER (WHERE w_label = 1 AND detected) AS ad, count(*) FILTER (WHERE w_label = 1 AND detected AND delay < 0) AS n_early, count(*) FILTER (WHERE w_label = 1 AND detected AND delay >= 0) AS n_late FROM ev),
b AS (SELECT count(*) AS n_episodes, count(*) FILTER (WHERE NOT starts_with(relation, 'overlap')) AS n_background, coalesce(sum(hours) FILTER (WHERE NOT starts_with(relation, 'overlap')), 0) AS bh FROM rel)
SELECT n_events, n_anomalies, n_detected, n_normal_alerted, n_early, n_late, round(md, 5) AS median_delay, round(ad, 5) AS mean_delay, n_episodes, n_background, round(bh, 4) AS background_hours, round(n_detected / nullif(n_anomalies, 0), 6) AS recall, round(n_normal_alerted / nullif(n_events - n_anomalies, 0), 6) AS false_positive_rate FROM a, b""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    ep = spans(spark, d).where("event_type in ('error', 'signup')")
    meta = windows(spark, d).groupBy("user_id").agg(F.min_by(F.struct("w_id", "w_label", "w_start", "w_end"), "w_id").alias("m")).select("user_id", "m.*")
    j = intervals.overlap_join(meta, ep, ["user_id"], ("w_start", "w_end"), ("start", "end"), "left")
    ev = j.groupBy("w_id", F.col("w_label").alias("label")).agg((F.count("start") > 0).alias("detected"), F.min(scalars.hours_between(F.col("w_start"), F.col("start"))).alias("delay_hours"))
    m = tables.streaming_metrics(ev, _related(spark, d))
    plain = ["n_events", "n_anomalies", "n_detected", "n_normal_alerted", "n_early", "n_late", "n_episodes", "n_background"]
    return m.select(*plain, F.round("median_delay", 5).alias("median_delay"), F.round("mean_delay", 5).alias("mean_delay"), F.round("background_hours", 4).alias("background_hours"), r("recall").alias("recall"), r("false_positive_rate").alias("false_positive_rate"))


@query("a37_tier_metrics", f"WITH {PREDICTIONS}, t AS (SELECT *, unnest([1, 2, 3]) AS tier FROM p), y AS (SELECT tier, repeat, actual, CAST(probability >= 0.3::DOUBLE + 0.1::DOUBLE * tier AS INTEGER) AS hit FROM t), c AS (SELECT tier, repeat, count(*) FILTER (WHERE actual = 1 AND hit = 1) / nullif(count(*) FILTER (WHERE actual = 1), 0) AS recall, count(*) FILTER (WHERE actual = 0 AND hit = 1) / nullif(count(*) FILTER (WHERE actual = 0), 0) AS fpr FROM y GROUP BY 1, 2) SELECT tier, round(median(recall), 6) AS recall, round(stddev_samp(recall), 6) AS recall_std, round(avg(CAST(fpr > 0.3 AS INTEGER)), 6) AS violations FROM c GROUP BY 1")
def a37t(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("tier", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    c = metrics.confusion(p.withColumn("hit", (F.col("probability") >= F.lit(0.3) + F.lit(0.1) * F.col("tier")).cast("int")), ["tier", "repeat"], "actual", "hit")
    return c.groupBy("tier").agg(r(F.percentile("recall", 0.5)).alias("recall"), r(F.stddev_samp("recall")).alias("recall_std"), r(F.avg((F.col("fpr") > 0.3).cast("int"))).alias("violations"))


@query("a43_early_warning_report", f"""WITH {SW}, j AS (SELECT w_id, w_label, w_s, CASE WHEN s IS NOT NULL THEN greatest(w_s - INTERVAL 30 DAY, s) END AS a, CASE WHEN s IS NOT NULL THEN least(w_s, e) END AS b FROM win LEFT JOIN spans ON win.user_id = spans.user_id AND event_type = 'error' AND e >= w_s - INTERVAL 30 DAY AND s <= w_s),
f AS (SELECT w_id, w_label, coalesce(bool_or(b >= w_s - INTERVAL 7 DAY), false) AS d7, coalesce(bool_or(b >= w_s - INTERVAL 14 DAY), false) AS d14, coalesce(bool_or(b >= w_s - INTERVAL 30 DAY), false) AS d30, max((epoch_us(w_s) - epoch_us(a)) / 3.6e9) / 24 AS lead FROM j GROUP BY 1, 2),
n AS (SELECT count(*) FILTER (WHERE w_label = 1) AS a, count(*) FILTER (WHERE w_label = 0) AS b FROM f)
SELECT round(count(*) FILTER (WHERE w_label = 1 AND d7) / any_value(a), 6) AS recall_7, round(count(*) FILTER (WHERE w_label = 1 AND d14) / any_value(a), 6) AS recall_14, round(count(*) FILTER (WHERE w_label = 1 AND d30) / any_value(a), 6) AS recall_30, round(count(*) FILTER (WHERE w_label = 0 AND NOT d30) / any_value(b), 6) AS specificity, round(count(*) FILTER (WHERE w_label = 0 AND d30) / any_value(b), 6) AS false_alert_rate, round(median(lead) FILTER (WHERE w_label = 1 AND d30), 6) AS median_lead FROM f, n""")
def a43(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.fusion import early_warning_summary

    w = windows(spark, d).withColumnsRenamed({"w_start": "start", "w_end": "end"})
    x = spans(spark, d).where("event_type = 'error'").select("user_id", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    s = early_warning_summary(w, x, ["user_id"], "w_id").join(w.select("w_id", F.col("w_label").alias("label")), "w_id")
    out = tables.early_warning_report(s)
    return out.select(*(r(c).alias(c) for c in out.columns))


@query("a47_target_aware_ranking", f"WITH {PREDICTIONS}, y AS (SELECT repeat, unnest([0.3, 0.4, 0.5, 0.6]) AS cut, actual, probability FROM p), c AS (SELECT repeat, cut, count(*) FILTER (WHERE actual = 1 AND probability >= cut) / count(*) FILTER (WHERE actual = 1) AS rec, count(*) FILTER (WHERE actual = 0 AND probability >= cut) / count(*) FILTER (WHERE actual = 0) AS fpr FROM y GROUP BY 1, 2), k AS (SELECT *, rec >= 0.5 AND fpr <= 0.5 AS feasible, greatest(0, 0.5 - rec) + greatest(0, fpr - 0.5) AS miss FROM c) SELECT repeat, round(cut, 2) AS cut, feasible, row_number() OVER (ORDER BY CAST(feasible AS INTEGER) DESC, round(miss, 9), round(rec, 9) DESC, round(fpr, 9), repeat, cut) AS rank FROM k")
def a47t(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("cut", F.explode(F.array(*map(F.lit, (0.3, 0.4, 0.5, 0.6)))))
    c = metrics.confusion(p.withColumn("hit", (F.col("probability") >= F.col("cut")).cast("int")), ["repeat", "cut"], "actual", "hit")
    ranked = metrics.rank_candidates(c, {"recall": (0.5, "least"), "fpr": (0.5, "most")}, [F.desc(F.round("recall", 9)), F.round("fpr", 9), "repeat", "cut"])
    return ranked.select("repeat", F.round("cut", 2).alias("cut"), "feasible", F.col("rank").cast("bigint").alias("rank"))


@query("a49_measurement_summary", f"WITH {BASE_Z} SELECT base, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.95), 6) AS p95, round(quantile_cont(z, 0.99), 6) AS p99, round(max(z), 6) AS max FROM z WHERE t >= {REFERENCE} GROUP BY 1")
def a49(spark: SparkSession, d: str) -> DataFrame:
    z = detectors.base_z(grid_long(spark, d).withColumn("fleet", F.lit("all")), _ref(), ["fleet"], "t").where(~_ref())
    return z.groupBy("base").agg(r(F.avg("z")).alias("mean"), r(F.percentile("z", 0.95)).alias("p95"), r(F.percentile("z", 0.99)).alias("p99"), r(F.max("z")).alias("max"))


@query("w14_first_rank", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS rank FROM events")
def w14(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "ts", "event_id")
    return events(spark, d, "event_id", "user_id", "value", "ts").select("event_id", F.row_number().over(w).cast("bigint").alias("rank"))


@query("w19_local_score", f"WITH {HOURLY}, x AS (SELECT base, t, value, abs(value - lag(value) OVER ({W})) AS d FROM h), sc AS (SELECT base, greatest(median(d), 0.01::DOUBLE * (quantile_cont(value, 0.95) - quantile_cont(value, 0.05)), 1e-6 * greatest(abs(median(value)), 1)) AS s FROM x GROUP BY 1), l AS (SELECT base, t, value, list(value) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, list(value) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b FROM h) SELECT base, {T}, round(coalesce(least(1e6, greatest(0, abs(value - list_aggregate(list_concat(coalesce(a, []), coalesce(b, [])), 'median')) / s)), 0), 6) AS score FROM l JOIN sc USING (base)")
def w19(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.baselines import comparison_scale

    h = hourly(spark, d)
    x = h.join(comparison_scale(h, ["base"], "t", "value"), "base")
    x = x.withColumn("m", frames.neighbour_median(F.col("value"), frames.keyed(["base"], ["t"]), 3))
    score = F.coalesce(F.least(F.lit(1e6), F.greatest(F.lit(0.0), F.abs(F.col("value") - F.col("m")) / F.col("scale"))), F.lit(0.0))
    return x.select("base", sec("t").alias("t"), r(score).alias("score"))


@query("w33_two_thresholds", f"""WITH {BASE_Z}, s AS (SELECT t, count(*) FILTER (WHERE z >= 1.2) / count(*) AS f, list_avg(list_slice(list_reverse_sort(list(z)), 1, 2)) AS k FROM z GROUP BY 1),
m AS (SELECT t, avg(f) OVER w AS sf, avg(k) OVER w AS sk FROM s WINDOW w AS (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)),
th AS (SELECT greatest(0.1, quantile_cont(sf, 0.9)) AS tf, greatest(0.5, quantile_cont(sk, 0.9)) AS tk FROM m WHERE t < {REFERENCE}),
x AS (SELECT t, sf >= tf - 1e-12 OR sk >= tk - 1e-12 AS flag FROM m, th),
i AS (SELECT *, sum(CASE WHEN flag IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (ORDER BY t) AS island FROM (SELECT *, lag(flag) OVER (ORDER BY t) AS p FROM x)),
c AS (SELECT *, count(*) OVER (PARTITION BY island) AS n, min(island) OVER () AS lo, max(island) OVER () AS hi FROM i)
SELECT {T}, flag, flag OR (island > lo AND island < hi AND n <= 2) AS bridged FROM c""")
def w33(spark: SparkSession, d: str) -> DataFrame:
    cfg = detectors.DetectorConfig(short_level=1.2, top=2)
    s = detectors.row_scores(detectors.base_z(grid_long(spark, d).withColumn("fleet", F.lit("all")), _ref(), ["fleet"], "t"), ["fleet"], "t", cfg)
    around = frames.centred(frames.keyed(["fleet"], ["t"]), 6)
    s = s.select("fleet", "t", F.avg("frac_short").over(around).alias("sf"), F.avg("top_mean").over(around).alias("sk"))
    for c, floor in (("sf", 0.1), ("sk", 0.5)):
        s = s.join(stats.adaptive_threshold(s, ["fleet"], c, 0.9, floor, _ref()).withColumnRenamed("threshold", f"t_{c}"), "fleet")
    s = s.withColumn("flag", (F.col("sf") >= F.col("t_sf") - 1e-12) | (F.col("sk") >= F.col("t_sk") - 1e-12))
    return frames.bridge(s, "flag", ["fleet"], ["t"], 2).select(sec("t").alias("t"), "flag", "bridged")


@query("w36_power_signature", f"WITH {HOURLY} SELECT base, {T}, round((median(value) OVER b + median(value) OVER a) / 2 - value, 6) AS local_dip, round(lag(value) OVER w - value, 6) AS previous_drop, round(lead(value) OVER w - value, 6) AS next_recovery, round((max(value) OVER a - min(value) OVER a) - (max(value) OVER b - min(value) OVER b), 6) AS range_change, round(stddev_pop(value) OVER a - stddev_pop(value) OVER b, 5) AS std_change FROM h WINDOW w AS ({W}), b AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)")
def w36(spark: SparkSession, d: str) -> DataFrame:
    x = tables.power_signature(hourly(spark, d), ["base"], "t", "value")
    return x.select("base", sec("t").alias("t"), *(r(c).alias(c) for c in ("local_dip", "previous_drop", "next_recovery", "range_change")), F.round("std_change", 5).alias("std_change"))


@query("t07_correlation_pruning", f"""WITH RECURSIVE {LONG}, x AS (SELECT base || '_' || stat AS name, t, value FROM long), v AS (SELECT name, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS v FROM x GROUP BY 1), o AS (SELECT name, row_number() OVER (ORDER BY round(v, 6) DESC, name) AS n FROM v),
c AS (SELECT a.name AS i, b.name AS j, abs(corr(a.value, b.value)) AS rho FROM x a JOIN x b ON a.t = b.t AND a.name <> b.name GROUP BY 1, 2),
k(n, kept) AS (SELECT 0, CAST([] AS VARCHAR[]) UNION ALL SELECT k.n + 1, CASE WHEN coalesce((SELECT max(rho) FROM c WHERE c.i = o.name AND list_contains(k.kept, c.j)), 0) < 0.3 THEN list_append(k.kept, o.name) ELSE k.kept END FROM k JOIN o ON o.n = k.n + 1)
SELECT unnest(kept) AS name FROM k WHERE n = (SELECT max(n) FROM k)""")
def t07(spark: SparkSession, d: str) -> DataFrame:
    x = grid_long(spark, d).select(F.concat_ws("_", "base", "stat").alias("name"), "t", "value")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    order = x.groupBy("name").agg(q.alias("q")).select("name", r(F.col("q")[1] - F.col("q")[0]).alias("v")).orderBy(F.desc("v"), "name")
    pairs = x.select("t", F.col("name").alias("i"), F.col("value").alias("a")).join(x.select("t", F.col("name").alias("j"), F.col("value").alias("b")), "t").where("i < j").groupBy("i", "j").agg(F.corr("a", "b").alias("rho"))
    # one row for each signal, and for each pair of signals
    names = [row["name"] for row in order.collect()]
    kept = ranking.prune_correlated(names, {(p["i"], p["j"]): p["rho"] or 0.0 for p in pairs.collect()}, 0.3)
    return spark.createDataFrame([(n,) for n in kept], "name string")


@query("t08_feature_ranking", f"WITH {LONG}, x AS (SELECT base || '_' || stat AS name, CASE WHEN value > 20 THEN value END AS v FROM long), q AS (SELECT name, count(v) AS n, count(*) AS a, median(v) AS c, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1), m AS (SELECT name, 1.4826::DOUBLE * median(abs(v - c)) AS m FROM x JOIN q USING (name) GROUP BY 1), y AS (SELECT name, round(CASE WHEN n >= 10 THEN greatest(q3 - q1, m) ELSE 0 END, 6) AS variability, round(1 - n / a, 6) AS missing FROM q JOIN m USING (name)) SELECT name, variability, missing, row_number() OVER (ORDER BY variability DESC, missing, name) AS rank FROM y")
def t08(spark: SparkSession, d: str) -> DataFrame:
    x = grid_long(spark, d).select(F.concat_ws("_", "base", "stat").alias("name"), F.when(F.col("value") > 20, F.col("value")).alias("v"))
    v = stats.robust_variability(x, ["name"], "v").join(x.groupBy("name").agg((1 - F.count("v") / F.count("*")).alias("missing")), "name").select("name", r("variability").alias("variability"), r("missing").alias("missing"))
    # one row for each signal
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("variability"), "missing", "name")
    return v.withColumn("rank", F.row_number().over(w).cast("bigint"))


@query("t11_model_choice", f"WITH {PREDICTIONS}, c AS (SELECT ['forest', 'logistic_regression', 'tree', 'boosted', 'bayes'][repeat] AS model, (count(*) FILTER (WHERE actual = 1 AND predicted = 1) / count(*) FILTER (WHERE actual = 1) + count(*) FILTER (WHERE actual = 0 AND predicted = 0) / count(*) FILTER (WHERE actual = 0)) / 2 AS s FROM p GROUP BY repeat), b AS (SELECT arg_max(model, {{'s': s, 'm': model}}) AS best, max(s) AS top, max(s) FILTER (WHERE model = 'logistic_regression') AS lr FROM c) SELECT CASE WHEN top - lr <= 0.02 THEN 'logistic_regression' ELSE best END AS chosen, best FROM b")
def t11(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.confusion(predictions(spark, d), ["repeat"], "actual", "predicted")
    names = F.array(*map(F.lit, ("forest", "logistic_regression", "tree", "boosted", "bayes")))
    return tables.choose_model(c.select(F.get(names, F.col("repeat") - 1).alias("model"), "balanced_accuracy"), "model", "balanced_accuracy", "logistic_regression", 0.02)


@query("t12_stable_choice", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(value >= 50 AS INTEGER) DESC, round(value, 0), event_type, event_id) AS n FROM events) WHERE n = 1")
def t12(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "event_type", "value")
    by = [F.desc((F.col("value") >= 50).cast("int")), F.round("value", 0), "event_type", "event_id"]
    return ranking.top_n(e, ["user_id"], by, 1).select("user_id", "event_id")


@query("u02_keep_first_or_last", "SELECT user_id, event_type, arg_min(event_id, {'t': ts, 'e': event_id}) AS first, arg_max(event_id, {'t': ts, 'e': event_id}) AS last FROM events GROUP BY 1, 2")
def u02(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "event_type", "ts").withColumn("day", F.lit(0))
    first, last = (frames.dedup_time(e, ["user_id", "event_type"], "day", ["ts", "event_id"], k).select("user_id", "event_type", F.col("event_id").alias(k)) for k in ("first", "last"))
    return first.join(last, ["user_id", "event_type"])


@query("u07_aligned_concat", "WITH a AS (SELECT user_id, event_id AS left_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id AS right_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, b.n) AS n, left_id, right_id FROM a FULL JOIN b ON a.user_id = b.user_id AND a.n = b.n")
def u07(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "event_type", "ts")
    a, b = (e.where(F.col("event_type") == k).select("user_id", "ts", F.col("event_id").alias(n)) for k, n in (("view", "left_id"), ("click", "right_id")))
    return joins.aligned(a, b, ["user_id"], ["ts", "left_id"], ["ts", "right_id"]).select("user_id", F.col("n").cast("bigint").alias("n"), "left_id", "right_id")


@query("p29_payload_fields", "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"inner\":{\"value\":' || event_id || ',\"kind\":\"' || CASE WHEN event_id % 2 = 0 THEN 'release 2' ELSE 'x' END || '\"}}' AS payload FROM events")
def p29(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.fusion import without_fields

    i = F.col("event_id")
    e = events(spark, d, "event_id", "event_type").select("event_id", F.struct("event_type", F.lit("anomaly").alias("event_label"), F.struct(F.lit(1).alias("label"), i.alias("number"), F.when(i % 2 == 0, "version v5").otherwise("x").alias("kind")).alias("inner")).alias("x"))
    x = without_fields(F.col("x"), e.schema["x"].dataType, rename={"number": "value"}, replace={"version v5": "release 2"})
    return e.select("event_id", F.to_json(x).alias("payload"))


SEG = "seg AS (SELECT user_id, s, e, event_id % 7 AS recovery, event_id % 5 AS variability, 4 AS signals, value FROM (SELECT sp.*, ev.value FROM spans sp JOIN events ev USING (event_id)) WHERE event_id % 2 = 0)"


@query("d10_short_episodes", f"""WITH {SW}, {SEG}, c AS (SELECT w_id, greatest(s, w_s) AS a, least(e, w_e) AS b, recovery >= 3 AS r, variability >= 3 AS v, value FROM win JOIN seg ON win.user_id = seg.user_id AND e >= w_s AND s <= w_e),
k AS (SELECT *, max(b) OVER (PARTITION BY w_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE b > a),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + INTERVAL 20 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY w_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM k)
SELECT w_id, CAST(grp AS BIGINT) AS episode, epoch_us(min(a)) AS start, epoch_us(max(b)) AS end, count(*) AS n, round(max(value), 6) AS max_score, CASE WHEN bool_or(r) THEN 'direct_recovery' WHEN bool_or(v) THEN 'variability' ELSE 'unconfirmed' END AS evidence FROM g GROUP BY w_id, grp""")
def d10(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    v = events(spark, d, "event_id", "value").where(i % 2 == 0)
    seg = spans(spark, d).join(v, "event_id").select("user_id", "start", "end", F.col("value").alias("score"), (i % 7).alias("recovery"), (i % 5).alias("variability"), F.lit(4).alias("signals"))
    x = tables.short_episodes(seg, ["user_id"], windows(spark, d), "w_id")
    return x.select("w_id", "episode", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", r("max_score").alias("max_score"), "evidence")


@query("d11_support", "SELECT event_id, need > 0 AND event_id % 7 >= need AS recovery, need > 0 AND event_id % 5 >= need AS variability FROM (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE least(event_id % 6, greatest(CASE WHEN event_id % 6 = 1 THEN 1 ELSE 2 END, CAST(ceil(event_id % 6 * 0.75) AS BIGINT))) END AS need FROM events)")
def d11(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    need = scalars.consensus(i % 6)
    return events(spark, d, "event_id").select("event_id", ((need > 0) & (i % 7 >= need)).alias("recovery"), ((need > 0) & (i % 5 >= need)).alias("variability"))


@query("d05_detector_driver", f"""WITH {BASE_Z}, s AS (SELECT t, count(*) FILTER (WHERE z >= 1.5) / count(*) AS fs, count(*) FILTER (WHERE z >= 1.0) / count(*) AS fp, round(max(z), 6) AS zm FROM z GROUP BY 1),
e AS (SELECT * FROM s WHERE t >= {REFERENCE}), k AS (SELECT t, (rank() OVER (ORDER BY fs) + (count(*) OVER (PARTITION BY fs) - 1) / 2) / count(*) OVER () AS a, (rank() OVER (ORDER BY fp) + (count(*) OVER (PARTITION BY fp) - 1) / 2) / count(*) OVER () AS b, (rank() OVER (ORDER BY zm) + (count(*) OVER (PARTITION BY zm) - 1) / 2) / count(*) OVER () AS c FROM e)
SELECT CAST(floor(epoch(s.t)) AS BIGINT) AS t, round((a + b + c) / 3, 6) AS rank FROM s LEFT JOIN k USING (t)""")
def d05(spark: SparkSession, d: str) -> DataFrame:
    """Composite rank within the event; null outside it."""
    cfg = detectors.DetectorConfig(short_level=1.5, persistent_level=1.0, top=3)
    s = detectors.row_scores(detectors.base_z(grid_long(spark, d).withColumn("fleet", F.lit("all")), _ref(), ["fleet"], "t"), ["fleet"], "t", cfg).withColumn("z_max", r("z_max"))
    x = detectors.composite_rank(s.where(~_ref()), ["fleet"], ["frac_short", "frac_persistent", "z_max"])
    return s.join(x.select("t", "detector_score"), "t", "left").select(sec("t").alias("t"), r("detector_score").alias("rank"))


@query("d09_display_timeline", f"WITH {SPANS} SELECT user_id, event_id FROM spans a WHERE NOT (event_type = 'error' AND EXISTS (SELECT 1 FROM spans b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND a.s >= b.s AND a.e <= b.e))")
def d09(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d).withColumnRenamed("event_type", "name")
    return tables.display_timeline(s, ["user_id"], "error", "view").select("user_id", "event_id")


@query("d21_evidence_table", f"WITH {PREDICTIONS}, v AS (SELECT doc_id, any_value(actual) AS actual, avg(predicted) AS vf, round(avg(probability), 6) AS pm FROM p GROUP BY 1), y AS (SELECT doc_id, lang, source, n_chars FROM documents) SELECT v.doc_id, round(vf, 6) AS vote_fraction, pm AS probability_mean, CASE WHEN vf < 0.4 THEN 'normal' WHEN vf > 0.6 THEN 'anomaly' ELSE 'review' END AS status, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, n_chars FROM v LEFT JOIN y USING (doc_id)")
def d21(spark: SparkSession, d: str) -> DataFrame:
    v = metrics.votes(predictions(spark, d), ["doc_id"], "probability", "threshold", "predicted")
    x = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    j = joins.left_chain(v, [(x, ["doc_id"])]).na.fill("unknown", ["lang", "source"])
    return j.select("doc_id", r("vote_fraction").alias("vote_fraction"), r("probability_mean").alias("probability_mean"), "status", "lang", "source", "n_chars")


WEIGHTS = {"quantity": 0.8, "price": -1.1, "discount": 0.5, "tax": -0.3}
COLUMNS = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
SCALED = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS {n}" for n, c in COLUMNS.items())
PARTS = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, '{n}' AS feature, {n} * {w}::DOUBLE AS c FROM sc" for n, w in WEIGHTS.items())


@query("d22_local_contributions", f"WITH sc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, {SCALED} FROM lineitem), p AS ({PARTS}), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate ORDER BY abs(c) DESC, feature) AS rank FROM p) SELECT l_orderkey, l_linenumber, feature, round(c, 4) AS contribution, rank FROM k WHERE rank <= 2")
def d22(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(n) for n, c in COLUMNS.items()))
    s = li.agg(*(F.avg(n).alias(f"m_{n}") for n in COLUMNS), *(F.stddev_pop(n).alias(f"s_{n}") for n in COLUMNS))
    # one row of means and deviations
    x = li.crossJoin(F.broadcast(s)).select(F.struct("l_orderkey", "l_linenumber").alias("id"), *(F.when(F.col(f"s_{n}") > 0, (F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}")).otherwise(0.0).alias(n) for n in COLUMNS))
    c = tables.contributions(x, "id", WEIGHTS, 2)
    return c.select("id.l_orderkey", "id.l_linenumber", "feature", F.round("contribution", 4).alias("contribution"), F.col("rank").cast("bigint").alias("rank"))


@query("d24_reason_texts", f"WITH {PREDICTIONS}, v AS (SELECT doc_id, avg(predicted) AS vf FROM p GROUP BY 1) SELECT doc_id, CAST(CAST(round(vf * 100) AS BIGINT) AS VARCHAR) || ' % of the votes are for an anomaly; the votes are ' || CASE WHEN greatest(vf, 1 - vf) >= 0.9 THEN 'stable' WHEN greatest(vf, 1 - vf) >= 0.7 THEN 'moderate' ELSE 'unstable' END || '.' AS reason FROM v")
def d24(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.fusion import vote_reason

    v = metrics.votes(predictions(spark, d), ["doc_id"], "probability", "threshold", "predicted")
    return v.select("doc_id", vote_reason(F.col("vote_fraction"), F.col("stability")).alias("reason"))
