"""Queries of detectors, decisions, evaluation and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import decisions, detectors, frames, metrics
from .fixtures import BASE_Z, HOURLY, PREDICTIONS, REFERENCE, SPANS, WINDOWS, events, grid_long, hourly, predictions, r, sec, spans, table, windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
T = "CAST(floor(epoch(t)) AS BIGINT) AS t"
CFG = detectors.DetectorConfig(short_level=1.5, persistent_level=1.0, active_level=1.5, persistent_floor=0.3, short_floor=0.2, quantile=0.9, top=3)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _ref():
    return F.col("t") < F.lit("2024-01-11 00:00:00").cast("timestamp")


def _z(spark: SparkSession, d: str) -> DataFrame:
    """Base z of the grid, as one fleet."""
    return detectors.base_z(grid_long(spark, d).withColumn("fleet", F.lit("all")), _ref(), ["fleet"], "t")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return detectors.row_scores(_z(spark, d), ["fleet"], "t", CFG)


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return detectors.detect(_scores(spark, d), ["fleet"], "t", _ref(), ~_ref(), F.lit(True), CFG)


SCORES = f"{BASE_Z}, s AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE z >= 1.5) / count(*) AS fs, count(*) FILTER (WHERE z >= 1.0) / count(*) AS fp, list_avg(list_slice(list_reverse_sort(list(z)), 1, 3)) AS top, max(z) AS zmax FROM z GROUP BY 1)"
DETECTED = (
    SCORES
    + f""",
th AS (SELECT greatest(0.2, quantile_cont(fs, 0.9) FILTER (WHERE t < {REFERENCE})) AS st FROM s),
rs AS (SELECT avg(fp) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS sm FROM s WHERE t < {REFERENCE}),
tp AS (SELECT greatest(0.3, quantile_cont(sm, 0.9)) AS pt FROM rs),
d AS (SELECT s.*, st, pt, fs >= st AND t >= {REFERENCE} AS short_flag, avg(fp) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS sm FROM s, th, tp),
dd AS (SELECT *, sum(CAST(short_flag AS INTEGER)) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) >= 2 AND t >= {REFERENCE} AS intermittent_flag, sm >= pt - 1e-12 AND t >= {REFERENCE} AS persistent_flag FROM d)"""
)


@query("a10_base_z", f"WITH {BASE_Z} SELECT {T}, base, round(z, 6) AS z FROM z")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return _z(spark, d).select(sec("t").alias("t"), "base", r("z").alias("z"))


@query("d00_row_scores", f"WITH {SCORES} SELECT {T}, n, round(fs, 6) AS frac_short, round(fp, 6) AS frac_persistent, round(top, 6) AS top_mean, round(zmax, 6) AS z_max FROM s")
def d00(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select(sec("t").alias("t"), "n", *(r(c).alias(c) for c in ("frac_short", "frac_persistent", "top_mean", "z_max")))


@query("d01_d03_row_detectors", f"WITH {DETECTED} SELECT {T}, round(st, 6) AS short_threshold, round(pt, 6) AS persistent_threshold, short_flag, intermittent_flag, persistent_flag FROM dd")
def d01(spark: SparkSession, d: str) -> DataFrame:
    cfg = F.col("smooth_persistent") >= F.col("persistent_threshold") - 1e-12
    x = _detected(spark, d).withColumn("persistent_flag", cfg & ~_ref())
    return x.select(sec("t").alias("t"), r("short_threshold").alias("short_threshold"), r("persistent_threshold").alias("persistent_threshold"), "short_flag", "intermittent_flag", "persistent_flag")


@query("d06_flag_segments", f"""WITH {DETECTED}, i AS (SELECT *, sum(CASE WHEN short_flag IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (ORDER BY t) AS k FROM (SELECT *, lag(short_flag) OVER (ORDER BY t) AS p FROM dd)),
c AS (SELECT *, short_flag OR (k > min(k) OVER () AND k < max(k) OVER () AND count(*) OVER (PARTITION BY k) <= 2) AS b FROM i),
j AS (SELECT *, sum(CASE WHEN b IS NOT DISTINCT FROM q THEN 0 ELSE 1 END) OVER (ORDER BY t) AS m FROM (SELECT *, lag(b) OVER (ORDER BY t) AS q FROM c))
SELECT CAST(epoch(min(t)) AS BIGINT) AS first, CAST(epoch(max(t)) AS BIGINT) AS last, count(*) AS n_points, round(max(top), 6) AS peak_score, row_number() OVER (ORDER BY min(t)) AS segment FROM j WHERE b GROUP BY m HAVING count(*) >= 2""")
def d06(spark: SparkSession, d: str) -> DataFrame:
    s = detectors.flag_segments(_detected(spark, d), "short_flag", ["fleet"], "t", "top_mean", CFG)
    return s.select(sec("first").alias("first"), sec("last").alias("last"), "n_points", r("peak_score").alias("peak_score"), F.col("segment").cast("bigint").alias("segment"))


@query("d08_composite_rank", f"WITH {SCORES}, k AS (SELECT t, (rank() OVER (ORDER BY fs) + (count(*) OVER (PARTITION BY fs) - 1) / 2) / count(*) OVER () AS a, (rank() OVER (ORDER BY zr) + (count(*) OVER (PARTITION BY zr) - 1) / 2) / count(*) OVER () AS b FROM (SELECT *, round(zmax, 6) AS zr FROM s)) SELECT {T}, round((a + b) / 2, 6) AS score FROM k")
def d08(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).withColumn("z_max", r("z_max"))
    return detectors.composite_rank(s, ["fleet"], ["frac_short", "z_max"]).select(sec("t").alias("t"), r("detector_score").alias("score"))


@query("w21_stable_core", f"WITH {BASE_Z}, c AS (SELECT t, base, z >= 1.5 AS a, avg(CAST(z >= 1.5 AS DOUBLE)) OVER (PARTITION BY base ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS cv FROM z) SELECT {T}, count(*) FILTER (WHERE a) AS n_active, count(*) FILTER (WHERE cv >= 0.6) AS n_stable FROM c GROUP BY 1")
def w21(spark: SparkSession, d: str) -> DataFrame:
    return detectors.stable_core(_z(spark, d), ["fleet"], "t", CFG).select(sec("t").alias("t"), "n_active", "n_stable")


@query("w34_power_evidence", f"""WITH {HOURLY}, x AS (SELECT *, CASE WHEN count(value) OVER b >= 3 THEN median(value) OVER b END AS ref, lead(value) OVER (PARTITION BY base ORDER BY t) AS nx FROM h WHERE base <> 'error' WINDOW b AS (PARTITION BY base ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
f AS (SELECT t, coalesce(ref > 0 AND value <= 0.8 * ref, false) AS dip, coalesce(nx >= 0.9 * ref, false) AS rec FROM x),
g AS (SELECT t, count(*) AS n_signals, count(*) FILTER (WHERE dip) AS n_dip, count(*) FILTER (WHERE dip AND rec) AS n_recovery FROM f GROUP BY 1)
SELECT {T}, n_signals, n_dip, n_recovery, n_dip >= ceil(n_signals * 0.5) AND n_recovery >= ceil(n_signals * 0.5) AS confirmed FROM g""")
def w34(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).where("base <> 'error'").withColumn("fleet", F.lit("all"))
    p = detectors.power_evidence(h, ["fleet"], "t", 0.8, 0.9, 0.5)
    return p.select(sec("t").alias("t"), "n_signals", "n_dip", "n_recovery", "confirmed")


@query("w26_operating_mode", f"""WITH {HOURLY}, m AS (SELECT base, t, CASE WHEN value / 100 <= 0.4 THEN 'stopped' WHEN value / 100 >= 0.55 THEN 'generating' ELSE 'transition' END AS mode FROM h),
i AS (SELECT *, sum(CASE WHEN mode = p THEN 0 ELSE 1 END) OVER (PARTITION BY base ORDER BY t) AS k FROM (SELECT *, lag(mode) OVER (PARTITION BY base ORDER BY t) AS p FROM m)),
a AS (SELECT *, row_number() OVER (PARTITION BY base, k ORDER BY t) AS n FROM i)
SELECT base, {T}, mode, last_value(CASE WHEN n >= 3 THEN mode END IGNORE NULLS) OVER (PARTITION BY base ORDER BY t ROWS UNBOUNDED PRECEDING) AS accepted FROM a""")
def w26(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("mode", detectors.operating_mode(F.col("value") / 100, 0.4, 0.55))
    return detectors.debounced(h, "mode", ["base"], "t").select("base", sec("t").alias("t"), "mode", "accepted")


FEATURES = f"""{SPANS}, {WINDOWS}, f AS (SELECT w_id, count(*) FILTER (WHERE event_type = 'error') AS short_count, count(*) AS max_short_24h, count(*) FILTER (WHERE event_type = 'signup') AS cluster_count,
coalesce(round(sum((epoch_us(least(e, w_e)) - epoch_us(greatest(s, w_s))) / 3.6e9) FILTER (WHERE event_type = 'view' AND least(e, w_e) > greatest(s, w_s)), 6), 0) AS persistent_hours, count(*) FILTER (WHERE event_type = 'purchase') AS localized_count, count(DISTINCT event_type) AS n_detectors, bool_or(e > w_e) AS censored
FROM win JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e GROUP BY 1)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.intervals import overlap_join

    j = overlap_join(windows(spark, d), spans(spark, d), ["user_id"], ("w_start", "w_end"), ("start", "end"))
    of = lambda k: F.count_if(F.col("event_type") == k)
    hours = scalars.overlap_hours(F.col("start"), F.col("end"), F.col("w_start"), F.col("w_end"))
    return j.groupBy("w_id").agg(of("error").alias("short_count"), F.count("*").alias("max_short_24h"), of("signup").alias("cluster_count"), F.coalesce(r(F.sum(F.when(F.col("event_type") == "view", hours))), F.lit(0.0)).alias("persistent_hours"), of("purchase").alias("localized_count"), F.count_distinct("event_type").alias("n_detectors"), F.bool_or(F.col("end") > F.col("w_end")).alias("censored"))


@query("a25_event_features", f"WITH {FEATURES} SELECT * FROM f")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d)


TRI = "['anomaly', 'review', 'normal']"


@query("d14_dual_relation", f"WITH x AS (SELECT event_id, {TRI}[1 + event_id % 3] AS a, {TRI}[1 + (event_id // 3) % 3] AS b FROM events) SELECT event_id, CASE WHEN a = 'anomaly' AND b = 'anomaly' THEN 'confirmed_by_both' WHEN a = 'anomaly' AND b = 'review' THEN 'offline_with_weak_stream' WHEN a = 'review' AND b = 'anomaly' THEN 'stream_with_weak_offline' WHEN a = 'anomaly' THEN 'offline_only' WHEN b = 'anomaly' THEN 'stream_only' WHEN a = 'review' AND b = 'review' THEN 'weak_in_both' WHEN a = 'review' THEN 'weak_offline_only' WHEN b = 'review' THEN 'weak_stream_only' ELSE 'normal_in_both' END AS relation FROM x")
def d14(spark: SparkSession, d: str) -> DataFrame:
    tri = F.array(*map(F.lit, ("anomaly", "review", "normal")))
    at = lambda i: F.get(tri, i.cast("int"))
    e = events(spark, d, "event_id")
    return e.select("event_id", decisions.dual_relation(at(F.col("event_id") % 3), at(F.floor(F.col("event_id") / 3) % 3)).alias("relation"))


@query("d15_three_source_fusion", f"WITH x AS (SELECT event_id, {TRI}[1 + event_id % 3] AS a, {TRI}[1 + (event_id // 3) % 3] AS b, (event_id // 9) % 2 = 0 AS av, (event_id // 18) % 2 = 0 AS w FROM events) SELECT event_id, CASE WHEN a = 'anomaly' AND (b = 'anomaly' OR (av AND w)) THEN 'anomaly' WHEN a = 'normal' AND b = 'normal' AND av AND NOT w THEN 'normal' ELSE 'review_required' END AS fused FROM x")
def d15(spark: SparkSession, d: str) -> DataFrame:
    tri = F.array(*map(F.lit, ("anomaly", "review", "normal")))
    i = F.col("event_id")
    at = lambda x: F.get(tri, x.cast("int"))
    bit = lambda n: F.floor(i / n) % 2 == 0
    return events(spark, d, "event_id").select("event_id", decisions.three_source_fusion(at(i % 3), at(F.floor(i / 3) % 3), bit(9), bit(18)).alias("fused"))


@query("a44_offlog_priority", "SELECT event_id, round(least(1, greatest(0, (0.35::DOUBLE * least(1, value / 100) + 0.20::DOUBLE * least(1, ln(1 + event_id % 48) / ln(25)) + 0.20::DOUBLE * least(1, (event_id % 6) / 4) + 0.20::DOUBLE * least(1, ln(1 + event_id % 300) / ln(101)) + 0.05::DOUBLE * least(1, (event_id % 400) / 168)) * CASE WHEN event_id % 5 = 0 THEN 0.65::DOUBLE ELSE 1 END * CASE WHEN event_id % 7 = 0 THEN 0.9::DOUBLE ELSE 1 END)), 6) AS priority FROM events")
def a44(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    p = decisions.offlog_priority(F.col("value") / 100, i % 48, i % 6, i % 300, i % 400, i % 5 == 0, i % 7 == 0)
    return events(spark, d, "event_id", "value").select("event_id", r(p).alias("priority"))


@query("r18_alert_score", "SELECT event_id, round(CASE WHEN event_id % 4 >= 2 THEN greatest(value / 100 * 0.9::DOUBLE, (event_id % 11) / 10.0::DOUBLE * 0.7::DOUBLE, least(1, 0.55::DOUBLE + 0.2::DOUBLE * (event_id % 4))) ELSE greatest(value / 100 * 0.9::DOUBLE, (event_id % 11) / 10.0::DOUBLE * 0.7::DOUBLE) END, 6) AS score FROM events")
def r18(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, d, "event_id", "value").select("event_id", r(decisions.alert_score([(F.col("value") / 100, 0.9), ((i % 11) / 10.0, 0.7)], i % 4)).alias("score"))


@query("m06_window_labels", f"WITH {SPANS}, {WINDOWS}, j AS (SELECT w_id, event_id, w_label, CASE WHEN e > s THEN greatest(0, epoch_us(least(e, w_e)) - epoch_us(greatest(s, w_s))) / (epoch_us(e) - epoch_us(s)) ELSE 0 END AS ratio, greatest(0, (epoch_us(w_s) - epoch_us(e)) / 3.6e9, (epoch_us(s) - epoch_us(w_e)) / 3.6e9) AS dist FROM spans JOIN win USING (user_id)) SELECT w_id, event_id, CASE WHEN w_label = 1 AND ratio >= 0.1 THEN 1 WHEN w_label = 1 AND ratio = 0 AND dist >= 24 THEN 0 WHEN w_label = 0 THEN 0 END AS label FROM j")
def m06(spark: SparkSession, d: str) -> DataFrame:
    j = spans(spark, d).join(windows(spark, d), "user_id")
    s, e, a, z = (F.col(c) for c in ("start", "end", "w_start", "w_end"))
    ratio = F.coalesce(scalars.divide(scalars.overlap_hours(s, e, a, z), scalars.hours_between(s, e)), F.lit(0.0))
    distance = F.greatest(F.lit(0.0), scalars.hours_between(e, a), scalars.hours_between(z, s))
    return j.select("w_id", "event_id", decisions.window_label(ratio, F.col("w_label"), distance).alias("label"))


@query("a28_confusion", f"WITH {PREDICTIONS}, c AS (SELECT repeat, count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE actual = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS fn FROM p GROUP BY 1) SELECT repeat, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(fp / nullif(fp + tn, 0), 6) AS fpr, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 6) AS f2 FROM c")
def a28(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.confusion(predictions(spark, d), ["repeat"], "actual", "predicted")
    return c.select("repeat", "tp", "tn", "fp", "fn", *(r(x).alias(x) for x in c.columns[5:]))


@query("a29_areas", f"WITH {PREDICTIONS}, k AS (SELECT *, rank() OVER (PARTITION BY repeat ORDER BY probability) + (count(*) OVER (PARTITION BY repeat, probability) - 1) / 2 AS rk FROM p), u AS (SELECT repeat, sum(CASE WHEN actual = 1 THEN rk END) AS s, count(*) FILTER (WHERE actual = 1) AS a, count(*) FILTER (WHERE actual = 0) AS b FROM k GROUP BY 1), g AS (SELECT repeat, probability, sum(actual) AS pp, count(*) AS nn FROM p GROUP BY 1, 2), c AS (SELECT *, sum(pp) OVER w AS tp, sum(nn) OVER w AS al FROM g WINDOW w AS (PARTITION BY repeat ORDER BY probability DESC)), ap AS (SELECT repeat, sum(pp * tp / al) / sum(pp) AS ap FROM c GROUP BY 1) SELECT repeat, round((s - a * (a + 1) / 2) / (a * b), 6) AS roc_auc, round(ap, 6) AS pr_auc FROM u JOIN ap USING (repeat)")
def a29(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    j = metrics.roc_auc(p, ["repeat"], "actual", "probability").join(metrics.average_precision(p, ["repeat"], "actual", "probability"), "repeat")
    return j.select("repeat", r("roc_auc").alias("roc_auc"), r("pr_auc").alias("pr_auc"))


@query("a35_votes", f"WITH {PREDICTIONS}, v AS (SELECT doc_id, count(*) AS n_votes, avg(predicted) AS vf, avg(probability) AS pm, median(probability) AS pd, stddev_samp(probability) AS ps, avg(threshold) AS tm, avg(probability - threshold) AS mm FROM p GROUP BY 1) SELECT doc_id, n_votes, round(vf, 6) AS vote_fraction, round(pm, 6) AS probability_mean, round(pd, 6) AS probability_median, round(ps, 6) AS probability_std, round(tm, 6) AS threshold_mean, round(mm, 6) AS margin_mean, CAST(vf >= 0.5 AS INTEGER) AS decision, CASE WHEN vf < 0.4 THEN 'normal' WHEN vf > 0.6 THEN 'anomaly' ELSE 'review' END AS status, CASE WHEN greatest(vf, 1 - vf) >= 0.9 THEN 'stable' WHEN greatest(vf, 1 - vf) >= 0.7 THEN 'moderate' ELSE 'unstable' END AS stability FROM v")
def a35(spark: SparkSession, d: str) -> DataFrame:
    v = metrics.votes(predictions(spark, d), ["doc_id"], "probability", "threshold", "predicted")
    return v.select("doc_id", "n_votes", *(r(c).alias(c) for c in ("vote_fraction", "probability_mean", "probability_median", "probability_std", "threshold_mean", "margin_mean")), "decision", "status", "stability")


@query("a40_exact_test", "WITH x AS (SELECT 10 + CAST(event_id % 13 AS INTEGER) AS b, CAST(event_id % 7 AS INTEGER) AS c FROM events), u AS (SELECT DISTINCT b, c FROM x), s AS (SELECT b, c, unnest(generate_series(0, least(b, c))) AS i FROM u) SELECT b, c, round(least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))), 6) AS p FROM s GROUP BY 1, 2")
def a40(spark: SparkSession, d: str) -> DataFrame:
    x = events(spark, d, "event_id").select((10 + F.col("event_id") % 13).cast("int").alias("b"), (F.col("event_id") % 7).cast("int").alias("c")).distinct()
    return x.select("b", "c", r(metrics.binomial_column(F.col("b"), F.col("c"))).alias("p"))


@query("t10_threshold_grid", f"WITH {PREDICTIONS}, g AS (SELECT unnest(generate_series(0, 20)) AS k), e AS (SELECT k, sum(CASE WHEN actual = 1 AND least(floor(probability * 20 + 1e-9), 20) >= k THEN 1 ELSE 0 END) / sum(actual) AS recall, sum(CASE WHEN actual = 0 AND least(floor(probability * 20 + 1e-9), 20) >= k THEN 1 ELSE 0 END) / sum(1 - actual) AS fpr FROM g, p GROUP BY 1) SELECT round(k / 20, 6) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round((recall + 1 - fpr) / 2, 6) AS balanced_accuracy FROM e WHERE fpr <= 0.2 ORDER BY (recall + 1 - fpr) / 2 DESC, k DESC LIMIT 1")
def t10(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.threshold_grid(predictions(spark, d), "actual", "probability", 20, 0.2)
    return g.select(*(r(c).alias(c) for c in g.columns))


@query("a34_false_alarms", "WITH f AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), g AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 > 43200 THEN 1 ELSE 0 END AS late FROM f), n AS (SELECT *, sum(late) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM g), m AS (SELECT user_id, count(DISTINCT ep) AS n_episodes FROM n GROUP BY 1), s AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 8.64e10 AS days FROM events GROUP BY 1) SELECT user_id, n_episodes, round(n_episodes / (days / 30.4375::DOUBLE), 5) AS per_month FROM m JOIN s USING (user_id)")
def a34(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "user_id", "ts", "event_type")
    n = frames.episodes(e.where("event_type = 'error'"), ["user_id"], "ts", 43_200).groupBy("user_id").agg(F.count("*").alias("n_episodes"))
    days = e.groupBy("user_id").agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 8.64e10).alias("days"))
    return n.join(days, "user_id").select("user_id", "n_episodes", F.round(F.col("n_episodes") / (F.col("days") / 30.4375), 5).alias("per_month"))


@query("m09_balanced_weights", "WITH c AS (SELECT doc_id, toxic, count(*) OVER (PARTITION BY toxic) AS n FROM labels), w AS (SELECT doc_id, 1.0::DOUBLE / n AS w FROM c) SELECT doc_id, round(w / avg(w) OVER (), 6) AS weight FROM w")
def m09(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ml import balanced_weights

    return balanced_weights(table(spark, d, "labels").select("doc_id", "toxic"), ["toxic"]).select("doc_id", r("weight").alias("weight"))


@query("m08_class_balance", "WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY toxic, quality ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k FROM labels), o AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY k, quality) AS n, (SELECT count(*) FROM labels WHERE toxic = 1) AS pos FROM r) SELECT doc_id, toxic FROM o WHERE toxic = 1 OR n <= 3 * pos")
def m08(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ml import balance_classes

    x = table(spark, d, "labels").select("doc_id", "toxic", "quality")
    return balance_classes(x, "toxic", ["quality"], "doc_id", 3).select("doc_id", "toxic")


@query("m15_spearman", "WITH k AS (SELECT l_suppkey % 10 AS g, (rank() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey % 10, l_quantity) - 1) / 2) AS a, (rank() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey % 10, l_extendedprice) - 1) / 2) AS b FROM lineitem) SELECT g, round(corr(a, b), 6) AS rho FROM k GROUP BY 1")
def m15(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ml import spearman

    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), "l_quantity", "l_extendedprice")
    return spearman(li, ["g"], "l_quantity", "l_extendedprice").select("g", r("rho").alias("rho"))


@query("m16_binned_mutual_information", "WITH b AS (SELECT CAST(floor(l_quantity / 5) AS INTEGER) AS x, CAST(floor(l_discount * 50) AS INTEGER) AS y FROM lineitem), j AS (SELECT x, y, count(*) AS n FROM b GROUP BY 1, 2), p AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j) SELECT round(sum(n / t * ln(n * t / (nx * ny))), 8) AS mi FROM p")
def m16(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ml import mutual_information

    li = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 5).alias("x"), F.floor(F.col("l_discount") * 50).alias("y"))
    return mutual_information(li, "x", "y").select(F.round("mi", 8).alias("mi"))


@query("m10_channel_scaler", "WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1) SELECT event_id, round(greatest(-10, least(10, (value - m) / sd)), 6) AS z FROM events JOIN s USING (event_type)")
def m10(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ml import scale_channels

    return scale_channels(events(spark, d, "event_id", "event_type", "value"), ["event_type"], "value").select("event_id", r("scaled").alias("z"))


@query("m04_chronological_holdout", """WITH g AS (SELECT user_id, min(ts) AS s, max(CAST(user_id % 29 = 3 AS INTEGER)) AS hit FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY s DESC, user_id DESC) AS k, greatest(1, least(ceil(0.05::DOUBLE * count(*) OVER ()), count(*) OVER () - 2)) AS size FROM g),
f AS (SELECT *, max(CASE WHEN k <= size THEN hit ELSE 0 END) OVER () AS has, min(CASE WHEN hit = 1 THEN k END) OVER () AS best FROM n)
SELECT user_id, CASE WHEN CASE WHEN has = 1 OR best IS NULL THEN k <= size ELSE (k > 1 AND k <= size) OR k = best END THEN 'test' ELSE 'train' END AS part FROM f""")
def m04(spark: SparkSession, d: str) -> DataFrame:
    """The last users by first event; the latest labelled one takes the last one's place if there is none among them."""
    from ..operators.ml import chronological_holdout

    e = events(spark, d, "user_id", "ts").withColumn("label", (F.col("user_id") % 29 == 3).cast("int"))
    return chronological_holdout(e, "user_id", "ts", "label", 0.05).select("user_id", "part")


@query("m04_purged_holdout", """WITH n AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS c FROM events), s AS (SELECT min(ts) AS s FROM n WHERE k = greatest(1, least(floor(c * 0.8::DOUBLE), c - 1)))
SELECT event_id, CASE WHEN ts >= s THEN 'test' WHEN ts < s - INTERVAL 24 HOUR THEN 'train' ELSE 'purged' END AS part FROM events, s""")
def m04_purged(spark: SparkSession, d: str) -> DataFrame:
    """Rows in order of time, with a day left out between the parts."""
    from ..operators.ml import purged_holdout

    return purged_holdout(events(spark, d, "event_id", "ts"), "ts", 0.2, 24).select("event_id", "part")


@query("m12_reconstruction_scores")
def m12(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ml import reconstruction_scores

    return reconstruction_scores(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query("m01_logistic_votes")
def m01(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ml import nested_cv

    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    x = x.select("doc_id", F.col("toxic").alias("label"), F.log1p("n_chars").alias("f0"), F.col("quality").cast("double").alias("f1"), (F.col("lang") == "en").cast("double").alias("f2"))
    return nested_cv(x, "doc_id", "label", ["f0", "f1", "f2"])
