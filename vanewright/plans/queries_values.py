"""Queries of projection, cleaning, scalar, set and aggregate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, scalars
from ..operators import stats
from .fixtures import GRID, HOURLY, LONG, REFERENCE, events, grid, grid_long, hourly, r, sec, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _ref():
    return F.col("t") < F.lit("2024-01-11 00:00:00").cast("timestamp")


@query("p02_identifiers", "SELECT event_id, regexp_replace(trim(CAST(CAST(event_id AS VARCHAR) || '.0' AS VARCHAR)), '\\.0$', '') AS id, coalesce(CASE WHEN event_id % 7 > 0 THEN CAST(event_id AS VARCHAR) END, '') AS token FROM events")
def p02(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id")
    text = F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".0 "))
    return e.select("event_id", scalars.identifier(text).alias("id"), scalars.status_token(F.when(F.col("event_id") % 7 > 0, F.col("event_id"))).alias("token"))


@query("p03_plain_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalars.plain_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("p04_numeric_coercion", "SELECT event_id, round(coalesce(try_cast(CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE CAST(event_id AS VARCHAR) || '.5' END AS DOUBLE), 0), 6) AS v FROM events")
def p04(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, "x").when(k == 1, F.lit(None)).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return events(spark, d, "event_id").select("event_id", r(scalars.number(text, 0.0)).alias("v"))


@query("p06_truth_and_labels", "SELECT event_id, coalesce(lower(trim(w)) IN ('true','1','yes','y','t'), false) AS flag, CASE WHEN lower(trim(w)) IN ('anomaly','anomalous','fault','faulty','abnormal','1','true','yes') THEN 1 WHEN lower(trim(w)) IN ('normal','healthy','0','false','no') THEN 0 WHEN try_cast(w AS DOUBLE) > 0 THEN 1 WHEN try_cast(w AS DOUBLE) <= 0 THEN 0 END AS label FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' True' WHEN 1 THEN 'no' WHEN 2 THEN NULL WHEN 3 THEN 'Anomaly ' WHEN 4 THEN 'normal' WHEN 5 THEN '2.5' WHEN 6 THEN '-1' ELSE 'odd' END AS w FROM events)")
def p06(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 8
    w = F.when(k == 0, " True").when(k == 1, "no").when(k == 3, "Anomaly ").when(k == 4, "normal").when(k == 5, "2.5").when(k == 6, "-1").when(k == 7, "odd")
    return events(spark, d, "event_id").select("event_id", scalars.truth(w).alias("flag"), scalars.label(w).alias("label"))


@query("p08_dedup_time", "SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, l_orderkey, l_linenumber, which FROM (SELECT *, 'first' AS which, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem UNION ALL SELECT *, 'last', row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC) FROM lineitem) WHERE n = 1")
def p08(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.frames import dedup_time

    li = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    both = [dedup_time(li, ["l_suppkey"], "l_shipdate", ["l_orderkey", "l_linenumber"], k).withColumn("which", F.lit(k)) for k in ("first", "last")]
    return both[0].union(both[1]).select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_orderkey", "l_linenumber", "which")


@query("p09_sampling_interval", "SELECT user_id, round(median(g), 6) AS sampling_minutes FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 6e7 AS g FROM events) WHERE g > 0 GROUP BY 1")
def p09(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.frames import sampling_minutes

    return sampling_minutes(events(spark, d, "user_id", "ts"), ["user_id"], "ts").select("user_id", r("sampling_minutes").alias("sampling_minutes"))


@query("p12_signal_names", "SELECT DISTINCT name, regexp_replace(name, '_(avg|max|min|std)$', '') AS base, regexp_extract(name, '_(avg|max|min|std)$', 1) AS stat, CASE WHEN starts_with(name, 'reactive_power') THEN 'reactive_power' WHEN starts_with(name, 'wind_speed') THEN 'wind_speed' WHEN starts_with(name, 'power') THEN 'power' WHEN starts_with(name, 'sensor') THEN 'sensor' ELSE 'other' END AS family FROM (SELECT ['reactive_power_','power_','wind_speed_','sensor_','x_'][1 + event_id % 5] || CAST(event_id % 30 AS VARCHAR) || ['_avg','_max','_min','_std',''][1 + (event_id // 5) % 5] AS name FROM events)")
def p12(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    i = F.col("event_id")
    name = F.concat(pick(("reactive_power_", "power_", "wind_speed_", "sensor_", "x_"), i % 5), (i % 30).cast("string"), pick(("_avg", "_max", "_min", "_std", ""), F.floor(i / 5) % 5))
    n = events(spark, d, "event_id").select(name.alias("name")).distinct()
    return n.select("name", scalars.base_signal(F.col("name")).alias("base"), scalars.statistic(F.col("name")).alias("stat"), scalars.family(F.col("name")).alias("family"))


@query("p16_period_slice", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'before' WHEN ts <= TIMESTAMP '2024-01-12' THEN 'event' ELSE 'after' END AS period FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def p16(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp")
    e = events(spark, d, "event_id", "ts").where(F.col("ts").between(at("2024-01-05"), at("2024-01-20")))
    return e.select("event_id", F.when(F.col("ts") < at("2024-01-10"), "before").when(F.col("ts") <= at("2024-01-12"), "event").otherwise("after").alias("period"))


@query("p17_equal_segments", "WITH w AS (SELECT user_id, min(event_id) AS s, min(event_id) + 499 AS e FROM events WHERE event_id >= 1000 GROUP BY 1) SELECT v.event_id, v.user_id, CASE WHEN v.event_id BETWEEN s AND e THEN 'during' WHEN v.event_id < s THEN 'before' ELSE 'after' END AS segment FROM events v JOIN w USING (user_id) WHERE v.event_id BETWEEN s - (e - s + 1) AND e + (e - s + 1)")
def p17(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id")
    w = e.where("event_id >= 1000").groupBy("user_id").agg(F.min("event_id").alias("s")).withColumn("e", F.col("s") + 499)
    n = F.col("e") - F.col("s") + 1
    j = e.join(w, "user_id").where(F.col("event_id").between(F.col("s") - n, F.col("e") + n))
    return j.select("event_id", "user_id", F.when(F.col("event_id").between(F.col("s"), F.col("e")), "during").when(F.col("event_id") < F.col("s"), "before").otherwise("after").alias("segment"))


@query("p28_safe_arithmetic", "SELECT event_id, round(CASE WHEN event_id % 5 <> 0 THEN value / (event_id % 5) END, 6) AS ratio, round(CASE WHEN abs(value - 50) >= 1e-9 THEN (value - (value - 50)) / abs(value - 50) END, 4) AS change FROM events")
def p28(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "value")
    return e.select("event_id", r(scalars.divide(F.col("value"), F.col("event_id") % 5)).alias("ratio"), F.round(scalars.relative_change(F.col("value") - 50, F.col("value")), 4).alias("change"))


@query("c02_families", "WITH s AS (SELECT user_id, string_agg(event_type || CASE WHEN event_id % 2 = 0 THEN ';' ELSE ' ,' END, '' ORDER BY event_id) AS x FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(x, '[;,¦]+'), lambda y: trim(y)), lambda y: y <> ''))), ';') AS families FROM s")
def c02(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "event_type")
    item = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, ";").otherwise(" ,"))
    s = e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("x")))), lambda z: z["x"]), "").alias("x"))
    return s.select("user_id", scalars.families(F.col("x")).alias("families"))


@query("c04_formatted_ids", "SELECT event_id, 'C_event' || CAST(user_id AS VARCHAR) || '_' || event_type || '_' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS name, strftime(ts, '%Y%m%dT%H%M%S') AS snapshot FROM events")
def c04(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "event_type", "ts")
    return e.select("event_id", F.format_string("C_event%d_%s_%s", "user_id", "event_type", F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")).alias("name"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("snapshot"))


@query("c08_hours_to_points", "SELECT event_id, CAST(greatest(1, round_even((event_id % 9) * 0.25 * 60 / 10, 0)) AS INTEGER) AS points FROM events")
def c08(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "event_id").select("event_id", scalars.points_column((F.col("event_id") % 9) * 0.25, 10.0).alias("points"))


@query("c11_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "event_id", "props").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("u04_common_signals", "SELECT base FROM (SELECT DISTINCT event_type AS base FROM events WHERE user_id % 2 = 0 INTERSECT SELECT DISTINCT event_type FROM events WHERE user_id % 2 = 1)")
def u04(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "user_id", "event_type")
    return e.where("user_id % 2 = 0").select(F.col("event_type").alias("base")).intersect(e.where("user_id % 2 = 1").select("event_type"))


@query("u05_set_difference", "SELECT o_custkey FROM orders GROUP BY 1 HAVING true EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def u05(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey").distinct()
    c = table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(c, "o_custkey", "left_anti")


@query("j02_one_to_one", "SELECT a.doc_id, a.quality, b.toxic, a.quality = b.toxic AS same FROM labels a JOIN labels b USING (doc_id)")
def j02(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import one_to_one

    x = table(spark, d, "labels")
    return one_to_one(x.select("doc_id", "quality"), x.select("doc_id", "toxic"), ["doc_id"]).withColumn("same", F.col("quality") == F.col("toxic"))


@query("j03_source_chain", "SELECT c_custkey, c_name, n_name, r_name, coalesce(n_orders, 0) AS n_orders, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j03(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import left_chain

    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    g = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    j = left_chain(c, [(n, ["n_nationkey"]), (g, ["n_regionkey"]), (o, ["c_custkey"])], zeros=["n_orders", "total"])
    return j.select("c_custkey", "c_name", "n_name", "r_name", "n_orders", F.round("total", 2).alias("total"))


@query("a01_robust_scale", f"WITH {LONG}, ref AS (SELECT base, stat, count(value) AS n, median(value) AS centre, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_samp(value) AS sd FROM long GROUP BY 1, 2), mad AS (SELECT l.base, l.stat, 1.4826::DOUBLE * median(abs(l.value - r.centre)) AS m FROM long l JOIN ref r USING (base, stat) GROUP BY 1, 2) SELECT base, stat, n, round(centre, 6) AS centre, round(CASE WHEN m > 1e-9 THEN m WHEN (q3 - q1) / 1.349::DOUBLE > 1e-9 THEN (q3 - q1) / 1.349::DOUBLE WHEN sd > 1e-9 THEN sd END, 6) AS scale FROM ref JOIN mad USING (base, stat)")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return stats.robust_scale(grid_long(spark, d), ["base", "stat"], "value").select("base", "stat", "n", r("centre").alias("centre"), r("scale").alias("scale"))


@query("a03_robust_variability", f"WITH {LONG}, q AS (SELECT base, stat, count(value) AS n, median(value) AS c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2), m AS (SELECT l.base, l.stat, 1.4826::DOUBLE * median(abs(l.value - q.c)) AS m FROM long l JOIN q USING (base, stat) GROUP BY 1, 2) SELECT base, stat, round(CASE WHEN n >= 10 THEN greatest(q3 - q1, m) ELSE 0 END, 6) AS variability FROM q JOIN m USING (base, stat)")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return stats.robust_variability(grid_long(spark, d), ["base", "stat"], "value").select("base", "stat", r("variability").alias("variability"))


@query("a05_period_statistics", f"WITH {HOURLY}, x AS (SELECT *, CASE WHEN t < {REFERENCE} THEN 'before' ELSE 'after' END AS period FROM h) SELECT base, period, count(*) AS n_rows, count(value) AS n_valid, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(1 - count(value) / count(*), 6) AS missing_ratio, round(regr_slope(value, pos), 6) AS slope FROM x GROUP BY 1, 2")
def a05(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("period", F.when(_ref(), "before").otherwise("after"))
    out = stats.describe(h, ["base", "period"], "value", "pos")
    return out.select("base", "period", "n_rows", "n_valid", *(r(c).alias(c) for c in ("mean", "std", "min", "max", "range", "median", "q25", "q75", "missing_ratio", "slope")))


@query("a06_period_comparison", f"WITH {HOURLY}, s AS (SELECT base, avg(value) FILTER (WHERE t < {REFERENCE}) AS a, avg(value) FILTER (WHERE t >= {REFERENCE}) AS b FROM h GROUP BY 1) SELECT base, round(a, 6) AS mean_before, round(b, 6) AS mean_after, round(b - a, 6) AS mean_diff, round(CASE WHEN abs(a) >= 1e-9 THEN (b - a) / abs(a) END, 6) AS mean_relative FROM s")
def a06(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("period", F.when(_ref(), "before").otherwise("after"))
    c = stats.compare_periods(stats.describe(h, ["base", "period"], "value"), ["base"], "period", "before", "after", ["mean"])
    return c.select("base", *(r(x).alias(x) for x in c.columns[1:]))


@query("a07_family_summary", "SELECT l_returnflag AS family, l_linestatus AS base, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(max(l_extendedprice), 2) AS max, round(median(l_discount), 6) AS median FROM lineitem GROUP BY 1, 2")
def a07(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("base"))
    return li.agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean"), F.round(F.max("l_extendedprice"), 2).alias("max"), r(F.percentile("l_discount", 0.5)).alias("median"))


@query("a08_daily_summary", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(max(value), 6) AS top, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a08(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "ts", "value", "user_id").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(F.count("*").alias("n"), r(F.max("value")).alias("top"), F.count_distinct("user_id").alias("users"))


ROWS = f"{GRID}, rows AS (SELECT t, list(avg ORDER BY base) AS a FROM grid GROUP BY 1)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("base", "avg"))), lambda x: x["avg"]).alias("a"))
    return g


@query("a09_row_fraction", f"WITH {ROWS} SELECT CAST(epoch(t) AS BIGINT) AS t, len(a) AS n, round(len(list_filter(a, lambda x: x >= 50)) / len(a), 6) AS share, round(list_max(a), 6) AS top FROM rows")
def a09(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return _rows(spark, d).select(sec("t").alias("t"), F.size(a).cast("bigint").alias("n"), r(arrays.share_at_least(a, 50)).alias("share"), r(F.array_max(a)).alias("top"))


@query("a11_top_mean", f"WITH {ROWS} SELECT CAST(epoch(t) AS BIGINT) AS t, round(list_avg(list_slice(list_reverse_sort(a), 1, 3)), 6) AS top3, round(list_aggregate(a, 'quantile_cont', 0.95), 9) AS p95, round(list_aggregate(a, 'median'), 6) AS med FROM rows")
def a11(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return _rows(spark, d).select(sec("t").alias("t"), r(arrays.top_mean(a, 3)).alias("top3"), F.round(arrays.quantile(a, 0.95), 9).alias("p95"), r(arrays.row_aggregate(a, "median")).alias("med"))


@query("a14_adaptive_threshold", f"WITH {HOURLY} SELECT base, round(greatest(40, quantile_cont(value, 0.9) FILTER (WHERE t < {REFERENCE})), 6) AS threshold FROM h GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return stats.adaptive_threshold(hourly(spark, d), ["base"], "value", 0.9, 40.0, _ref()).select("base", r("threshold").alias("threshold"))


@query("a15_consensus", "SELECT event_id, CAST(least(1 + event_id % 9, greatest(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 2 END, ceil((1 + event_id % 9) * 0.75))) AS INTEGER) AS need FROM events")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "event_id").select("event_id", scalars.consensus(1 + F.col("event_id") % 9).alias("need"))


@query("a27_signal_quality", f"WITH {LONG}, x AS (SELECT base, stat, CASE WHEN abs(value) > 5 THEN round(value, 0) END AS v FROM long), c AS (SELECT base, stat, v, count(*) AS c FROM x WHERE v IS NOT NULL GROUP BY ALL), t AS (SELECT base, stat, max(c) AS top, count(*) AS nd FROM c GROUP BY 1, 2), b AS (SELECT base, stat, count(*) AS n, count(v) AS k, stddev_pop(v) AS sd FROM x GROUP BY 1, 2) SELECT base, stat, round(1 - k / n, 6) AS missing_ratio, nd AS n_distinct, round(top / k, 6) AS top_share, round(sd, 6) AS std FROM b LEFT JOIN t USING (base, stat)")
def a27(spark: SparkSession, d: str) -> DataFrame:
    x = grid_long(spark, d).withColumn("value", F.when(F.abs("value") > 5, F.round("value", 0)))
    q = stats.signal_quality(x, ["base", "stat"], "value")
    return q.select("base", "stat", r("missing_ratio").alias("missing_ratio"), "n_distinct", r("top_share").alias("top_share"), r("std").alias("std"))


@query("a36_percentile_summary", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.025), 6) AS p2_5, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.975), 6) AS p97_5 FROM events GROUP BY 1")
def a36(spark: SparkSession, d: str) -> DataFrame:
    s = stats.summary(events(spark, d, "event_type", "value"), ["event_type"], "value")
    return s.select("event_type", "n", *(r(c).alias(c) for c in ("mean", "std", "p2_5", "q25", "median", "q75", "p97_5")))
