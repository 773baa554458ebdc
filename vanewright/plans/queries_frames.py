"""Queries of row-frame, interval, join and ranking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, scalars
from ..operators import frames, intervals, ranking
from .fixtures import HOURLY, SOURCES, SPANS, WINDOWS, events, hourly, r, sec, source_hourly, spans, table, windows

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


def _w():
    return frames.keyed(["base"], ["t"])


@query("w01_trailing_rolling", f"WITH {HOURLY} SELECT base, {T}, round(CASE WHEN count(value) OVER f >= 3 THEN avg(value) OVER f END, 6) AS mean, round(CASE WHEN count(value) OVER f >= 3 THEN max(value) OVER f END, 6) AS max, round(CASE WHEN count(value) OVER f >= 3 THEN sum(value) OVER f END, 5) AS sum, round(CASE WHEN count(value) OVER f >= 3 THEN stddev_pop(value) OVER f END, 5) AS std FROM h WINDOW f AS ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def w01(spark: SparkSession, d: str) -> DataFrame:
    f, v = frames.trailing(_w(), 6), F.col("value")
    return hourly(spark, d).select("base", sec("t").alias("t"), *(F.round(frames.rolling(v, f, h, 3), 5 if h in ("sum", "std") else 6).alias(h) for h in ("mean", "max", "sum", "std")))


@query("w02_rolling_quantile", f"WITH {HOURLY} SELECT base, {T}, round(quantile_cont(value, 0.95) OVER f, 9) AS p95, round(median(value) OVER f, 9) AS median FROM h WINDOW f AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def w02(spark: SparkSession, d: str) -> DataFrame:
    f, v = frames.trailing(_w(), 12), F.col("value")
    return hourly(spark, d).select("base", sec("t").alias("t"), F.round(frames.rolling(v, f, "quantile", 1, 0.95), 9).alias("p95"), F.round(frames.rolling(v, f, "median"), 9).alias("median"))


@query("w03_centred_rolling", f"WITH {HOURLY} SELECT base, {T}, round(avg(value) OVER (W1 ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), 6) AS even, round(avg(value) OVER (W1 ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS odd FROM h WINDOW W1 AS ({W})")
def w03(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return hourly(spark, d).select("base", sec("t").alias("t"), r(frames.rolling(v, frames.centred(_w(), 12), "mean")).alias("even"), r(frames.rolling(v, frames.centred(_w(), 5), "mean")).alias("odd"))


@query("w04_shift_and_diff", f"WITH {HOURLY} SELECT base, {T}, round(lag(value) OVER w, 6) AS prev, round(lead(value) OVER w, 6) AS next, round(value - lag(value, 6) OVER w, 6) AS delta6 FROM h WINDOW w AS ({W})")
def w04(spark: SparkSession, d: str) -> DataFrame:
    v, w = F.col("value"), _w()
    return hourly(spark, d).select("base", sec("t").alias("t"), r(F.lag(v).over(w)).alias("prev"), r(F.lead(v).over(w)).alias("next"), r(v - F.lag(v, 6).over(w)).alias("delta6"))


FLAGS = f"{HOURLY}, f AS (SELECT *, value >= 50 AS flag FROM h), i AS (SELECT *, sum(CASE WHEN flag IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY base ORDER BY t) AS island FROM (SELECT *, lag(flag) OVER (PARTITION BY base ORDER BY t) AS p FROM f))"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).withColumn("flag", F.col("value") >= 50)


@query("w05_run_length", f"WITH {FLAGS} SELECT base, {T}, CASE WHEN flag THEN row_number() OVER (PARTITION BY base, island ORDER BY t) ELSE 0 END AS run FROM i")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return frames.run_length(_flags(spark, d), "flag", ["base"], ["t"]).select("base", sec("t").alias("t"), F.col("run").cast("bigint").alias("run"))


@query("w06_true_ranges", f"WITH {FLAGS} SELECT base, CAST(floor(epoch(min(t))) AS BIGINT) AS first, CAST(floor(epoch(max(t))) AS BIGINT) AS last, count(*) AS n_points FROM i WHERE flag GROUP BY base, island HAVING count(*) >= 2")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return frames.true_ranges(_flags(spark, d), "flag", ["base"], "t", 2).select("base", sec("first").alias("first"), sec("last").alias("last"), "n_points")


@query("w07_merged_intervals", f"WITH {SPANS}, p AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE e > s), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM p) SELECT user_id, CAST(floor(epoch(min(s))) AS BIGINT) AS start, CAST(floor(epoch(max(e))) AS BIGINT) AS end, count(*) AS n FROM g GROUP BY user_id, grp")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge(spans(spark, d), ["user_id"], "start", "end", 1800).select("user_id", sec("start").alias("start"), sec("end").alias("end"), "n")


@query("w08_max_in_window", "SELECT user_id, max(n) AS max_count FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return intervals.max_in_window(events(spark, d, "user_id", "ts"), ["user_id"], "ts", 86_400)


@query("w09_clusters", "WITH f AS (SELECT user_id, ts AS s, count(*) OVER w AS n, max(ts) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 12 HOUR FOLLOWING)), g AS (SELECT * FROM f WHERE n >= 3), p AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g), k AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM p) SELECT user_id, CAST(floor(epoch(min(s))) AS BIGINT) AS start, CAST(floor(epoch(max(e))) AS BIGINT) AS end, count(*) AS n_windows FROM k GROUP BY user_id, grp")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return intervals.clusters(events(spark, d, "user_id", "ts"), ["user_id"], "ts", 43_200, 3).select("user_id", sec("start").alias("start"), sec("end").alias("end"), "n_windows")


@query("w10_bridged_gaps", f"WITH {FLAGS}, c AS (SELECT *, count(*) OVER (PARTITION BY base, island) AS n, min(island) OVER (PARTITION BY base) AS lo, max(island) OVER (PARTITION BY base) AS hi FROM i) SELECT base, {T}, flag, flag OR (island > lo AND island < hi AND n <= 2) AS bridged FROM c")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return frames.bridge(_flags(spark, d), "flag", ["base"], ["t"], 2).select("base", sec("t").alias("t"), "flag", "bridged")


@query("w11_k_of_n", f"WITH {HOURLY} SELECT base, {T}, count(*) OVER f = 6 AND sum(CAST(value >= 50 AS INTEGER)) OVER f >= 4 AS hit FROM h WINDOW f AS ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("base", sec("t").alias("t"), frames.k_of_n(F.col("value") >= 50, _w(), 6, 4).alias("hit"))


@query("w12_episodes", "WITH g AS (SELECT user_id, ts, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 > 6 * 3600 THEN 1 ELSE 0 END AS late FROM events), n AS (SELECT *, sum(late) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM g) SELECT user_id, ep AS episode, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS end, count(*) AS n FROM n GROUP BY 1, 2 HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 >= 20")
def w12(spark: SparkSession, d: str) -> DataFrame:
    e = frames.episodes(events(spark, d, "user_id", "ts"), ["user_id"], "ts", 6 * 3600, 20)
    return e.select("user_id", "episode", sec("start").alias("start"), sec("end").alias("end"), "n")


@query("w13_percentile_rank", "SELECT l_orderkey, l_linenumber, round((rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2) / count(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS pct FROM lineitem")
def w13(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return li.select("l_orderkey", "l_linenumber", r(frames.percent_rank_average(F.col("l_quantity"), ["l_suppkey"])).alias("pct"))


@query("w15_downsampling", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 6 = 0")
def w15(spark: SparkSession, d: str) -> DataFrame:
    return frames.every_kth(events(spark, d, "event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 6).select("event_id", "user_id")


@query("w16_future_max", f"WITH {HOURLY} SELECT base, {T}, round(max(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING), 6) AS m FROM h")
def w16(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("base", sec("t").alias("t"), r(frames.future_max(F.col("value"), _w(), 6)).alias("m"))


@query("w17_neighbour_median", f"WITH {HOURLY}, l AS (SELECT base, t, list(value) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, list(value) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b FROM h) SELECT base, {T}, round(list_aggregate(list_concat(coalesce(a, []), coalesce(b, [])), 'median'), 6) AS m FROM l")
def w17(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("base", sec("t").alias("t"), r(frames.neighbour_median(F.col("value"), _w(), 3)).alias("m"))


ACTIVE = f"{SOURCES}, s AS (SELECT source, t, coalesce(list_sort(list(base) FILTER (WHERE value >= 50)), []) AS a FROM sh GROUP BY 1, 2), p AS (SELECT source, t, a, coalesce(lag(a) OVER w, []) AS b, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY source ORDER BY t))"


@query("w20_active_set_jaccard", f"WITH {ACTIVE}, j AS (SELECT *, len(list_distinct(list_concat(a, b))) AS u, len(list_intersect(a, b)) AS i FROM p) SELECT source, {T}, round(CASE WHEN n = 1 OR u = 0 THEN 0 ELSE i / u END, 6) AS offline, round(CASE WHEN n = 1 OR u = 0 THEN 1 ELSE i / u END, 6) AS streaming FROM j")
def w20(spark: SparkSession, d: str) -> DataFrame:
    s = source_hourly(spark, d).groupBy("source", "t").agg(F.array_sort(F.collect_list(F.when(F.col("value") >= 50, F.col("base")))).alias("a"))
    w = frames.keyed(["source"], ["t"])
    none = F.array().cast("array<string>")
    s = s.withColumns({"b": F.coalesce(F.lag("a").over(w), none), "n": F.row_number().over(w)})
    both = [F.when(F.col("n") == 1, F.lit(e)).otherwise(arrays.jaccard(F.col("a"), F.col("b"), e)) for e in (0.0, 1.0)]
    return s.select("source", sec("t").alias("t"), r(both[0]).alias("offline"), r(both[1]).alias("streaming"))


@query("w22_segments", "SELECT event_id, user_id, CAST(sum(CASE WHEN g > 1.5 * 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 6e7 AS g FROM events)")
def w22(spark: SparkSession, d: str) -> DataFrame:
    return frames.segments(events(spark, d, "event_id", "user_id", "ts"), ["user_id"], "ts", 600).select("event_id", "user_id", "segment")


@query("w23_fixed_windows", f"WITH {HOURLY}, x AS (SELECT base, t, pos, max(t) OVER f AS last, count(*) OVER f AS n, sum(value) OVER f AS s FROM h WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) SELECT base, CAST(floor(epoch(t)) AS BIGINT) AS first, CAST(floor(epoch(last)) AS BIGINT) AS last, round(s, 5) AS total FROM x WHERE n = 24 AND (pos - 1) % 6 = 0")
def w23(spark: SparkSession, d: str) -> DataFrame:
    w = frames.fixed_windows(hourly(spark, d), ["base"], "t", ["value"], 24, 6)
    return w.select("base", sec("first").alias("first"), sec("last").alias("last"), F.round(arrays.total(F.col("rows")["value"]), 5).alias("total"))


@query("w24_rolling_slope", f"WITH {HOURLY} SELECT base, {T}, round(CASE WHEN count(value) OVER f >= 4 THEN regr_slope(value, pos) OVER f END, 5) AS slope FROM h WINDOW f AS ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def w24(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("base", sec("t").alias("t"), F.round(frames.slope(F.col("value"), F.col("pos"), frames.trailing(_w(), 8), 4), 5).alias("slope"))


ATOMS = f"{SPANS}, x AS (SELECT * FROM spans WHERE e > s), b AS (SELECT user_id, s AS t FROM x UNION SELECT user_id, e FROM x), atoms AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS z FROM b), j AS (SELECT atoms.user_id, a, z, array_to_string(list_sort(list(DISTINCT x.event_type)), ';') AS active, count(DISTINCT x.event_type) AS n_active FROM atoms JOIN x ON atoms.user_id = x.user_id AND x.s < atoms.z AND x.e > atoms.a WHERE z IS NOT NULL GROUP BY ALL), n AS (SELECT *, CASE WHEN lag(active) OVER w = active AND lag(z) OVER w = a THEN 0 ELSE 1 END AS fresh FROM j WINDOW w AS (PARTITION BY user_id ORDER BY a)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS grp FROM n)"


@query("w25_timeline_sweep", f"WITH {ATOMS} SELECT user_id, active, n_active, CAST(floor(epoch(min(a))) AS BIGINT) AS start, CAST(floor(epoch(max(z))) AS BIGINT) AS end FROM g GROUP BY user_id, grp, active, n_active")
def w25(spark: SparkSession, d: str) -> DataFrame:
    x = spans(spark, d).where(F.col("end") > F.col("start"))
    return intervals.timeline(x, ["user_id"], "start", "end", "event_type").select("user_id", "active", "n_active", sec("start").alias("start"), sec("end").alias("end"))


@query("w27_interpolation", f"WITH {HOURLY}, v AS (SELECT base, t, pos, CASE WHEN pos % 5 <> 0 AND pos > 2 THEN value END AS v FROM h), k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1 FROM v WINDOW b AS ({W} ROWS UNBOUNDED PRECEDING), a AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT base, {T}, round(coalesce(v, CASE WHEN p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, v0, v1), 6) AS filled FROM k")
def w27(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("v", F.when((F.col("pos") % 5 != 0) & (F.col("pos") > 2), F.col("value")))
    return frames.interpolate(h, "v", ["base"], ["t"], "filled").select("base", sec("t").alias("t"), r("filled").alias("filled"))


@query("r03_ewma_baseline", f"WITH RECURSIVE {HOURLY}, e(base, t, pos, mean, var) AS (SELECT base, t, pos, value, 1.0::DOUBLE FROM h WHERE pos = 1 UNION ALL SELECT h.base, h.t, h.pos, e.mean + 0.08::DOUBLE * greatest(-6 * sqrt(e.var), least(6 * sqrt(e.var), h.value - e.mean)), 0.92::DOUBLE * e.var + 0.08::DOUBLE * power(h.value - (e.mean + 0.08::DOUBLE * greatest(-6 * sqrt(e.var), least(6 * sqrt(e.var), h.value - e.mean))), 2) FROM e JOIN h ON h.base = e.base AND h.pos = e.pos + 1) SELECT base, {T}, round(mean, 5) AS mean, round(var, 4) AS var FROM e")
def r03(spark: SparkSession, d: str) -> DataFrame:
    out = frames.ewma(hourly(spark, d), "value", ["base"], ["t"], 24)
    return out.select("base", sec("t").alias("t"), F.round("ewma_mean", 5).alias("mean"), F.round("ewma_var", 4).alias("var"))


CLIPPED = f"{SPANS}, {WINDOWS}"


@query("p24_clipped_intervals", f"WITH {CLIPPED} SELECT w_id, event_id, CAST(floor(epoch(greatest(s, w_s))) AS BIGINT) AS start, CAST(floor(epoch(least(e, w_e))) AS BIGINT) AS end FROM spans JOIN win USING (user_id) WHERE least(e, w_e) > greatest(s, w_s)")
def p24(spark: SparkSession, d: str) -> DataFrame:
    j = spans(spark, d).join(windows(spark, d), "user_id")
    return intervals.clip(j, "start", "end", "w_start", "w_end").select("w_id", "event_id", sec("start").alias("start"), sec("end").alias("end"))


@query("p26_interval_relations", f"WITH {CLIPPED} SELECT w_id, event_id, CASE WHEN e >= w_s AND s <= w_e THEN 'overlap' WHEN e < w_s AND e >= w_s - INTERVAL 12 HOUR THEN 'pre_window' WHEN s > w_e AND s <= w_e + INTERVAL 12 HOUR THEN 'post_window' ELSE 'unrelated' END AS relation FROM spans JOIN win USING (user_id)")
def p26(spark: SparkSession, d: str) -> DataFrame:
    j = spans(spark, d).join(windows(spark, d), "user_id")
    return j.select("w_id", "event_id", scalars.interval_relation(F.col("start"), F.col("end"), F.col("w_start"), F.col("w_end"), 12).alias("relation"))


@query("p27_nearest_interval", f"WITH {CLIPPED} SELECT event_id, round(min(CASE WHEN w_s IS NOT NULL THEN greatest(0, (epoch_us(w_s) - epoch_us(e)) / 3.6e9, (epoch_us(s) - epoch_us(w_e)) / 3.6e9) END), 5) AS nearest_hours FROM spans LEFT JOIN win USING (user_id) GROUP BY 1")
def p27(spark: SparkSession, d: str) -> DataFrame:
    n = intervals.nearest_hours(spans(spark, d), windows(spark, d), ["user_id"], ("start", "end"), ("w_start", "w_end"), ["event_id"])
    return n.select("event_id", F.round("nearest_hours", 5).alias("nearest_hours"))


@query("a16_union_hours", f"WITH {SPANS}, p AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE e > s), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM p), m AS (SELECT user_id, (epoch_us(max(e)) - epoch_us(min(s))) / 3.6e9 AS h, count(*) AS n FROM g GROUP BY user_id, grp) SELECT user_id, CAST(sum(n) AS BIGINT) AS n_intervals, count(*) AS n_merged, round(max(h), 5) AS max_hours, round(sum(h), 5) AS total_hours FROM m GROUP BY 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    u = intervals.union_hours(spans(spark, d), ["user_id"], "start", "end")
    return u.select("user_id", "n_intervals", "n_merged", F.round("max_hours", 5).alias("max_hours"), F.round("total_hours", 5).alias("total_hours"))


@query("j06_overlap_join", f"WITH {CLIPPED} SELECT w_id, count(event_id) AS n, count(event_id) FILTER (WHERE event_type = 'error') AS n_error FROM win LEFT JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e GROUP BY 1")
def j06(spark: SparkSession, d: str) -> DataFrame:
    j = intervals.overlap_join(windows(spark, d), spans(spark, d), ["user_id"], ("w_start", "w_end"), ("start", "end"), "left")
    return j.groupBy("w_id").agg(F.count("event_id").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"))


@query("j06_bucketed_overlap", f"WITH {CLIPPED} SELECT w_id, event_id FROM win JOIN spans ON win.user_id = spans.user_id AND e >= w_s AND s <= w_e")
def j06b(spark: SparkSession, d: str) -> DataFrame:
    return intervals.bucketed_overlap(windows(spark, d), spans(spark, d), ["user_id"], ("w_start", "w_end"), ("start", "end"), 6 * 3600).select("w_id", "event_id")


@query("j07_containment_parent", f"WITH {CLIPPED}, x AS (SELECT event_id, user_id, s, e FROM spans), j AS (SELECT x.event_id, w_id, row_number() OVER (PARTITION BY x.event_id ORDER BY w_label NULLS LAST, w_s NULLS LAST) AS n FROM x LEFT JOIN win ON x.user_id = win.user_id AND s >= w_s AND e <= w_e) SELECT event_id, w_id AS parent FROM j WHERE n = 1")
def j07(spark: SparkSession, d: str) -> DataFrame:
    p = windows(spark, d).withColumnsRenamed({"w_start": "p_start", "w_end": "p_end"})
    c = intervals.contained_parent(spans(spark, d), p, ["user_id"], "event_id", ["w_label", "p_start"])
    return c.select("event_id", F.col("w_id").alias("parent"))


@query("j08_buffered_anti_join", f"WITH {CLIPPED} SELECT event_id FROM spans WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.user_id = spans.user_id AND e >= w_s - INTERVAL 6 HOUR AND s <= w_e + INTERVAL 6 HOUR) AND EXISTS (SELECT 1 FROM win WHERE win.user_id = spans.user_id)")
def j08(spark: SparkSession, d: str) -> DataFrame:
    b = F.expr("interval 6 hours")
    w = windows(spark, d).select("user_id", (F.col("w_start") - b).alias("a"), (F.col("w_end") + b).alias("z"))
    out = intervals.overlap_join(spans(spark, d), w, ["user_id"], ("start", "end"), ("a", "z"), "left_anti")
    return out.join(w.select("user_id").distinct(), "user_id", "left_semi").select("event_id")


@query("j09_point_semi_join", f"WITH {CLIPPED} SELECT event_id FROM events WHERE EXISTS (SELECT 1 FROM win WHERE win.user_id = events.user_id AND w_label = 1 AND ts BETWEEN w_s AND w_e)")
def j09(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "ts").withColumn("ts2", F.col("ts"))
    return intervals.overlap_join(e, windows(spark, d).where("w_label = 1"), ["user_id"], ("ts", "ts2"), ("w_start", "w_end"), "left_semi").select("event_id")


@query("j13_previous_row", "SELECT event_id, lag(event_type) OVER w AS prev_type, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 6e7, 9) AS gap_minutes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def j13(spark: SparkSession, d: str) -> DataFrame:
    w = frames.keyed(["user_id"], ["ts", "event_id"])
    e = events(spark, d, "event_id", "user_id", "event_type", "ts")
    return e.select("event_id", F.lag("event_type").over(w).alias("prev_type"), F.round((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 6e7, 9).alias("gap_minutes"))


@query("j11_as_of", "SELECT o.o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 43200 AS INTEGER)) AS ts FROM orders) o ASOF LEFT JOIN events e ON o.user_id = e.user_id AND o.ts >= e.ts")
def j11(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 43200).cast("int"))).alias("ts"))
    return intervals.as_of(o, events(spark, d, "event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"]).select("o_orderkey", "event_id")


@query("t01_top_candidates", "SELECT event_id, event_type, round(value, 6) AS value, row_number() OVER (ORDER BY value DESC, ts, event_id) AS rank FROM events QUALIFY rank <= 30")
def t01(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "event_type", "value", "ts")
    return ranking.top_n(e, [], [F.desc("value"), "ts", "event_id"], 30).select("event_id", "event_type", r("value").alias("value"), F.col("rank").cast("bigint").alias("rank"))


@query("t02_top_contributors", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 20")
def t02(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "value")
    return ranking.top_n(e, ["user_id"], [F.desc("value"), "event_id"], 20).select("user_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("t05_primary_detector", "WITH s AS (SELECT user_id, list(DISTINCT event_type) AS a FROM events GROUP BY 1) SELECT user_id, coalesce(list_filter(['error', 'signup', 'purchase'], lambda x: list_contains(a, x))[1], list_sort(a)[1]) AS main FROM s")
def t05(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d, "event_id", "user_id", "event_type").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    return s.select("user_id", ranking.by_priority(F.col("a"), ["error", "signup", "purchase"]).alias("main"))


@query("t06_spaced_selection")
def t06(spark: SparkSession, d: str) -> DataFrame:
    return ranking.spaced(events(spark, d, "event_id", "user_id", "value", "ts"), ["user_id"], "value", "ts", "event_id", 24, 5)


EDGES = "e AS (SELECT l_suppkey % 20 AS i, l_partkey % 20 AS j, CAST(count(*) AS DOUBLE) AS weight FROM lineitem WHERE l_suppkey % 20 <> l_partkey % 20 GROUP BY 1, 2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY weight DESC, j) AS n FROM e) WHERE n <= 4), s AS (SELECT i, j, max(weight) AS weight FROM (SELECT i, j, weight FROM k UNION ALL SELECT j, i, weight FROM k) GROUP BY 1, 2)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 20).alias("j")).where("i <> j")
    return ranking.sparsify(li.groupBy("i", "j").agg(F.count("*").cast("double").alias("weight")), 4, 0.0)


@query("t09_sparse_graph", f"WITH {EDGES} SELECT i, j, weight FROM s")
def t09(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query("a41_normalised_graph", f"WITH {EDGES}, f AS (SELECT i, j, weight FROM s UNION ALL SELECT DISTINCT i, i, 1.0 FROM s), d AS (SELECT i, sum(weight) AS d FROM f GROUP BY 1) SELECT f.i, f.j, round(weight / sqrt(a.d * b.d), 6) AS weight FROM f JOIN d a ON f.i = a.i JOIN d b ON f.j = b.i")
def a41(spark: SparkSession, d: str) -> DataFrame:
    return ranking.normalised(_edges(spark, d)).select("i", "j", r("weight").alias("weight"))


@query("a32_exploded_families", "WITH s AS (SELECT user_id, event_type || ';' || CASE WHEN value > 50 THEN 'high' ELSE '' END AS f FROM events), x AS (SELECT user_id, unnest(list_distinct(list_filter(string_split(f, ';'), lambda y: y <> ''))) AS family FROM s) SELECT family, count(*) AS n, count(DISTINCT user_id) AS users FROM x GROUP BY 1")
def a32(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "user_id", "event_type", "value")
    f = scalars.families(F.concat_ws(";", "event_type", F.when(F.col("value") > 50, "high").otherwise("")))
    x = e.select("user_id", F.explode(F.split(f, ";")).alias("family"))
    return x.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("r24_event_time_windows", "SELECT CAST(floor(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'))) AS BIGINT) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def r24(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "ts", "event_type", "value")
    g = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))
    return g.select(sec(F.col("w.start")).alias("start"), "event_type", "n", "mean")


@query("r24_sliding_windows", "WITH b AS (SELECT unnest(generate_series(0, 2)) AS k), w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 2 HOUR AS s, event_type, value FROM events, b) SELECT CAST(floor(epoch(s)) AS BIGINT) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2")
def r24_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of six hours, every two hours."""
    e = events(spark, d, "ts", "event_type", "value").withWatermark("ts", "1 hour")
    g = e.groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))
    return g.select(sec(F.col("w.start")).alias("start"), "event_type", "n", "mean")


@query("r24_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 4 * 3600000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 4 HOUR)) AS BIGINT) AS end, count(*) AS n FROM s GROUP BY user_id, k")
def r24_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: rows less than four hours apart."""
    e = events(spark, d, "user_id", "ts").withWatermark("ts", "1 hour")
    g = e.groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", sec(F.col("w.start")).alias("start"), sec(F.col("w.end")).alias("end"), "n")
