"""Queries of rules with fixed limits and lists: names, subsystems, confidence, decisions, patterns, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import decisions, detectors, frames
from ..sources import readers
from .fixtures import BASE_Z, HOURLY, LONG, REFERENCE, SPANS, WINDOWS, events, grid_long, hourly, predictions, r, sec, spans, table, windows
from .fixtures import PREDICTIONS

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


def _ref() -> Column:
    return F.col("t") < F.lit("2024-01-11 00:00:00").cast("timestamp")


def _pick(names: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), i.cast("int"))


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


@query("p01_column_aliases", "SELECT event_id AS id, user_id AS asset, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events")
def p01(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "user_id", "ts").withColumnsRenamed({"event_id": "ID", "user_id": "Asset-ID", "ts": " Time Stamp"})
    n = readers.require(e, ["id", "asset", "time"])
    return e.select(F.col(n["id"]).alias("id"), F.col(n["asset"]).alias("asset"), sec(F.col(f"`{n['time']}`")).alias("t"))


@query("p05_safe_casts", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN -1.0 WHEN 2 THEN -1.0 WHEN 3 THEN event_id + 0.5 ELSE event_id END AS as_float, CASE WHEN event_id % 5 >= 3 THEN event_id ELSE 7 END AS as_int FROM events")
def p05(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "NaN").when(i % 5 == 1, "Infinity").when(i % 5 == 3, F.concat(i.cast("string"), F.lit(".5"))).when(i % 5 == 4, i.cast("string"))
    return events(spark, d, "event_id").select("event_id", scalars.number(text, -1.0).alias("as_float"), F.floor(scalars.number(text, 7.0)).alias("as_int"))


WORDS = ("Normal", "healthy ", "FAULT", "1", "no", "Maintenance", "abnormal", " Derated")


@query("p07_labels_as_text", f"SELECT event_id, CASE WHEN x IN ('anomaly', 'anomalous', 'fault', 'faulty', 'abnormal', '1', 'true', 'yes') THEN 'anomaly' WHEN x IN ('normal', 'healthy', '0', 'false', 'no') THEN 'normal' ELSE x END AS label FROM (SELECT event_id, lower(trim({_list(WORDS)}[1 + event_id % 8])) AS x FROM events)")
def p07(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "event_id").select("event_id", scalars.label_text(_pick(WORDS, F.col("event_id") % 8)).alias("label"))


NAMES = ("sensor_1_avg", "Wind Speed_std", "event_id", "Fault code_avg", "power_30_max", "Status_type_id", "time_stamp", "Oil-Temp_avg", "is_anomaly", "prediction_avg")


@query("p11_admissible_features", f"WITH n AS (SELECT DISTINCT {_list(NAMES)}[1 + event_id % 10] AS name FROM events), p AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS x FROM n), a AS (SELECT *, NOT x IN ('time_stamp', 'timestamp', 'time', 'datetime', 'date_time', 'asset_id', 'event_id', 'id', 'train_test', 'status_type_id', 'label', 'target', 'event_label', 'event_start', 'event_end', 'description') AND NOT regexp_matches(x, 'fault|failure|anomaly|label|target|prediction|event_') AS ok FROM p) SELECT name, ok AS in_all, ok AND ends_with(x, '_avg') AS in_avg, ok AND (ends_with(x, '_avg') OR ends_with(x, '_std')) AS in_avg_std FROM a")
def p11(spark: SparkSession, d: str) -> DataFrame:
    n = events(spark, d, "event_id").select(_pick(NAMES, F.col("event_id") % 10).alias("name")).distinct()
    return n.select("name", *(scalars.admissible(F.col("name"), m).alias(f"in_{m}") for m in ("all", "avg", "avg_std")))


@query("p13_signal_groups", "WITH n AS (SELECT DISTINCT ['reactive_power_','power_','wind_speed_','sensor_','x_'][1 + event_id % 5] || CAST(event_id % 30 AS VARCHAR) || ['_avg','_max','_min','_std',''][1 + (event_id // 5) % 5] AS name FROM events) SELECT regexp_replace(name, '_(avg|max|min|std)$', '') AS base, array_to_string(list_sort(list(regexp_extract(name, '_(avg|max|min|std)$', 1)) FILTER (WHERE regexp_extract(name, '_(avg|max|min|std)$', 1) <> '')), ',') AS stats FROM n GROUP BY 1 HAVING count(*) FILTER (WHERE regexp_extract(name, '_(avg|max|min|std)$', 1) <> '') > 0")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("base", F.array_join("stats", ",").alias("stats"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """(base, stats): the statistics that each base signal has a column of."""
    i = F.col("event_id")
    name = F.concat(_pick(("reactive_power_", "power_", "wind_speed_", "sensor_", "x_"), i % 5), (i % 30).cast("string"), _pick(("_avg", "_max", "_min", "_std", ""), F.floor(i / 5) % 5))
    n = events(spark, d, "event_id").select(name.alias("name")).distinct().select(scalars.base_signal(F.col("name")).alias("base"), scalars.statistic(F.col("name")).alias("stat"))
    return n.where("stat <> ''").groupBy("base").agg(F.array_sort(F.collect_set("stat")).alias("stats"))


POWERS = ("power_2", "power_6", "active_power_total", "reactive_power_1", "main_pwr", "power_factor", "rated_power", "sensor_4", "gen_power", "electrical_power_limit")


@query("p14_power_signals", f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 3 = 0 THEN x IN ('power_2', 'power_5', 'power_6', 'power_17') ELSE regexp_matches(x, '(^|_)power($|_)|active_power|generator_power|electrical_power|(^|_)pwr($|_)') AND NOT regexp_matches(x, 'reactive|power_factor|setpoint|limit|rated') END AS power FROM (SELECT event_id, {_list(POWERS)}[1 + event_id % 10] AS x FROM events)")
def p14(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, d, "event_id").select("event_id", scalars.power_signal(_pick(POWERS, i % 10), F.when(i % 3 == 0, "C").otherwise("A"), i % 4 != 0).alias("power"))


DESCRIPTIONS = (
    "DC-link voltage", "Line voltage L1", "Stator current", "Inverter status", "Battery voltage", "Blade 2 position", "Yaw speed", "Gear oil level", "Gear bearing temperature", "Rotor temperature",
    "Power module temperature", "Nacelle temperature", "Water pump pressure", "Brake pad", "Main bearing", "Wind speed", " ", "Transformer voltage of the converter", "Coolant of the gearbox oil", "Hydraulic yaw drive",
)
GROUPS_SQL = """(VALUES (1, 'dc_link_voltage', 'dc link'), (1, 'dc_link_voltage', 'direct current link'), (1, 'dc_link_voltage', 'dc-link'), (2, 'grid_voltage', 'grid voltage'), (2, 'grid_voltage', 'line voltage'), (2, 'grid_voltage', 'mains voltage'), (2, 'grid_voltage', 'phase voltage'), (2, 'grid_voltage', 'transformer voltage'),
(3, 'generator_current', 'generator current'), (3, 'generator_current', 'stator current'), (3, 'generator_current', 'phase current'), (4, 'converter_electrical', 'converter'), (4, 'converter_electrical', 'inverter'), (4, 'converter_electrical', 'rectifier'), (5, 'auxiliary_supply', 'supply voltage'), (5, 'auxiliary_supply', 'battery voltage'), (5, 'auxiliary_supply', 'control voltage'), (5, 'auxiliary_supply', 'cabinet voltage'), (5, 'auxiliary_supply', 'auxiliary voltage'),
(6, 'pitch_axis', 'pitch'), (6, 'pitch_axis', 'blade'), (6, 'pitch_axis', 'axis 1'), (6, 'pitch_axis', 'axis 2'), (6, 'pitch_axis', 'axis 3'), (7, 'yaw', 'yaw'), (8, 'gearbox_oil', 'gear oil'), (8, 'gearbox_oil', 'gearbox oil'), (8, 'gearbox_oil', 'oil pump'), (8, 'gearbox_oil', 'oil pressure'), (8, 'gearbox_oil', 'oil level'), (8, 'gearbox_oil', 'lubric'),
(9, 'gearbox_thermal', 'gearbox temperature'), (9, 'gearbox_thermal', 'gear bearing temperature'), (9, 'gearbox_thermal', 'gearbox bearing temperature'), (10, 'generator_thermal', 'generator temperature'), (10, 'generator_thermal', 'generator bearing temperature'), (10, 'generator_thermal', 'stator temperature'), (10, 'generator_thermal', 'rotor temperature'),
(11, 'converter_thermal', 'converter temperature'), (11, 'converter_thermal', 'inverter temperature'), (11, 'converter_thermal', 'power module temperature'), (12, 'cabinet_thermal', 'cabinet temperature'), (12, 'cabinet_thermal', 'nacelle temperature'), (12, 'cabinet_thermal', 'hub temperature'), (12, 'cabinet_thermal', 'ambient cabinet'),
(13, 'cooling_system', 'cooling'), (13, 'cooling_system', 'coolant'), (13, 'cooling_system', 'cooler'), (13, 'cooling_system', 'heat exchanger'), (13, 'cooling_system', 'water pump'), (14, 'hydraulic_brake', 'hydraulic'), (14, 'hydraulic_brake', 'brake'), (14, 'hydraulic_brake', 'accumulator pressure'),
(15, 'vibration_mechanical', 'vibration'), (15, 'vibration_mechanical', 'acceleration'), (15, 'vibration_mechanical', 'shaft'), (15, 'vibration_mechanical', 'coupling'), (15, 'vibration_mechanical', 'main bearing')) g(n, name, part)"""


@query("p15_subsystems", f"WITH x AS (SELECT p_partkey, lower({_list(DESCRIPTIONS)}[1 + p_partkey % 20]) AS x, p_partkey % 7 = 0 AS angle, p_partkey % 11 = 0 AS counter FROM part), m AS (SELECT p_partkey, arg_min(name, n) AS subsystem FROM x JOIN {GROUPS_SQL} ON contains(x.x, g.part) WHERE NOT angle AND NOT counter GROUP BY 1) SELECT p_partkey, subsystem FROM x LEFT JOIN m USING (p_partkey)")
def p15(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", scalars.subsystem(_pick(DESCRIPTIONS, k % 20), k % 7 == 0, k % 11 == 0).alias("subsystem"))


@query("p18_period_labels", f"WITH {SPANS} SELECT e.event_id, CASE WHEN s.s IS NULL THEN 'unknown' WHEN e.ts < s.s THEN 'before' WHEN e.ts <= s.e THEN 'event' ELSE 'after' END AS period FROM events e LEFT JOIN spans s ON s.event_id = e.event_id + 5 AND s.event_id % 2 = 0")
def p18(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d).where("event_id % 2 = 0").select((F.col("event_id") - 5).alias("event_id"), "start", "end")
    return events(spark, d, "event_id", "ts").join(s, "event_id", "left").select("event_id", scalars.period(F.col("ts"), F.col("start"), F.col("end")).alias("period"))


@query("p22_source_metadata", "SELECT o_orderkey, c_custkey AS source, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 > 0")
def p22(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", scalars.identifier(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("_id"))
    c = table(spark, d, "customer").where("c_custkey % 3 > 0").select(scalars.identifier(F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).alias("_id"), F.col("c_custkey").alias("source"), F.col("c_name").alias("name"))
    return o.join(c, "_id").drop("_id")


@query("p25_best_overlap", f"WITH {SPANS}, {WINDOWS}, j AS (SELECT event_id, w_id, greatest(0, (epoch_us(least(e, w_e)) - epoch_us(greatest(s, w_s))) / 3.6e9) AS h, w_s FROM spans JOIN win USING (user_id)), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(h, 6) DESC, w_s, w_id) AS n FROM j) SELECT event_id, w_id, round(h, 5) AS hours FROM k WHERE n = 1 AND h > 0")
def p25(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ranking import top_n

    j = spans(spark, d).join(windows(spark, d), "user_id")
    j = j.withColumn("h", scalars.overlap_hours(F.col("start"), F.col("end"), F.col("w_start"), F.col("w_end")))
    return top_n(j, ["event_id"], [F.desc(r("h")), "w_start", "w_id"], 1).where("h > 0").select("event_id", "w_id", F.round("h", 5).alias("hours"))


@query("p30_typed_texts", "SELECT event_id, CAST(event_id % 5 + 1 AS DOUBLE) + CAST(event_id % 7 + 1 AS DOUBLE) + 0.5::DOUBLE AS hours, 3 AS n FROM events")
def p30(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    text = F.concat_ws(" , ", (i % 5 + 1).cast("string"), F.concat((i % 7 + 1).cast("string"), F.lit(".0")), F.lit("0.5"), F.lit("x"), F.lit("-2"))
    h = scalars.hours_list(text)
    return events(spark, d, "event_id").select("event_id", F.aggregate(h, F.lit(0.0), lambda a, x: a + x).alias("hours"), F.size(h).alias("n"))


@query("p31_single_precision", "SELECT event_id, round(CAST(CAST(CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS FLOAT) AS DOUBLE), 4) AS v FROM events")
def p31(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.frames import single_precision

    e = events(spark, d, "event_id", "value").withColumn("value", F.when(F.col("event_id") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    return single_precision(e, ["value"]).select("event_id", F.round(F.col("value").cast("double"), 4).alias("v"))


@query("p32_group_sort_time", f"WITH {WINDOWS}, m AS (SELECT user_id, min(w_s) AS m FROM win GROUP BY 1), g AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1) SELECT user_id, CAST(floor(epoch(coalesce(m, t))) AS BIGINT) AS t FROM g LEFT JOIN m USING (user_id)")
def p32(spark: SparkSession, d: str) -> DataFrame:
    m = windows(spark, d).groupBy("user_id").agg(F.min("w_start").alias("m"))
    g = events(spark, d, "user_id", "ts").groupBy("user_id").agg(F.min("ts").alias("t"))
    return g.join(m, "user_id", "left").select("user_id", sec(F.coalesce("m", "t")).alias("t"))


# event features with every outcome among them, from the event's number
FEATURES = {"short_count": "event_id % 11", "max_short_2h": "event_id % 6", "max_short_24h": "event_id % 8", "strong_clusters": "floor(event_id / 3) % 4", "persistent_longest": "greatest(0, event_id % 25 - 18) / 2.0", "persistent_total": "greatest(0, event_id % 23 - 17) * 1.0", "persistent_segments": "greatest(0, event_id % 25 - 18)", "localized_longest": "greatest(0, event_id % 19 - 16) * 0.6", "localized_segments": "greatest(0, event_id % 19 - 16)", "coverage": "greatest(0, event_id % 31 - 24) / 100.0", "n_families": "event_id % 3", "rejected_longest": "(event_id % 13) / 5.0"}
FEATURES_SQL = ", ".join(f"{v.replace('floor(event_id / 3)', '(event_id // 3)')} AS {k}" for k, v in FEATURES.items())


@query("d12_event_decision", f"""WITH f AS (SELECT event_id, event_id % 17 = 0 AS censored, {FEATURES_SQL} FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_id % 17 = 0, 0 AS short_count, event_id % 6, event_id % 8, event_id % 2 - 1, 0, 0, 0, 0, 0, 0, 0, 0 FROM events WHERE event_id % 2 = 1),
b AS (SELECT *, persistent_longest >= 2 OR persistent_total >= 4 AS a, localized_longest >= 1 AS l, max_short_2h >= 4 OR max_short_24h >= 6 OR (strong_clusters >= 2 AND short_count >= 8) AS s, coverage >= 0.03 AND n_families >= 2 AND (persistent_segments > 0 OR localized_segments > 0) AS m,
max_short_2h BETWEEN 2 AND 3 OR max_short_24h BETWEEN 3 AND 5 AS d, strong_clusters = 1 AS o, coverage >= 0.005 AND coverage < 0.03 AS k, rejected_longest >= 2 AS j FROM f),
n AS (SELECT *, CAST(a AS INTEGER) + CAST(l AS INTEGER) + CAST(s AS INTEGER) AS p, concat_ws(';', CASE WHEN a THEN 'persistent_system_state' END, CASE WHEN l THEN 'localized_persistent_state' END, CASE WHEN s THEN 'repeated_short_standstill' END) AS names FROM b)
SELECT event_id, CASE WHEN p > 0 OR m THEN 'anomaly' ELSE 'normal' END AS decision, CASE WHEN p >= 2 OR m THEN 'anomaly_multi_detector' WHEN p = 1 THEN 'anomaly_' || names WHEN d OR o OR k OR j OR censored THEN 'review_required' WHEN short_count > 0 THEN 'normal_with_transients' ELSE 'normal' END AS status,
CASE WHEN p > 0 OR m THEN 3 WHEN d OR o OR k OR j OR censored THEN 2 WHEN short_count > 0 THEN 1 ELSE 0 END AS level, CASE WHEN p > 0 OR m THEN censored ELSE d OR o OR k OR j OR censored END AS manual_review, CASE WHEN p > 0 OR m THEN names ELSE '' END AS paths,
CASE WHEN p > 0 OR m THEN concat_ws(';', CASE WHEN a THEN 'persistent' END, CASE WHEN l THEN 'localized' END, CASE WHEN s THEN 'repeated_short' END, CASE WHEN m THEN 'coverage' END, CASE WHEN censored THEN 'censored' END) ELSE concat_ws(';', CASE WHEN d THEN 'medium_density' END, CASE WHEN o THEN 'one_cluster' END, CASE WHEN k THEN 'medium_coverage' END, CASE WHEN j THEN 'rejected_localized' END, CASE WHEN censored THEN 'censored' END) END AS reasons FROM n""")
def d12(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    odd = {**dict.fromkeys(FEATURES, "0"), "max_short_2h": "event_id % 6", "max_short_24h": "event_id % 8"}
    e = events(spark, d, "event_id").select("event_id", (F.col("event_id") % 17 == 0).alias("censored"), *(F.when(even, F.expr(v)).otherwise(F.expr(odd[k])).alias(k) for k, v in FEATURES.items()))
    return decisions.event_decision(e).select("event_id", "decision", "status", "level", "manual_review", "paths", "reasons")


KINDS = ("short_standstill", "intermittent_cluster", "localized_persistent_subsystem_state", "persistent_system_state")


@query("d07_confidence", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'Very High' ELSE 'High' END WHEN 1 THEN CASE WHEN event_id % 9 >= 4 THEN 'High' WHEN event_id % 9 >= 3 THEN 'Medium-High' ELSE 'Medium' END WHEN 2 THEN CASE WHEN value >= 60 AND event_id % 9 >= 5 AND event_id % 14 >= 12 THEN 'High' WHEN value >= 40 THEN 'Medium-High' ELSE 'Medium' END ELSE CASE WHEN value / 100 >= 0.6 THEN 'High' WHEN value / 100 >= 0.48 THEN 'Medium-High' ELSE 'Medium' END END AS band FROM events")
def d07(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    local = i % 4 == 2
    # overlaps are in per cent, as the SQL has them
    band = detectors.confidence(_pick(KINDS, i % 4), i % 3 == 0, i % 9, F.lit(2), v, i % 9, i % 14, v / 100, F.when(local, 4.0).otherwise(0.4), F.lit(8.0), 40.0, 60.0)
    return events(spark, d, "event_id", "value").select("event_id", band.alias("band"))


LOCAL = detectors.DetectorConfig(active_level=1.0, localized_least=2, coverage_points=6, coverage_least=0.5, overlap_least=0.3, quantile=0.6, strength_floor=0.5)


@query("d04_localized_detector", f"""WITH {BASE_Z}, c AS (SELECT t, base, z, z >= 1.0 AS a, CASE WHEN count(*) OVER w >= 3 THEN avg(CAST(z >= 1.0 AS DOUBLE)) OVER w END AS cv FROM z WINDOW w AS (PARTITION BY base ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)),
g AS (SELECT t, count(*) FILTER (WHERE a) AS n_active, count(*) FILTER (WHERE cv >= 0.5) AS n_stable, coalesce(list(base) FILTER (WHERE a), []) AS st, list_avg(list_slice(list_reverse_sort(list(z)), 1, 2)) AS str FROM c GROUP BY 1),
o AS (SELECT *, lag(st) OVER (ORDER BY t) AS b FROM g),
j AS (SELECT *, CASE WHEN b IS NULL OR len(list_distinct(list_concat(st, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(st, b)) / len(list_distinct(list_concat(st, b))) END AS ov FROM o),
m AS (SELECT *, avg(ov) OVER w AS so, avg(str) OVER w AS ss FROM j WINDOW w AS (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
rs AS (SELECT avg(str) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM j WHERE t < {REFERENCE}),
th AS (SELECT greatest(2, ceil((SELECT quantile_cont(n_stable, 0.6) FROM m WHERE t < {REFERENCE}))) AS ct, greatest(0.5, (SELECT quantile_cont(x, 0.6) FROM rs)) AS st0)
SELECT {T}, n_active, n_stable, round(so, 6) AS overlap, round(ss, 6) AS strength, CAST(ct AS INTEGER) AS core_threshold, round(st0, 6) AS strength_threshold, n_active >= 2 AND n_stable >= ct AND so >= 0.3 - 1e-12 AND ss >= st0 - 1e-12 AS raw, n_active >= 2 AND n_stable >= ct AND so >= 0.3 - 1e-12 AND ss >= st0 - 1e-12 AND t >= {REFERENCE} AS localized FROM m, th""")
def d04(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    z = detectors.base_z(grid_long(spark, d).withColumn("fleet", F.lit("all")), _ref(), ["fleet"], "t")
    x = detectors.localized(z, ["fleet"], "t", _ref(), ~_ref(), replace(LOCAL, overlap_least=0.3 - 1e-12))
    return x.select(sec("t").alias("t"), "n_active", "n_stable", *(r(c).alias(c) for c in ("overlap", "strength")), "core_threshold", r("strength_threshold").alias("strength_threshold"), "raw", "localized")


@query("d16_stream_patterns", f"""WITH {SPANS}, {WINDOWS}, j AS (SELECT w_id, w_s, w_e, s, e FROM win LEFT JOIN spans ON win.user_id = spans.user_id AND event_type <> 'view' AND e >= w_s - INTERVAL 24 HOUR AND s <= w_e + INTERVAL 24 HOUR),
f AS (SELECT w_id, count(*) FILTER (WHERE e >= w_s AND s <= w_e) AS n, count(*) FILTER (WHERE e < w_s) AS b, count(*) FILTER (WHERE s > w_e) AS a, coalesce(max((epoch_us(least(e, w_e)) - epoch_us(greatest(s, w_s))) / 3.6e9) FILTER (WHERE e >= w_s AND s <= w_e), 0) AS h, min((epoch_us(s) - epoch_us(w_s)) / 3.6e9) FILTER (WHERE e >= w_s AND s <= w_e) AS d FROM j GROUP BY 1)
SELECT w_id, CASE WHEN h >= 2 AND d <= 6 AND n >= 3 THEN 'operational_fragmented' WHEN h >= 2 AND d <= 6 THEN 'operational_concentrated' WHEN h >= 2 THEN 'meaningful_late_or_untimely' WHEN n > 0 THEN 'weak_overlap_only' WHEN b > 0 THEN 'pre_window_alert_only' WHEN a > 0 THEN 'post_window_alert_only' ELSE 'no_qualifying_episode' END AS pattern FROM f""")
def d16(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.intervals import overlap_join

    day = F.expr("interval 24 hours")
    w = windows(spark, d).withColumns({"a": F.col("w_start") - day, "z": F.col("w_end") + day})
    j = overlap_join(w, spans(spark, d).where("event_type <> 'view'"), ["user_id"], ("a", "z"), ("start", "end"), "left")
    hit = (F.col("end") >= F.col("w_start")) & (F.col("start") <= F.col("w_end"))
    hours = scalars.hours_between(F.greatest("start", "w_start"), F.least("end", "w_end"))
    f = j.groupBy("w_id").agg(F.count_if(hit).alias("n"), F.count_if(F.col("end") < F.col("w_start")).alias("b"), F.count_if(F.col("start") > F.col("w_end")).alias("p"), F.coalesce(F.max(F.when(hit, hours)), F.lit(0.0)).alias("h"), F.min(F.when(hit, scalars.hours_between(F.col("w_start"), F.col("start")))).alias("delay"))
    meaningful = F.col("h") >= 2
    return f.select("w_id", decisions.stream_pattern(F.col("n"), F.coalesce(meaningful & (F.col("delay") <= 6), F.lit(False)), meaningful, F.col("b"), F.col("p")).alias("pattern"))


@query("r07_data_quality", f"""WITH {HOURLY}, x AS (SELECT base, t, pos, (pos * 7) % 10 / 10.0 AS miss, (pos * 3) % 20 / 20.0 AS frozen, CASE WHEN pos % 40 = 0 THEN 45.0 ELSE 10.0 END AS gap, pos % 5 = 0 AS stopped FROM (SELECT base, t, pos // 4 AS pos FROM h)),
c AS (SELECT *, miss >= 0.10 AS mc, frozen >= 0.70 AND NOT stopped AS fc, gap > 15 AS gc FROM x),
i AS (SELECT *, sum(CASE WHEN mc THEN 0 ELSE 1 END) OVER ({W}) AS mi, sum(CASE WHEN fc THEN 0 ELSE 1 END) OVER ({W}) AS fi FROM c),
n AS (SELECT *, CASE WHEN mc THEN count(*) FILTER (WHERE mc) OVER (PARTITION BY base, mi ORDER BY t) ELSE 0 END AS mr, CASE WHEN fc THEN count(*) FILTER (WHERE fc) OVER (PARTITION BY base, fi ORDER BY t) ELSE 0 END AS fr FROM i)
SELECT base, {T}, mc OR fc OR gc AS candidate, (mr >= 3 AND miss >= 0.20) OR (fr >= 3 AND frozen >= 0.85) OR gap >= 30 AS confirmed FROM n""")
def r07(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.quality import data_quality

    p = F.floor(F.col("pos") / 4)
    h = hourly(spark, d).withColumns({"missing": (p * 7) % 10 / 10.0, "frozen": (p * 3) % 20 / 20.0, "gap_minutes": F.when(p % 40 == 0, 45.0).otherwise(10.0), "stopped": p % 5 == 0})
    return data_quality(h, ["base"], "t", 10.0).select("base", sec("t").alias("t"), "candidate", "confirmed")


@query("c01_text_tests", "SELECT p_partkey, trim(lower('  ' || p_name || ' ')) AS x, starts_with(lower(p_name), 'a') AS a, ends_with(p_name, 'e') AS e, contains(p_brand, '3') AS c FROM part")
def c01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.trim(F.lower(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("x"), F.lower("p_name").startswith("a").alias("a"), F.col("p_name").endswith("e").alias("e"), F.col("p_brand").contains("3").alias("c"))


@query("c03_regex_include_exclude", "SELECT DISTINCT p_name, regexp_matches(lower(p_name), '(^|[ _])[a-m]') AND NOT regexp_matches(lower(p_name), 'ee|oo') AS hit FROM part")
def c03(spark: SparkSession, d: str) -> DataFrame:
    x = F.lower("p_name")
    return table(spark, d, "part").select("p_name", (x.rlike("(^|[ _])[a-m]") & ~x.rlike("ee|oo")).alias("hit")).distinct()


@query("c05_snapshot_ids", "SELECT event_id, CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%dT%H%M%S') AS snapshot FROM events")
def c05(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "event_id", "user_id", "ts").select("event_id", F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd'T'HHmmss")).alias("snapshot"))


@query("c06_durations", f"WITH {SPANS} SELECT event_id, round((epoch_us(e) - epoch_us(s)) / 3.6e9 + 10 / 60.0, 6) AS hours, CAST(floor(epoch(e + INTERVAL 10 MINUTE)) AS BIGINT) AS last FROM spans")
def c06(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    return s.select("event_id", r(scalars.hours_between(F.col("start"), F.col("end")) + 10 / 60.0).alias("hours"), sec(F.col("end") + F.expr("interval 10 minutes")).alias("last"))


@query("c07_guarded_math", "SELECT event_id, round(ln(1 + greatest(value, 0)), 6) AS log, round(sqrt(greatest(value - 50, 0)), 6) AS root, CAST(ceil(value / 7) AS BIGINT) AS up, round(exp(-abs(value - 50) / 10), 6) AS weight, round(least(greatest(value, 10), 90), 6) AS clipped FROM events")
def c07(spark: SparkSession, d: str) -> DataFrame:
    v, zero = F.col("value"), F.lit(0.0)
    return events(spark, d, "event_id", "value").select("event_id", r(F.log1p(F.greatest(v, zero))).alias("log"), r(F.sqrt(F.greatest(v - 50, zero))).alias("root"), F.ceil(v / 7).alias("up"), r(F.exp(-F.abs(v - 50) / 10)).alias("weight"), r(F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0))).alias("clipped"))


SIGNALS = f"{LONG}, rows AS (SELECT t, list(value ORDER BY base, stat) AS a, list(base || '_' || stat ORDER BY base, stat) AS n FROM long GROUP BY 1)"


@query("c09_array_argmax", f"WITH {SIGNALS} SELECT {T}, n[list_position(a, list_max(a))] AS top, round(list_max(a), 6) AS value, round(list_sort(a)[2], 6) AS second_least, len(a[2:4]) AS n_slice FROM rows WHERE len(a) > 3")
def c09(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.arrays import first_argmax

    x = grid_long(spark, d).groupBy("t").agg(F.sort_array(F.collect_list(F.struct("base", "stat", "value"))).alias("x")).where(F.size("x") > 3)
    a, n = F.transform("x", lambda y: y["value"]), F.transform("x", lambda y: F.concat_ws("_", y["base"], y["stat"]))
    return x.select(sec("t").alias("t"), first_argmax(a, n).alias("top"), r(F.array_max(a)).alias("value"), r(F.sort_array(a)[1]).alias("second_least"), F.size(F.slice(a, 2, 3)).cast("long").alias("n_slice"))


@query("c10_lookup_with_default", "SELECT event_id, CASE event_type WHEN 'error' THEN 'Fault signal' WHEN 'view' THEN 'Page view' ELSE 'UNKNOWN' END AS description FROM events")
def c10(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(F.lit("error"), F.lit("Fault signal"), F.lit("view"), F.lit("Page view"))
    return events(spark, d, "event_id", "event_type").select("event_id", F.coalesce(F.try_element_at(known, F.col("event_type")), F.lit("UNKNOWN")).alias("description"))


@query("c12_first_match_wins", "SELECT event_id, CASE WHEN value >= 90 THEN 'extreme' WHEN value >= 50 AND event_type = 'error' THEN 'error_high' WHEN value >= 50 THEN 'high' ELSE 'low' END AS class FROM events")
def c12(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    c = F.when(v >= 90, "extreme").when((v >= 50) & (F.col("event_type") == "error"), "error_high").when(v >= 50, "high").otherwise("low")
    return events(spark, d, "event_id", "event_type", "value").select("event_id", c.alias("class"))


@query("c13_null_and_infinity", "SELECT event_id, round(least(coalesce(CASE WHEN event_id % 6 > 2 THEN value * 20000 END, 0), 1e6), 4) AS v FROM events")
def c13(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    x = F.when(i % 6 == 0, F.lit(float("nan"))).when(i % 6 == 1, F.lit(float("inf"))).when(i % 6 > 2, F.col("value") * 20000)
    return events(spark, d, "event_id", "value").select("event_id", F.round(F.least(F.coalesce(scalars.finite(x), F.lit(0.0)), F.lit(1e6)), 4).alias("v"))


@query("a46_rule_baseline", f"WITH {PREDICTIONS}, f AS (SELECT doc_id, actual, CAST(avg(probability) >= 0.5 AS INTEGER) AS rule FROM p GROUP BY 1, 2) SELECT count(*) FILTER (WHERE actual = 1 AND rule = 1) AS tp, count(*) FILTER (WHERE actual = 0 AND rule = 0) AS tn, count(*) FILTER (WHERE actual = 0 AND rule = 1) AS fp, count(*) FILTER (WHERE actual = 1 AND rule = 0) AS fn FROM f")
def a46(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import metrics

    f = predictions(spark, d).groupBy("doc_id", "actual").agg((F.avg("probability") >= 0.5).cast("int").alias("rule"))
    return metrics.confusion(f, [], "actual", "rule").select("tp", "tn", "fp", "fn")


@query("t13_output_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS at FROM events")
def t13(spark: SparkSession, d: str) -> DataFrame:
    """Output order by time, group and id; a row's place is counted by key, and only the sort itself is global."""
    w = frames.keyed(["user_id"], ["ts", "event_type", "event_id"])
    e = events(spark, d, "event_id", "user_id", "event_type", "ts").withColumn("at", F.row_number().over(w))
    return e.orderBy("ts", "user_id", "event_id").select("event_id", F.col("at").cast("bigint").alias("at"))
