"""Queries of the online detector, snapshots and the streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, frames
from ..streaming import causal
from ..streaming.replay import in_order, manifest, replay
from ..streaming.snapshots import snapshots
from ..streaming.step import StreamConfig
from .fixtures import BASE_Z, GRID, HOURLY, SOURCES, STATS, events, grid_long, hourly, r, sec, source_grid, source_hourly

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BASES = ("click", "error", "purchase", "signup", "view")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


T = "CAST(floor(epoch(t)) AS BIGINT) AS t"
W = "PARTITION BY base ORDER BY t"
CFG = StreamConfig(sampling_minutes=60, warmup=72, level=2.5, extreme=3.5, semantic_level=2.0, targeted_level=3.0, rare_share=0.01, stopped=0.85, generating=0.95)


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """The hourly grid of three sources: (source, ts, status, values). Where a source has no event of a type in an hour its
    signals are missing."""
    g = source_grid(spark, d).unpivot(["source", "t", "base"], list(STATS), "stat", "value")
    wide = g.groupBy("source", "t").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws("_", "base", "stat").alias("k"), "value")))).alias("values"), F.count("*").alias("n"))
    return wide.select("source", F.col("t").alias("ts"), (F.col("n") % 7).cast("string").alias("status"), "values")


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    signals = [f"{b}_{s}" for b in BASES for s in STATS]
    return replay(_wide(spark, d), signals, ["purchase_avg", "signup_avg", "view_avg"], {"shop": ["purchase", "signup"], "site": ["click", "view"], "faults": ["error"]}, CFG)


@query("r01_causal_replay")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d)


@query("r02_warm_up", f"WITH {SOURCES}, n AS (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY t) AS n FROM (SELECT DISTINCT source, t FROM sh)) SELECT source, {T}, n > 72 AS warmup_complete, n <= 72 AS quiet FROM n")
def r02(spark: SparkSession, d: str) -> DataFrame:
    """The first 72 rows of a source only warm up: they have no score and no phase."""
    return _replayed(spark, d).select("source", sec("ts").alias("t"), "warmup_complete", (F.col("state") == "warmup").alias("quiet"))


@query("r04_operating_state", f"""WITH {SOURCES}, p AS (SELECT source, t, median(value) FILTER (WHERE base IN ('purchase', 'signup', 'view')) AS p FROM sh GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t) AS n FROM p), sc AS (SELECT source, abs(quantile_cont(p, 0.9)) AS s FROM n WHERE n <= 72 GROUP BY 1),
m AS (SELECT source, t, n, CASE WHEN p IS NULL THEN 'unknown' WHEN p / s < 0.85::DOUBLE THEN 'stopped' WHEN p / s < 0.95::DOUBLE THEN 'transition' ELSE 'generating' END AS mode FROM n JOIN sc USING (source) WHERE n > 72),
i AS (SELECT *, sum(CASE WHEN mode = b THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY t) AS k FROM (SELECT *, lag(mode) OVER (PARTITION BY source ORDER BY t) AS b FROM m)),
a AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY t) AS nth FROM i)
SELECT source, {T}, coalesce(last_value(CASE WHEN nth >= 3 THEN mode END IGNORE NULLS) OVER (PARTITION BY source ORDER BY t ROWS UNBOUNDED PRECEDING), 'unknown') AS mode FROM a""")
def r04(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d).where("warmup_complete").select("source", sec("ts").alias("t"), "mode")


TOKENS = "tk AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 41 = 0 THEN 'odd' || CAST(event_id % 3 AS VARCHAR) ELSE event_type END AS token FROM events)"


@query("r05_status_rarity", f"""WITH {TOKENS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos, coalesce(CAST(token <> lag(token) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER), 0) AS ch FROM tk),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, token ORDER BY pos RANGE BETWEEN 40 PRECEDING AND 1 PRECEDING) AS seen, least(pos - 1, 40) AS k, sum(ch) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS b FROM n),
f AS (SELECT *, k >= 12 AND seen = 0 AS novel, k >= 12 AND seen > 0 AND seen <= 0.1::DOUBLE * k AS rare FROM c),
l AS (SELECT *, lag(novel, 1, false) OVER w AS n1, lag(rare, 1, false) OVER w AS r1, lag(rare, 2, false) OVER w AS r2 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, novel, rare, b >= 2 AS burst, (novel AND n1) OR (rare AND r1 AND r2) AS confirmed FROM l""")
def r05(spark: SparkSession, d: str) -> DataFrame:
    """A token is novel or rare only after enough history, and confirmed after two or three such rows in a row."""
    return _tokens(spark, d, 0.1).select("event_id", "novel", "rare", "burst", "confirmed")


def _tokens(spark: SparkSession, d: str, rare: float) -> DataFrame:
    i = F.col("event_id")
    e = events(spark, d, "event_id", "user_id", "event_type", "ts").withColumn("token", F.when(i % 41 == 0, F.concat(F.lit("odd"), (i % 3).cast("string"))).otherwise(F.col("event_type")))
    return causal.status_rarity(e, ["user_id"], "ts", "token", 40, rare, 2, 12)


def _z(spark: SparkSession, d: str) -> DataFrame:
    ref = F.col("t") < F.lit("2024-01-11 00:00:00").cast("timestamp")
    return detectors.base_z(grid_long(spark, d).withColumn("fleet", F.lit("all")), ref, ["fleet"], "t")


GROUPS = {"shop": ("purchase", "signup", "error"), "site": ("click", "view")}
SEMANTIC = f"""{BASE_Z}, gr AS (SELECT unnest(['shop', 'shop', 'shop', 'site', 'site']) AS name, unnest(['purchase', 'signup', 'error', 'click', 'view']) AS base),
g AS (SELECT t, name, count(*) AS n, count(*) FILTER (WHERE z >= 1.0) AS n_high, max(z) AS max_z FROM z JOIN gr USING (base) GROUP BY 1, 2), b AS (SELECT *, n_high >= least(n, 8, greatest(2, ceil(n * 0.2))) AS busy FROM g),
h AS (SELECT *, coalesce(avg(CAST(busy AS DOUBLE)) OVER (PARTITION BY name ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) AS burden FROM b)"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    g = spark.createDataFrame([(b, n) for n, bs in GROUPS.items() for b in bs], "base string, name string")
    return causal.semantic_groups(_z(spark, d), g, ["fleet"], "t", 1.0, 24)


@query("r06_semantic_groups", f"WITH {SEMANTIC} SELECT {T}, name, n_high, busy, round(burden, 6) AS burden, busy AND burden <= 0.10 AS onset, burden >= 0.20 - 1e-12 AS chronic FROM h")
def r06(spark: SparkSession, d: str) -> DataFrame:
    x = _groups(spark, d).withColumn("chronic", F.col("burden") >= 0.20 - 1e-12)
    return x.select(sec("t").alias("t"), "name", "n_high", "busy", r("burden").alias("burden"), "onset", "chronic")


def _latch(rows: str, key: str, confirm: int, quiet: int) -> str:
    """SQL of a latch over ``rows`` (key, pos, want, calm), as lat(key, pos, fired)."""
    return f"""lat({key}, pos, run, quiet, latched, fired) AS (SELECT DISTINCT {key}, 0::BIGINT, 0, 0, false, false FROM {rows} UNION ALL
SELECT {key}, pos, nr, CASE WHEN arm THEN 0 ELSE nq END, (latched AND NOT arm) OR nr >= {confirm}, nr >= {confirm} AND NOT (latched AND NOT arm) FROM (SELECT *, latched AND nq >= {quiet} AS arm FROM (
SELECT x.{key}, x.pos, l.latched, CASE WHEN want THEN l.run + 1 ELSE 0 END AS nr, CASE WHEN calm THEN l.quiet + 1 ELSE 0 END AS nq FROM lat l JOIN {rows} x ON x.{key} = l.{key} AND x.pos = l.pos + 1)))"""


@query("r16_targeted_onset", f"WITH RECURSIVE {SEMANTIC}, o AS (SELECT name, t, row_number() OVER (PARTITION BY name ORDER BY t) AS pos, name IN ('shop', 'site') AND busy AND burden <= 0.10 AND burden < 0.20 AND max_z >= 1.2::DOUBLE AS want FROM h), oc AS (SELECT *, NOT want AS calm FROM o), {_latch('oc', 'name', 1, 12)} SELECT {T}, count(*) FILTER (WHERE fired) AS n_groups, count(*) FILTER (WHERE fired) BETWEEN 1 AND 2 AS targeted FROM lat JOIN o USING (name, pos) GROUP BY t")
def r16(spark: SparkSession, d: str) -> DataFrame:
    """Listed groups with a new onset at a high level, armed again after twelve rows without."""
    return causal.targeted_onset(_groups(spark, d), ["fleet"], "t", ["shop", "site"], 1.2, 1, 12).select(sec("t").alias("t"), "n_groups", "targeted")


POWER = f"{HOURLY}, q AS (SELECT *, CASE WHEN count(value) OVER b >= 3 THEN median(value) OVER b END AS ref FROM h WINDOW b AS ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)), pd AS (SELECT *, coalesce(ref > 0 AND value <= 0.9::DOUBLE * ref, false) AS dip FROM q), pr AS (SELECT *, coalesce(lag(dip) OVER ({W}) AND value >= 0.95::DOUBLE * lag(ref) OVER ({W}), false) AS rec FROM pd)"


def _power(spark: SparkSession, d: str) -> DataFrame:
    return causal.causal_power(hourly(spark, d), ["base"], "t", "value", 0.9, 0.95)


@query("r08_causal_power", f"WITH {POWER} SELECT base, {T}, round(ref, 6) AS reference, dip, rec AS recovered FROM pr")
def r08(spark: SparkSession, d: str) -> DataFrame:
    return _power(spark, d).select("base", sec("t").alias("t"), r("reference").alias("reference"), "dip", "recovered")


@query("r09_pending_stops", f"""WITH RECURSIVE {POWER}, x AS (SELECT base, t, epoch(t) AS s, pos, value, ref, dip, value < 52 AS opens FROM pr),
f(base, pos, started, open_at, dips, stable, ref, rec, last) AS (SELECT DISTINCT base, 0, false, CAST(NULL AS DOUBLE), 0, 0, CAST(NULL AS DOUBLE), false, -1e18::DOUBLE FROM x UNION ALL
SELECT base, pos, o IS NOT NULL AND ns >= 2 AND s - last >= 7200, CASE WHEN o IS NULL THEN CASE WHEN dip AND opens THEN s END WHEN ns >= 2 OR nd > 3 OR s - o > 36000 THEN NULL ELSE o END, CASE WHEN o IS NULL THEN 1 ELSE nd END, CASE WHEN o IS NULL THEN 0 ELSE ns END, CASE WHEN o IS NULL THEN xref ELSE fref END, CASE WHEN o IS NULL THEN false ELSE rec OR back END, CASE WHEN o IS NOT NULL AND ns >= 2 AND s - last >= 7200 THEN s ELSE last END
FROM (SELECT x.base, x.pos, x.s, x.dip, x.opens, x.ref AS xref, f.open_at AS o, f.ref AS fref, f.rec, f.last, coalesce(x.value >= 0.95::DOUBLE * f.ref, false) AS back, CASE WHEN coalesce(x.value >= 0.95::DOUBLE * f.ref, false) THEN f.stable + 1 WHEN f.rec THEN 0 ELSE f.stable END AS ns, CASE WHEN coalesce(x.value >= 0.95::DOUBLE * f.ref, false) OR f.rec THEN f.dips ELSE f.dips + 1 END AS nd FROM f JOIN x ON x.base = f.base AND x.pos = f.pos + 1))
SELECT x.base, CAST(floor(x.s) AS BIGINT) AS t, f.started FROM f JOIN x ON x.base = f.base AND x.pos = f.pos""")
def r09(spark: SparkSession, d: str) -> DataFrame:
    p = _power(spark, d).select("base", "t", F.col("value").alias("power"), "reference", "dip", (F.col("value") < 52).alias("opens"))
    cfg = StreamConfig(recovery_ratio=0.95, stable_rows=2, max_dip=3, pending_minutes=600, independence_minutes=120)
    return causal.pending_stops(p, ["base"], "t", cfg).select("base", sec("t").alias("t"), "started")


@query("r10_stop_counts", f"""WITH {HOURLY}, f AS (SELECT *, value < 45 AS flag, value < 47 AS act FROM h),
c AS (SELECT *, sum(CAST(flag AS INTEGER)) OVER ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c2, sum(CAST(flag AS INTEGER)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c6, sum(CAST(flag AS INTEGER)) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS c24,
count(*) OVER b AS nb, coalesce(avg(CAST(act AS DOUBLE)) OVER b, 0) AS share, coalesce(sum(CAST(flag AS INTEGER)) OVER b, 0) AS stops FROM f WINDOW b AS ({W} ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, nb >= 48 AND (share >= 0.3::DOUBLE OR stops >= 40) AS busy FROM c)
SELECT base, {T}, CAST(c2 AS BIGINT) AS count_2, CAST(c6 AS BIGINT) AS count_6, CAST(c24 AS BIGINT) AS count_24, busy, flag AND CASE WHEN busy THEN c2 >= 4 OR (c6 >= 3 AND c24 >= 8) ELSE c2 >= 3 OR (c6 >= 2 AND c24 >= 6) END AS over FROM y""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Two hours, or six and 24 together; more is needed where the week before was busy."""
    h = hourly(spark, d).withColumns({"flag": F.col("value") < 45, "act": F.col("value") < 47})
    x = causal.stop_counts(h, ["base"], "t", "flag", "act", (2, 6, 24), 168, 48, active_share=0.3, week_count=40)
    return x.select("base", sec("t").alias("t"), "count_2", "count_6", "count_24", "busy", "over")


@query("r12_localized_confirmation", f"""WITH {HOURLY}, f AS (SELECT *, value >= 47 AS raw, value >= 55 AS support, value < 62 AS allowed FROM h),
i AS (SELECT *, sum(CASE WHEN raw IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER ({W}) AS k FROM (SELECT *, lag(raw) OVER ({W}) AS p FROM f)),
u AS (SELECT *, row_number() OVER v AS run, min(t) OVER v AS began, bool_or(support) OVER v AS seen FROM i WINDOW v AS (PARTITION BY base, k ORDER BY t)),
q AS (SELECT *, min(CASE WHEN raw AND allowed AND seen AND run >= 2 AND epoch(t) - epoch(began) <= 7200 THEN t END) OVER (PARTITION BY base, k ORDER BY t) AS hit FROM u)
SELECT base, {T}, raw, coalesce(hit = t, false) AS fires, coalesce(raw AND run >= 2 AND hit IS NOT NULL AND (epoch(t) - epoch(hit)) / 3600 <= 6, false) AS confirmed FROM q""")
def r12(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed within two hours of the stretch's start, once it has lasted two rows, and for six hours."""
    v = F.col("value")
    h = hourly(spark, d).withColumns({"raw": v >= 47, "support": v >= 55, "allowed": v < 62})
    out = causal.confirmed_once(h, ["base"], "t", StreamConfig(sampling_minutes=60, localized_points=2, localized_minutes=120, localized_hours=6))
    return h.select("base", "t", "raw").join(out, ["base", "t"]).select("base", sec("t").alias("t"), "raw", "fires", "confirmed")


@query("r13_slow_trend", f"""WITH {SOURCES}, s AS (SELECT source, base, t, row_number() OVER (PARTITION BY source, base ORDER BY t) AS pos, (value - 50) / 2 AS z, value < 56 AS ok FROM sh),
w AS (SELECT *, regr_slope(z, pos) OVER f AS sl, median(z) OVER f - CASE WHEN pos >= 24 THEN median(z) OVER (PARTITION BY source, base ORDER BY t ROWS BETWEEN 23 PRECEDING AND 6 PRECEDING) ELSE 0 END AS sf FROM s WINDOW f AS (PARTITION BY source, base ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
g AS (SELECT source, t, count(*) FILTER (WHERE ok AND pos >= 6 AND abs(sl) >= 0.2::DOUBLE AND abs(sf) >= 0.6::DOUBLE) AS n FROM w GROUP BY 1, 2),
i AS (SELECT *, sum(CASE WHEN n >= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY t) AS k FROM g)
SELECT source, {T}, n AS n_rising, n >= 2 AND count(*) FILTER (WHERE n >= 2) OVER (PARTITION BY source, k ORDER BY t) >= 2 AS trend FROM i""")
def r13(spark: SparkSession, d: str) -> DataFrame:
    """Slope over six rows, shift of their median from the rows before, 24 in all, and only in allowed rows."""
    v = F.col("value")
    z = source_hourly(spark, d).select("source", "base", "t", ((v - 50) / 2).alias("z"), (v < 56).alias("ok"))
    return causal.slow_trend(z, ["source"], "t", 6, 24, 1.0, "ok", 0.2, 0.6, 2, 2).select("source", sec("t").alias("t"), "n_rising", "trend")


@query("r14_cluster_latch", f"WITH RECURSIVE {HOURLY}, f AS (SELECT *, value >= 54 AS started FROM h), c AS (SELECT *, sum(CAST(started AS INTEGER)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c6 FROM f), x AS (SELECT base, t, pos, started AND c6 >= 2 AS want, c6 <= 1 AND NOT started AS calm FROM c), {_latch('x', 'base', 1, 4)} SELECT base, {T}, want AS qualified, fired FROM lat JOIN x USING (base, pos)")
def r14(spark: SparkSession, d: str) -> DataFrame:
    """A cluster of stops fires once; it is armed again after rows without a stop and at most one in six hours."""
    h = hourly(spark, d).withColumn("started", F.col("value") >= 54)
    h = h.withColumn("c6", F.sum(F.col("started").cast("int")).over(frames.trailing(frames.keyed(["base"], ["t"]), 6))).withColumn("qualified", F.col("started") & (F.col("c6") >= 2))
    out = causal.latched(h, ["base"], "t", "qualified", (F.col("c6") <= 1) & ~F.col("started"), 1, 4)
    return h.select("base", "t", "qualified").join(out, ["base", "t"]).select("base", sec("t").alias("t"), "qualified", "fired")


@query("r15_fusion_latch", f"""WITH RECURSIVE {POWER}, {SEMANTIC.removeprefix(GRID + ', ')}, o AS (SELECT t, count(*) FILTER (WHERE busy AND burden <= 0.30::DOUBLE) AS n FROM h2 GROUP BY 1), dp AS (SELECT t, bool_or(dip) AS dip FROM pd GROUP BY 1),
y AS (SELECT 'all' AS fleet, t, row_number() OVER (ORDER BY t) AS pos, coalesce(n BETWEEN 1 AND 2 AND dip, false) AS want FROM o LEFT JOIN dp USING (t)), x AS (SELECT *, NOT want AS calm FROM y), {_latch('x', 'fleet', 1, 12)} SELECT {T}, want AS wanted, fired AS fused FROM lat JOIN x USING (fleet, pos)""".replace("\nh AS (SELECT *, coalesce(avg(CAST(busy", "\nh2 AS (SELECT *, coalesce(avg(CAST(busy"))
def r15(spark: SparkSession, d: str) -> DataFrame:
    """One or two groups with an onset while a power signal dips, once, and again after twelve rows without."""
    onset = _groups(spark, d).groupBy("fleet", "t").agg(F.count_if(F.col("busy") & (F.col("burden") <= 0.30)).alias("n"))
    dips = _power(spark, d).groupBy("t").agg(F.bool_or("dip").alias("dip"))
    x = onset.join(dips, "t", "left").withColumn("wanted", F.coalesce(F.col("n").between(1, 2) & F.col("dip"), F.lit(False)))
    out = causal.latched(x, ["fleet"], "t", "wanted", ~F.col("wanted"), 1, 12)
    return x.select("t", "wanted").join(out, "t").select(sec("t").alias("t"), "wanted", F.col("fired").alias("fused"))


@query("r17_communication_fault", f"""WITH {TOKENS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos, coalesce(CAST(token <> lag(token) OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER), 0) AS ch, event_id % 3 < 2 AS poor FROM tk),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, token ORDER BY pos RANGE BETWEEN 40 PRECEDING AND 1 PRECEDING) AS seen, least(pos - 1, 40) AS k, sum(ch) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS b, poor AND lag(poor, 1, false) OVER (PARTITION BY user_id ORDER BY ts) AS sure FROM n),
y AS (SELECT *, sure AND ((k >= 12 AND seen <= 0.3::DOUBLE * k) OR b >= 2) AS bad FROM c), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM y)
SELECT event_id, bad AND count(*) FILTER (WHERE bad) OVER (PARTITION BY user_id, g ORDER BY ts) >= 2 AS fault FROM i""")
def r17(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed bad data (two rows in a row) and an unusual status or a burst of changes together, two rows in a row."""
    s = _tokens(spark, d, 0.3).withColumn("poor", F.col("event_id") % 3 < 2)
    s = frames.run_length(s, "poor", ["user_id"], ["ts"]).withColumn("sure", F.col("run") >= 2)
    return causal.communication_fault(s, ["user_id"], "ts", "sure").select("event_id", "fault")


PHASES = f"""{HOURLY}, x AS (SELECT base, t, pos, value >= 58 AS tr, value >= 54 AS rv, value >= 50 AS su FROM h),
f(base, pos, phase, run, closed) AS (SELECT DISTINCT base, 0, 'normal', 0, false FROM x UNION ALL
SELECT base, pos, CASE WHEN phase IN ('normal', 'candidate') THEN CASE WHEN tr THEN 'active_alert' WHEN rv THEN 'candidate' ELSE 'normal' END
WHEN phase = 'active_alert' THEN CASE WHEN su THEN phase ELSE 'recovery_pending' END
WHEN phase = 'recovery_pending' THEN CASE WHEN su THEN 'active_alert' WHEN run + 1 >= 3 THEN 'inactive_pending' ELSE phase END
ELSE CASE WHEN tr THEN 'active_alert' WHEN run + 1 >= 6 THEN 'normal' ELSE phase END END,
CASE WHEN phase IN ('normal', 'candidate') THEN 0 WHEN phase = 'active_alert' THEN CASE WHEN su THEN 0 ELSE 1 END
WHEN phase = 'recovery_pending' THEN CASE WHEN su OR run + 1 >= 3 THEN 0 ELSE run + 1 END ELSE CASE WHEN tr OR run + 1 >= 6 THEN 0 ELSE run + 1 END END,
phase = 'inactive_pending' AND NOT tr AND run + 1 >= 6
FROM (SELECT x.base, x.pos, tr, rv, su, f.phase, f.run FROM f JOIN x ON x.base = f.base AND x.pos = f.pos + 1))"""


def _phases(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    h = hourly(spark, d).select("base", "t", (v >= 58).alias("trigger"), (v >= 54).alias("review"), (v >= 50).alias("support"))
    return causal.alert_phases(h, ["base"], "t", StreamConfig(sampling_minutes=60, recovery_rows=3, merge_hours=6))


@query("r19_alert_phases", f"WITH RECURSIVE {PHASES} SELECT x.base, CAST(floor(epoch(x.t)) AS BIGINT) AS t, phase, closed FROM f JOIN x ON x.base = f.base AND x.pos = f.pos")
def r19(spark: SparkSession, d: str) -> DataFrame:
    return _phases(spark, d).select("base", sec("t").alias("t"), "phase", "closed")


@query("r20_right_censored", f"WITH RECURSIVE {PHASES} SELECT base, count(*) FILTER (WHERE closed) AS n_closed, arg_max(phase, pos) IN ('active_alert', 'recovery_pending', 'inactive_pending') AS right_censored FROM f WHERE pos > 0 GROUP BY 1")
def r20(spark: SparkSession, d: str) -> DataFrame:
    return causal.open_episodes(_phases(spark, d), ["base"], "t")


@query("r21_order_and_repeats", "SELECT CAST(user_id AS VARCHAR) AS source, CAST(floor(epoch(ts)) AS BIGINT) AS t, max(CAST(event_id % 7 AS VARCHAR)) AS status FROM events GROUP BY user_id, ts")
def r21(spark: SparkSession, d: str) -> DataFrame:
    """Late and repeated rows: of rows with one time the last counts, whatever order they came in."""
    e = events(spark, d, "event_id", "user_id", "ts").select(F.col("user_id").cast("string").alias("source"), "ts", (F.col("event_id") % 7).cast("string").alias("status"), F.create_map(F.lit("x"), F.lit(1.0)).alias("values"))
    return in_order(e.union(e).repartition(3, F.rand(1))).select("source", sec("ts").alias("t"), "status")


@query("r22_replay_manifest", f"WITH {SOURCES} SELECT source, count(DISTINCT t) AS n_rows, false AS failed FROM sh GROUP BY 1 UNION ALL SELECT 'broken ' || source, 0, true FROM sh GROUP BY 1")
def r22(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fail are reported and don't stop the others."""
    w = _wide(spark, d)
    both = w.union(w.select(F.concat(F.lit("broken "), "source").alias("source"), "ts", "status", F.lit(None).cast("map<string,double>").alias("values")))
    return manifest(replay(both, [f"{b}_{s}" for b in BASES for s in STATS], ["view_avg"], cfg=CFG)).select("source", "n_rows", "failed")


@query(
    "r23_snapshots",
    f"""WITH {HOURLY}, f AS (SELECT *, value >= 50 AS flag FROM h),
i AS (SELECT *, sum(CASE WHEN flag IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY base ORDER BY t) AS k FROM (SELECT *, lag(flag) OVER (PARTITION BY base ORDER BY t) AS p FROM f)),
x AS (SELECT base, t, pos, value, flag, CASE WHEN flag THEN row_number() OVER (PARTITION BY base, k ORDER BY t) ELSE 0 END AS run FROM i),
w AS (SELECT *, max(CAST(value >= 55 AS INTEGER)) OVER (PARTITION BY base ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS ahead, avg(value) OVER v AS m, stddev_pop(value) OVER v AS s, sum(CAST(flag AS INTEGER)) OVER v AS c, value - lag(value, 12) OVER (PARTITION BY base ORDER BY t) AS dl FROM x WINDOW v AS (PARTITION BY base ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
n AS (SELECT *, row_number() OVER (PARTITION BY base, ahead ORDER BY t) - 1 AS q FROM w WHERE pos >= 12)
SELECT base, CAST(epoch(t) AS BIGINT) AS t, ahead AS target_ahead, CAST(run AS BIGINT) AS run_points, round(m, 6) AS mean_12, round(s, 5) AS std_12, CAST(c AS BIGINT) AS count_12, round(dl, 6) AS delta_12 FROM n WHERE q % CASE WHEN ahead = 1 THEN 1 ELSE 6 END = 0""",
)
def r23(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumns({"flag": F.col("value") >= 50, "target": F.col("value") >= 55})
    s = snapshots(h, ["base"], "t", "value", "flag", "target", [12], 6)
    return s.select("base", sec("t").alias("t"), "target_ahead", F.col("run_points").cast("bigint").alias("run_points"), r("mean_12").alias("mean_12"), F.round("std_12", 5).alias("std_12"), F.col("count_12").cast("bigint").alias("count_12"), r("delta_12").alias("delta_12"))
