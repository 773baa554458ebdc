"""Queries of models, candidate choice, held-out runs and user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import frames, metrics, ml, ranking, stats
from .fixtures import GRID, HOURLY, PREDICTIONS, REFERENCE, events, grid, hourly, predictions, r, sec, table

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


FEATURES = ["f0", "f1", "f2"]


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return x.select("doc_id", F.col("toxic").alias("label"), F.log1p("n_chars").alias("f0"), F.col("quality").cast("double").alias("f1"), (F.col("lang") == "en").cast("double").alias("f2"))


@query("m02_out_of_fold_thresholds")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return ml.thresholds(ml.out_of_fold(_labelled(spark, d), "doc_id", "label", FEATURES))


@query("m03_fold_comparison")
def m03(spark: SparkSession, d: str) -> DataFrame:
    p = ml.out_of_fold(_labelled(spark, d), "doc_id", "label", FEATURES, specs={"logistic_regression": [(0.1,)], "decision_tree": [(3,)]})
    return ml.fold_comparison(p, ml.thresholds(p))


@query("m05_final_fit")
def m05(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d)
    specs = {"logistic_regression": [(0.1,)]}
    row = ml.thresholds(ml.out_of_fold(x, "doc_id", "label", FEATURES, specs=specs)).first()
    return ml.final_fit(x, "doc_id", "label", FEATURES, ("logistic_regression", (0.1,), row["threshold"]))


STANDARD = f"{GRID}, st AS (SELECT base, avg(avg) AS m, stddev_pop(avg) AS s FROM grid WHERE t < {REFERENCE} GROUP BY 1), z AS (SELECT t, base AS node, (avg - m) / s AS value FROM grid JOIN st USING (base))"
GRAPH = f"""{STANDARD}, c AS (SELECT a.node AS i, b.node AS j, abs(corr(a.value, b.value)) AS weight FROM z a JOIN z b ON a.t = b.t AND a.node <> b.node WHERE a.t < {REFERENCE} GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY weight DESC, j) AS n FROM c) WHERE n <= 2), s AS (SELECT i, j, max(weight) AS weight FROM (SELECT i, j, weight FROM k UNION ALL SELECT j, i, weight FROM k) GROUP BY 1, 2),
w AS (SELECT i, j, weight / sum(weight) OVER (PARTITION BY i) AS w FROM s), e AS (SELECT z.t, z.node, z.value, sum(w.w * y.value) AS rebuilt FROM z JOIN w ON w.i = z.node JOIN z y ON y.t = z.t AND y.node = w.j GROUP BY 1, 2, 3)"""


def _standard_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = grid(spark, d).select("t", F.col("base").alias("node"), F.col("avg").alias("value"))
    s = g.where(_ref()).groupBy("node").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = g.join(s, "node").select("t", "node", ((F.col("value") - F.col("m")) / F.col("s")).alias("value"))
    h = z.where(_ref())
    pairs = h.select("t", F.col("node").alias("i"), F.col("value").alias("a")).join(h.select("t", F.col("node").alias("j"), F.col("value").alias("b")), "t").where("i <> j")
    edges = ranking.sparsify(pairs.groupBy("i", "j").agg(F.abs(F.corr("a", "b")).alias("weight")), 2, 0.0)
    return z, edges


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return ml.graph_reconstruction(*_standard_graph(spark, d), "t")


@query("m13_graph_reconstruction", f"WITH {GRAPH} SELECT {T}, node, round(value, 5) AS value, round(rebuilt, 5) AS rebuilt FROM e")
def m13(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d).select(sec("t").alias("t"), "node", F.round("value", 5).alias("value"), F.round("rebuilt", 5).alias("rebuilt"))


@query("m13_graph_components")
def m13_components(spark: SparkSession, d: str) -> DataFrame:
    """Values rebuilt from three components of the smoothed rows, fitted on the reference days."""
    z, edges = _standard_graph(spark, d)
    x = ml.graph_components(z, ranking.normalised(edges), "t", 3, _ref())
    return x.select(sec("t").alias("t"), "node", F.round("value", 5).alias("value"), F.round("rebuilt", 5).alias("rebuilt"))


@query("m14_reconstruction_by_time_and_signal", f"WITH {GRAPH} SELECT 'time' AS by, CAST(CAST(floor(epoch(t)) AS BIGINT) AS VARCHAR) AS key, round(avg(abs(value - rebuilt)), 5) AS error FROM e GROUP BY t UNION ALL SELECT 'signal', node, round(avg(abs(value - rebuilt)), 5) FROM e GROUP BY node UNION ALL SELECT 'all', '', round(avg(abs(value - rebuilt)), 5) FROM e")
def m14(spark: SparkSession, d: str) -> DataFrame:
    e = _rebuilt(spark, d)
    error = F.round(F.avg("error"), 5).alias("error")
    by = lambda name, key: e.groupBy(key.alias("key")).agg(error).select(F.lit(name).alias("by"), "key", "error")
    return by("time", sec("t").cast("string")).union(by("signal", F.col("node"))).union(by("all", F.lit("")))


@query("m18_run_for_each_source", f"""WITH {HOURLY}, q AS (SELECT base, median(value) AS c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_samp(value) AS sd FROM h WHERE t < {REFERENCE} GROUP BY 1),
m AS (SELECT h.base, 1.4826::DOUBLE * median(abs(value - c)) AS m FROM h JOIN q USING (base) WHERE t < {REFERENCE} GROUP BY 1),
z AS (SELECT h.base, t, abs(value - c) / CASE WHEN m > 1e-9 THEN m WHEN (q3 - q1) / 1.349::DOUBLE > 1e-9 THEN (q3 - q1) / 1.349::DOUBLE ELSE sd END AS z FROM h JOIN q USING (base) JOIN m USING (base)),
th AS (SELECT base, greatest(1.0, quantile_cont(z, 0.9) FILTER (WHERE t < {REFERENCE})) AS th FROM z GROUP BY 1),
a AS (SELECT z.base, t, th FROM z JOIN th USING (base) WHERE z >= th - 1e-12 AND t >= {REFERENCE} + INTERVAL 24 HOUR),
g AS (SELECT *, CASE WHEN (epoch_us(t) - epoch_us(lag(t) OVER ({W}))) / 1e6 > 6 * 3600 THEN 1 ELSE 0 END AS late FROM a), n AS (SELECT *, sum(late) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ep FROM g)
SELECT base, round(any_value(th), 6) AS threshold, count(*) AS n_alarms, count(DISTINCT ep) AS n_episodes FROM n GROUP BY 1""")
def m18(spark: SparkSession, d: str) -> DataFrame:
    """Every source by itself in one plan: reference, a gap of a day, threshold, alarms, episodes."""
    z = stats.robust_z(hourly(spark, d), _ref(), ["base"], "value")
    th = stats.adaptive_threshold(z, ["base"], "z", 0.9, 1.0, _ref())
    later = F.col("t") >= F.lit("2024-01-12 00:00:00").cast("timestamp")
    a = z.join(th, "base").where(later & (F.col("z") >= F.col("threshold") - 1e-12))
    e = frames.episodes(a, ["base"], "t", 6 * 3600).groupBy("base").agg(F.count("*").alias("n_episodes"))
    n = a.groupBy("base", "threshold").agg(F.count("*").alias("n_alarms"))
    return n.join(e, "base").select("base", r("threshold").alias("threshold"), "n_alarms", "n_episodes")


BANK = {"base": {}, "strict": {"cut": 0.6}, "loose": {"cut": 0.35}, "strict_long": {"cut": 0.6, "least": 4}, "long": {"least": 4}, "loose_short": {"cut": 0.35, "least": 2}}
BANK_SQL = "bank AS (SELECT * FROM (VALUES ('base', 0.5, 3, 0), ('strict', 0.6, 3, 1), ('loose', 0.35, 3, 1), ('strict_long', 0.6, 4, 2), ('long', 0.5, 4, 1), ('loose_short', 0.35, 2, 2)) b(candidate, cut, least, distance))"


def _bank(spark: SparkSession) -> DataFrame:
    """Named candidates: the base configuration with a few settings changed, and how many were changed."""
    return metrics.candidate_bank(spark, {"cut": 0.5, "least": 3}, BANK)


@query("m19_candidate_bank", f"WITH {PREDICTIONS}, {BANK_SQL}, v AS (SELECT doc_id, candidate, cut, least, distance, count(*) FILTER (WHERE probability >= cut) >= least AS hit FROM p, bank GROUP BY doc_id, candidate, cut, least, distance) SELECT candidate, CAST(cut AS DOUBLE) AS cut, CAST(least AS DOUBLE) AS least, distance, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hits FROM v GROUP BY candidate, cut, least, distance")
def m19(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate of the bank with the number of documents that it flags."""
    v = predictions(spark, d).crossJoin(F.broadcast(_bank(spark)))  # a few candidates
    v = v.groupBy("doc_id", "candidate", "cut", "least", "distance").agg((F.count_if(F.col("probability") >= F.col("cut")) >= F.col("least")).alias("hit"))
    return v.groupBy("candidate", "cut", "least", "distance").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hits"))


RUN = f"""{PREDICTIONS}, {BANK_SQL}, v AS (SELECT doc_id, any_value(actual) AS actual, candidate, any_value(distance) AS distance, CAST(count(*) FILTER (WHERE probability >= cut) >= any_value(least) AS INTEGER) AS hit FROM p, bank GROUP BY doc_id, candidate),
m AS (SELECT candidate, any_value(distance) AS distance, doc_id % 3 = 0 AS held, count(*) FILTER (WHERE actual = 1 AND hit = 1) / count(*) FILTER (WHERE actual = 1) AS recall, count(*) FILTER (WHERE actual = 0 AND hit = 1) / count(*) FILTER (WHERE actual = 0) AS fpr FROM v GROUP BY candidate, held)"""


@query("m20_held_out_run", f"WITH {RUN}, dev AS (SELECT *, row_number() OVER (ORDER BY CAST(recall >= 0.6 AND fpr <= 0.5 AS INTEGER) DESC, round(greatest(0, 0.6 - recall) + greatest(0, fpr - 0.5), 9), round(recall, 9) DESC, distance, candidate) AS rank FROM m WHERE NOT held) SELECT dev.candidate, rank, round(dev.recall, 6) AS dev_recall, round(dev.fpr, 6) AS dev_fpr, round(m.recall, 6) AS held_recall, round(m.fpr, 6) AS held_fpr FROM dev JOIN m ON m.candidate = dev.candidate AND m.held")
def m20(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are rated on two thirds of the documents, and scored on the third that is held out."""
    # a bank is a handful of rows
    v = predictions(spark, d).crossJoin(F.broadcast(_bank(spark)))
    v = v.groupBy("doc_id", "actual", "candidate", "distance", "least").agg(F.count_if(F.col("probability") >= F.col("cut")).alias("n")).withColumn("hit", (F.col("n") >= F.col("least")).cast("int"))
    m = metrics.confusion(v.withColumn("held", F.col("doc_id") % 3 == 0), ["candidate", "distance", "held"], "actual", "hit")
    dev = metrics.rank_candidates(m.where("not held"), {"recall": (0.6, "least"), "fpr": (0.5, "most")}, [F.desc(F.round("recall", 9)), "distance", "candidate"])
    held = m.where("held").select("candidate", F.col("recall").alias("h_recall"), F.col("fpr").alias("h_fpr"))
    return dev.join(held, "candidate").select("candidate", F.col("rank").cast("bigint").alias("rank"), r("recall").alias("dev_recall"), r("fpr").alias("dev_fpr"), r("h_recall").alias("held_recall"), r("h_fpr").alias("held_fpr"))


@query("m21_transformed_windows", f"WITH {HOURLY}, v AS (SELECT base, t, pos, CASE WHEN pos % 5 <> 0 AND pos > 2 THEN value END AS v FROM h), k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1 FROM v WINDOW b AS ({W} ROWS UNBOUNDED PRECEDING), a AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), f AS (SELECT base, t, coalesce(v, CASE WHEN p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, v0, v1) AS x FROM k), s AS (SELECT base, avg(x) AS m, stddev_pop(x) AS sd FROM f GROUP BY 1) SELECT base, {T}, round(greatest(-3, least(3, (x - m) / sd)), 5) AS scaled FROM f JOIN s USING (base)")
def m21(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("v", F.when((F.col("pos") % 5 != 0) & (F.col("pos") > 2), F.col("value")))
    x = ml.scale_channels(frames.interpolate(h, "v", ["base"], ["t"], "filled").select("base", "t", "filled"), ["base"], "filled", 3.0)
    return x.select("base", sec("t").alias("t"), F.round("scaled", 5).alias("scaled"))


@query("f01_row_functions", "SELECT event_id, upper(event_type) || ':' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS label FROM events")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, "event_id", "event_type", "value").select("event_id", F.concat_ws(":", F.upper("event_type"), F.floor(F.col("value") / 10).cast("string")).alias("label"))


@query("f02_mapped_columns", "SELECT event_id, CASE event_type WHEN 'error' THEN 'anomaly' ELSE 'normal' END AS label, regexp_replace(CAST(event_id AS VARCHAR) || '.0', '\\.0$', '') AS id FROM events")
def f02(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "event_type")
    return e.select("event_id", scalars.label_text(F.when(F.col("event_type") == "error", "fault").otherwise("healthy")).alias("label"), scalars.identifier(F.concat(F.col("event_id").cast("string"), F.lit(".0"))).alias("id"))


@query("f03_group_functions", "SELECT user_id, count(*) AS n, round(max(value) - min(value), 6) AS spread, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS kinds FROM events GROUP BY 1")
def f03(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d, "user_id", "event_type", "value").groupBy("user_id")
    return g.agg(F.count("*").alias("n"), r(F.max("value") - F.min("value")).alias("spread"), F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))


@query("f04_row_generating", "SELECT event_id, CAST(k AS BIGINT) AS step, CAST(floor(epoch(ts)) AS BIGINT) + k * 600 AS t FROM events, (SELECT unnest(generate_series(0, 5)) AS k) WHERE k <= event_id % 6")
def f04(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d, "event_id", "ts")
    x = e.select("event_id", sec("ts").alias("s"), F.explode(F.sequence(F.lit(0), (F.col("event_id") % 6).cast("int"))).alias("step"))
    return x.select("event_id", F.col("step").cast("bigint").alias("step"), (F.col("s") + F.col("step") * 600).alias("t"))


@query("f05_stateful_class", f"WITH RECURSIVE {HOURLY}, e(base, pos, level, ups) AS (SELECT base, pos, value, 0 FROM h WHERE pos = 1 UNION ALL SELECT h.base, h.pos, greatest(h.value, e.level * 0.99::DOUBLE), e.ups + CASE WHEN h.value > e.level * 0.99::DOUBLE THEN 1 ELSE 0 END FROM e JOIN h ON h.base = e.base AND h.pos = e.pos + 1) SELECT base, pos, round(level, 5) AS level, ups FROM e")
def f05(spark: SparkSession, d: str) -> DataFrame:
    """A user's stateful object over each source's rows: a peak that decays."""
    from ..streaming.causal import stateful

    class Peak:
        def __init__(self):
            self.level, self.ups = None, 0

        def __call__(self, row):
            value = float(row["value"])
            if self.level is not None:
                decayed = self.level * 0.99
                self.ups += value > decayed
                value = max(value, decayed)
            self.level = value
            return {"level": value, "ups": self.ups}

    x = stateful(hourly(spark, d).select("base", "pos", "value"), ["base"], "pos", Peak, "level double, ups int")
    return x.select("base", F.col("pos").cast("bigint").alias("pos"), F.round("level", 5).alias("level"), "ups")
