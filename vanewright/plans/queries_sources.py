"""Queries of sources and sinks: each writes a table of the driver's in a format, reads it back and returns what it read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..sources import readers, writers
from ..sources.shared import shared_folder
from .fixtures import HOURLY, REFERENCE, SPANS, events, hourly, predictions, r, sec, spans, table
from .fixtures import PREDICTIONS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
STAMP = "yyyy-MM-dd HH:mm:ss"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _text(c: Column) -> Column:
    return F.date_format(c, STAMP)


@query("s01_semicolon_then_comma", "SELECT 'nation' AS source, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def s01(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s01")
    writers.write_delimited(table(spark, d, "nation").select(F.col("n_nationkey").alias(" id "), F.col("n_name").alias("name ")), f"{at}/nation", ";")
    writers.write_delimited(table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), f"{at}/region", ",")
    both = [readers.read_delimited(spark, f"{at}/{n}", (";", ",")).select(F.lit(n).alias("source"), F.col("id").cast("int").alias("id"), "name") for n in ("nation", "region")]
    return both[0].union(both[1])


@query("s02_semicolon_only", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def s02(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s02")
    writers.write_delimited(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), at, ";")
    return readers.read_delimited(spark, at, (";",)).withColumn("id", F.col("id").cast("int"))


@query("s03_three_delimiters", "SELECT s_suppkey AS id, s_name AS name, unnest(['semicolon', 'comma', 'tab']) AS how FROM supplier")
def s03(spark: SparkSession, d: str) -> DataFrame:
    at, s = shared_folder(spark, "s03"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    out = None
    for how, sep in (("semicolon", ";"), ("comma", ","), ("tab", "\t")):
        writers.write_delimited(s, f"{at}/{how}", sep)
        part = readers.read_delimited(spark, f"{at}/{how}").select(F.col("id").cast("int").alias("id"), "name", F.lit(how).alias("how"))
        out = part if out is None else out.union(part)
    return out


RAW = "SELECT CAST(user_id AS VARCHAR) AS asset, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id AS id, round(value, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor(epoch(ts)) ORDER BY event_id DESC) AS n FROM events WHERE event_id % 10 > 0 AND event_id % 11 > 0) WHERE n = 1"


def _raw(spark: SparkSession, d: str, at: str) -> None:
    """Raw rows as text, a tenth of them without an id and an eleventh with a broken time."""
    i = F.col("event_id")
    e = events(spark, d, "event_id", "user_id", "ts", "value")
    writers.write_delimited(e.select(F.when(i % 11 == 0, "broken").otherwise(_text(F.col("ts"))).alias("time_stamp"), F.col("user_id").alias("asset_id"), F.when(i % 10 == 0, "x").otherwise(i.cast("string")).alias("id"), F.col("value").alias("sensor_1_avg"), F.lit("0").alias("status_type_id")), at, ";")


@query("s04_required_columns", RAW)
def s04(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s04")
    _raw(spark, d, at)
    return readers.read_series(spark, at).select("asset", sec("ts").alias("t"), F.col("id").cast("bigint").alias("id"), r("sensor_1_avg").alias("v"))


@query("s05_range_and_columns", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS v FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def s05(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.frames import single_precision

    at = lambda x: F.lit(x).cast("timestamp")
    e = events(spark, d, "event_id", "ts", "value").where(F.col("ts").between(at("2024-01-05"), at("2024-01-12")))
    return single_precision(e, ["value"]).select("event_id", sec("ts").alias("t"), F.round(F.col("value").cast("double"), 4).alias("v"))


@query("s06_header_only", "SELECT unnest(['sensor_1_avg', 'sensor_1_std', 'power_2_avg']) AS name, unnest(['sensor_1', 'sensor_1', 'power_2']) AS base")
def s06(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s06")
    v = F.col("value")
    writers.write_delimited(events(spark, d, "event_id", "value").select("event_id", v.alias("sensor_1_avg"), v.alias("sensor_1_std"), v.alias("power_2_avg"), v.alias("free")), at)
    names = readers.measurement_columns(readers.read_delimited(spark, at).columns)  # no row is read
    n = spark.createDataFrame([(x,) for x in names], "name string")
    return n.select("name", scalars.base_signal(F.col("name")).alias("base"))


def _by_region(spark: SparkSession, d: str, at: str, name) -> None:
    for k in range(3):
        writers.write_delimited(table(spark, d, "nation").where(F.col("n_regionkey") == k).select("n_nationkey", "n_name"), f"{at}/{name(k)}")


@query("s07_event_file", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey < 3")
def s07(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s07")
    _by_region(spark, d, at, lambda k: ("0.csv", "event_1.csv", "x_2_raw.csv")[k])
    paths = [readers.resolve_one(spark, at, readers.event_names(str(k)), f"*_{k}_*.csv") for k in range(3)]
    return spark.read.option("header", True).csv(paths).select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))


@query("s08_discovered_files", "SELECT CAST(n_regionkey AS VARCHAR) AS stem, n_name AS name FROM nation WHERE n_regionkey IN (0, 2)")
def s08(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s08")
    _by_region(spark, d, at, lambda k: f"Event_{k}.csv")
    out = None
    for stem, path in readers.discover(spark, at, ["event_0", "2"]).items():
        part = readers.read_delimited(spark, path).select(F.lit(stem).alias("stem"), F.col("n_name").alias("name"))
        out = part if out is None else out.union(part)
    return out


@query("s09_raw_file", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1")
def s09(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s09")
    _by_region(spark, d, at, lambda k: ("Farm C/event_7_old.csv", "farm_c/event_7.csv", "farm_c/event_77.txt")[k])
    return readers.read_delimited(spark, readers.find_raw(spark, at, ("Farm C", "FarmC", "farm_c"), "event_7")).select(F.col("n_nationkey").cast("int").alias("id"))


@query("s10_event_info", f"WITH {SPANS} SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'error' THEN 'anomaly' ELSE 'normal' END AS label, CAST(floor(epoch(s)) AS BIGINT) AS start, CAST(floor(epoch(e)) AS BIGINT) AS end FROM spans WHERE event_id % 12 > 0 AND event_id % 5 > 0")
def s10(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s10")
    i = F.col("event_id")
    x = spans(spark, d).select(F.concat(i.cast("string"), F.lit(".0")).alias("event_id"), F.when(F.col("event_type") == "error", " Anomaly").otherwise("NORMAL ").alias("event_label"), F.when(i % 5 == 0, "?").otherwise(_text(F.col("start"))).alias("event_start"), _text(F.col("end")).alias("event_end"))
    writers.write_delimited(x, at, ";")
    return readers.read_event_info(spark, at, "C").select("event_id", "label", sec("start").alias("start"), sec("end").alias("end"))


@query("s11_feature_descriptions", "SELECT trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS name, min(p_name) AS description, bool_and(true) AS is_angle FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand) GROUP BY 1")
def s11(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s11")
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("sensor_name"), F.col("p_name").alias("description"), F.lit("Yes").alias("is_angle"))
    writers.write_delimited(p.coalesce(1).sortWithinPartitions("p_partkey").drop("p_partkey"), at)
    return readers.read_feature_descriptions(spark, at).select("name", "description", "is_angle")


@query("s12_episode_parts", f"WITH {SPANS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM spans")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose columns differ, one of them empty; there is no combined table."""
    at = shared_folder(spark, "s12")
    s = spans(spark, d)
    writers.write_json_lines(s.where("event_id % 2 = 0").select("event_id", F.col("event_type").alias("kind")), f"{at}/part_a")
    writers.write_json_lines(s.where("event_id % 2 = 1").select("event_id"), f"{at}/part_b")
    writers.write_json_lines(s.where("false").select("event_id"), f"{at}/part_c")
    return readers.read_json_lines(spark, f"{at}/part_*", "event_id long, kind string")


@query("s13_row_scores", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id % 3 = 0 AS flag, event_id % 4 = 1 AS active FROM events WHERE event_id % 13 > 0")
def s13(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s13")
    i = F.col("event_id")
    writers.write_delimited(events(spark, d, "event_id", "ts").select("event_id", F.when(i % 13 == 0, "").otherwise(_text(F.col("ts"))).alias("timestamp"), F.when(i % 3 == 0, "TRUE").otherwise("False").alias("flag"), F.when(i % 4 == 1, "1").alias("active")), at)
    x = readers.read_row_scores(spark, at, "timestamp", ["flag", "active", "absent"])
    return x.select(F.col("event_id").cast("bigint").alias("event_id"), sec("timestamp").alias("t"), "flag", "active")


@query("s14_segment_table", f"WITH {SPANS}, x AS (SELECT event_id // 2 AS id, s, e, event_id FROM spans WHERE event_id % 12 > 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY epoch_us(date_trunc('second', s)) DESC, epoch_us(date_trunc('second', e)) DESC) AS n FROM x) SELECT id, CAST(floor(epoch(s)) AS BIGINT) AS start FROM k WHERE n = 1")
def s14(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s14")
    writers.write_delimited(spans(spark, d).select(F.floor(F.col("event_id") / 2).alias("event_id"), _text(F.col("start")).alias("start"), _text(F.col("end")).alias("end")), at)
    return readers.read_segments(spark, at, ["event_id", "start", "end"]).select(F.col("event_id").cast("bigint").alias("id"), sec("start").alias("start"))


@query("s15_stored_predictions", f"WITH {PREDICTIONS} SELECT doc_id, repeat, round(probability, 6) AS probability, actual FROM p")
def s15(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s15")
    writers.write_delimited(predictions(spark, d).select(F.concat_ws("-", "doc_id", "repeat").alias("key"), "doc_id", "repeat", "probability", "actual"), at)
    x = readers.read_segments(spark, at, ["key", "doc_id", "probability", "actual"], "key")
    return x.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("repeat").cast("int").alias("repeat"), r(scalars.number(F.col("probability"))).alias("probability"), F.col("actual").cast("int").alias("actual"))


@query("s16_early_warning_index", "SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderkey % 3 > 0 AS available, CASE WHEN o_orderkey % 3 > 0 THEN c_name ELSE 'unknown' END AS asset FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Stored results as an index: labels are left behind, and assets come by a left join."""
    at = shared_folder(spark, "s16")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("asset_key"), F.lit("anomaly").alias("event_label"), F.when(F.col("o_orderkey") % 3 > 0, "yes").otherwise("no").alias("available"))
    writers.write_delimited(o, f"{at}/index")
    writers.write_delimited(table(spark, d, "customer").select(F.col("c_custkey").alias("asset_key"), F.col("c_name").alias("asset")), f"{at}/assets")
    index = readers.read_delimited(spark, f"{at}/index").drop("event_label").withColumn("available", scalars.truth(F.col("available")))
    j = index.join(readers.read_delimited(spark, f"{at}/assets"), "asset_key", "left")
    return j.select(scalars.identifier(F.col("event_id")).alias("event_id"), "available", F.when(F.col("available"), F.col("asset")).otherwise("unknown").alias("asset"))


@query("s17_episode_aliases", f"WITH {SPANS} SELECT event_id, CAST(floor(epoch(s)) AS BIGINT) AS start, CAST(floor(epoch(CASE WHEN event_id % 4 < 2 THEN s ELSE e END)) AS BIGINT) AS end, round(event_id / 8.0, 6) AS score FROM spans")
def s17(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s17")
    i = F.col("event_id")
    early = F.col("start") - F.expr("interval 1 hour")
    writers.write_delimited(spans(spark, d).select("event_id", _text(F.col("start")).alias("episode_start"), F.when(i % 4 == 1, _text(early)).when(i % 4 > 1, _text(F.col("end"))).alias("episode_end"), (i / 8.0).alias("peak_score")), at)
    x = readers.episode_table(readers.read_delimited(spark, at))
    return x.select(F.col("event_id").cast("bigint").alias("event_id"), sec("start").alias("start"), sec("end").alias("end"), r("score").alias("score"))


@query("s18_json_lines", "SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_id % 5 > 0")
def s18(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s18")
    e = events(spark, d, "event_id", "event_type", "value")
    writers.write_json_lines(e, at)
    x = readers.read_json_lines(spark, at, "event_id long, event_type string, value double")
    return readers.pending(x, e.where("event_id % 5 = 0"), ["event_id"]).select("event_id", "event_type", r("value").alias("value"))


@query("s19_manifest", "SELECT count(*) AS n_rows, NULL::DOUBLE AS bad, 'none' AS absent FROM orders")
def s19(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s19")
    writers.write_manifest(spark, {"n_rows": table(spark, d, "orders").count(), "bad": float("nan")}, f"{at}/m")
    m, absent = readers.read_manifest(spark, f"{at}/m"), readers.read_manifest(spark, f"{at}/nothing")
    return spark.createDataFrame([(m["n_rows"], m.get("bad"), "some" if absent else "none")], "n_rows long, bad double, absent string")


@query("s20_result_file", "SELECT 'wildcard' AS how, r_regionkey AS id FROM region UNION ALL SELECT 'absent', -1")
def s20(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s20")
    writers.write_delimited(table(spark, d, "region").select("r_regionkey"), f"{at}/run_7_results.csv")
    found = readers.resolve_one(spark, at, ["results.csv"], "*_results.csv")
    none = readers.resolve_one(spark, at, ["other.csv"], "*_other.csv", required=False)
    rest = spark.createDataFrame([("absent" if none is None else none, -1)], "how string, id int")
    return readers.read_delimited(spark, found).select(F.lit("wildcard").alias("how"), F.col("r_regionkey").cast("int").alias("id")).union(rest)


@query("s21_event_projection", "SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, max(event_id) AS id FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND event_id % 10 > 0 AND event_id % 11 > 0 GROUP BY 1")
def s21(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "s21")
    _raw(spark, d, at)
    s = readers.read_series(spark, at, mode="avg_only").select("asset", "ts", "id")
    first = s.agg(F.min(F.col("asset").cast("bigint")).alias("a"))
    mine = s.join(F.broadcast(first), F.col("asset").cast("bigint") == F.col("a"), "left_semi")
    return readers.one_asset(mine, "asset").select(sec("ts").alias("t"), F.col("id").cast("bigint").alias("id"))


@query("s22_numeric_features", "SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']) AS name")
def s22(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_orderkey", "l_returnflag", F.lit(7).alias("constant"), F.lit("x").alias("text"))
    return spark.createDataFrame([(n,) for n in readers.numeric_features(x, ["l_orderkey"])], "name string")


@query("k01_delimited_sink", "SELECT o_orderkey AS id, round(o_totalprice, 2) AS total, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice / 3, 4) END AS part FROM orders")
def k01(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "k01")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("total"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double") / 3).alias("part"))
    writers.write_delimited(o, at)
    x = readers.read_delimited(spark, at)
    return x.select(F.col("id").cast("bigint").alias("id"), F.round(scalars.number(F.col("total")), 2).alias("total"), F.round(scalars.number(F.col("part")), 4).alias("part"))


@query("k02_manifest_sink", "SELECT 'n_parts' AS key, CAST(count(*) AS VARCHAR) AS value FROM part UNION ALL SELECT 'worst', NULL UNION ALL SELECT 'first', '2024-01-01T00:00:00' UNION ALL SELECT 'names', '[\"a\",\"b\"]'")
def k02(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    at = shared_folder(spark, "k02")
    writers.write_manifest(spark, {"n_parts": table(spark, d, "part").count(), "worst": float("-inf"), "first": dt.datetime(2024, 1, 1), "names": {"b", "a"}}, at)
    m = spark.read.text(at, wholetext=True).select(F.from_json("value", "n_parts string, worst string, first string, names string").alias("m")).select("m.*")
    return m.unpivot([], ["n_parts", "worst", "first", "names"], "key", "value")


@query("k03_json_lines_append", "SELECT event_id, event_type FROM events")
def k03(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "k03")
    e = events(spark, d, "event_id", "event_type")
    for k in (0, 1):
        writers.write_json_lines(e.where(F.col("event_id") % 2 == k), at)
    return readers.read_json_lines(spark, at, "event_id long, event_type string")


@query("k04_row_cache", "SELECT l_suppkey % 5 AS candidate, count(*) AS n FROM lineitem GROUP BY 1")
def k04(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over growing sets of candidates; none is written twice."""
    at = shared_folder(spark, "k04")
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("int").alias("candidate"), "l_orderkey")
    for most in (2, 4, 5):
        writers.append_rows(x.where(F.col("candidate") < most), at, "candidate")
    return spark.read.parquet(at).groupBy("candidate").agg(F.count("*").alias("n"))


@query("k05_report", "WITH n AS (SELECT n_regionkey AS k, count(*) AS c FROM nation GROUP BY 1), l AS (SELECT 1 AS i, '# Regions' AS line UNION ALL SELECT 2, '' UNION ALL SELECT 3, '## Nations' UNION ALL SELECT 4, '' UNION ALL SELECT 5, '| region | nations |' UNION ALL SELECT 6, '|---|---|' UNION ALL SELECT 7 + k, '| ' || k || ' | ' || c || ' |' FROM n) SELECT string_agg(line, chr(10) ORDER BY i) AS report FROM l")
def k05(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "k05")
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations")).orderBy("region")
    writers.write_report(spark, writers.report_lines("Regions", [("Nations", n)]), at)
    return spark.read.text(at, wholetext=True).select(F.rtrim(F.col("value"), F.lit("\n")).alias("report"))


@query("k06_plotted_table", f"WITH {HOURLY} SELECT strftime(t, '%Y-%m-%d') AS day, base, round(avg(value), 6) AS mean, round(avg(CAST(value >= 60 AS INTEGER)), 6) AS abnormal_share, t >= {REFERENCE} AS in_event FROM h GROUP BY ALL")
def k06(spark: SparkSession, d: str) -> DataFrame:
    """What a timeline figure shows, as a table."""
    h = hourly(spark, d).withColumn("in_event", F.col("t") >= F.lit("2024-01-11 00:00:00").cast("timestamp"))
    return h.groupBy(F.date_format("t", "yyyy-MM-dd").alias("day"), "base", "in_event").agg(r(F.avg("value")).alias("mean"), r(F.avg((F.col("value") >= 60).cast("int"))).alias("abnormal_share"))


EDGES = "e AS (SELECT l_suppkey % 12 AS i, l_partkey % 12 AS j, CAST(count(*) AS DOUBLE) AS weight FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12 GROUP BY 1, 2), s AS (SELECT i, j, max(weight) AS weight FROM (SELECT i, j, weight FROM e UNION ALL SELECT j, i, weight FROM e) GROUP BY 1, 2)"


@query("k07_graph_sink", f"WITH {EDGES} SELECT i, j, weight FROM s WHERE i < j")
def k07(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "k07")
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 12).alias("i"), (F.col("l_partkey") % 12).alias("j")).where("i <> j")
    e = li.groupBy("i", "j").agg(F.count("*").cast("double").alias("weight"))
    writers.write_graph(e.union(e.select("j", "i", "weight")).groupBy("i", "j").agg(F.max("weight").alias("weight")), at)
    return readers.read_delimited(spark, f"{at}/edges").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("weight").cast("double").alias("weight"))


@query("k08_file_manifest", "SELECT 'event' AS scope, 'event_type=' || event_type AS folder FROM events GROUP BY event_type UNION ALL SELECT 'aggregate', 'figures'")
def k08(spark: SparkSession, d: str) -> DataFrame:
    """The files of an aggregate table and of a table for each event type."""
    at = shared_folder(spark, "k08")
    e = events(spark, d, "event_type", "ts", "value")
    daily = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))
    daily.repartition("event_type").write.partitionBy("event_type").parquet(at)
    daily.groupBy("day").agg(F.avg("mean").alias("mean")).coalesce(1).write.parquet(f"{at}/figures")
    return writers.file_manifest(spark, at, "part-*").select("scope", F.substring_index("name", "/", 1).alias("folder")).distinct()


@query("k09_event_bundle", f"WITH {SPANS} SELECT user_id, 'spans' AS part, count(*) AS n FROM spans GROUP BY 1 UNION ALL SELECT user_id, 'decision', 1 FROM (SELECT DISTINCT user_id FROM events)")
def k09(spark: SparkSession, d: str) -> DataFrame:
    at = shared_folder(spark, "k09")
    s = spans(spark, d)
    writers.write_bundle({"spans": s, "decision": s.select("user_id", F.lit("normal").alias("decision")).distinct()}, at, "user_id")
    parts = [spark.read.parquet(f"{at}/{n}").groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(F.count("*").alias("n")).select("user_id", F.lit(n).alias("part"), "n") for n in ("spans", "decision")]
    return parts[0].union(parts[1])
