"""Readers of the monitoring tables: delimited files, JSON lines, manifests, parquet.

Paths go through Spark only, so they can be in any store. A delimiter is told from the first line; columns are text
until a caller coerces them, so that a bad cell is a null and not a failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.frames import dedup_time

DELIMITERS = (";", ",", "\t")
#: Aliases of logical columns (fixed values).
ALIASES = {
    "time": ("time_stamp", "timestamp", "time", "ts"),
    "asset": ("asset_id", "asset", "turbine_id"),
    "id": ("id", "row_id"),
    "event_id": ("event_id", "id"),
    "label": ("event_label", "label"),
    "start": ("event_start", "start", "start_time"),
    "end": ("event_end", "end", "end_time"),
    "start_id": ("event_start_id", "start_id"),
    "end_id": ("event_end_id", "end_id"),
    "description": ("event_description", "description"),
    "sensor": ("sensor_name", "sensor", "name"),
    "status": ("status_type_id", "status"),
}


def sniff(spark: SparkSession, path: str, delimiters: Sequence[str] = DELIMITERS) -> str:
    """The first delimiter that splits the first line; the first one if none does."""
    line = spark.read.text(path).limit(1).collect()
    head = line[0][0] if line else ""
    return next((d for d in delimiters if d in head), delimiters[0])


def read_delimited(spark: SparkSession, path: str, delimiters: Sequence[str] = DELIMITERS) -> DataFrame:
    """All columns as text, with trimmed names."""
    df = spark.read.option("header", True).option("sep", sniff(spark, path, delimiters)).csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def require(df: DataFrame, logical: Sequence[str]) -> dict[str, str]:
    """The columns that answer to logical names; raises where one is missing."""
    return {name: scalars.find_column(df.columns, ALIASES[name], required=True) for name in logical}  # type: ignore[misc]


def timestamp(c: Column) -> Column:
    return c.cast("string").try_cast("timestamp")


def measurement_columns(columns: Sequence[str], mode: str = "all", excluded: Sequence[str] = ()) -> list[str]:
    """Columns with a statistic's suffix: avg_only, avg_std or all; bases in ``excluded`` are left out."""
    wanted = {"avg_only": ("avg",), "avg_std": ("avg", "std"), "all": scalars.STAT_SUFFIXES}[mode]
    out = []
    for c in columns:
        base, _, stat = c.rpartition("_")
        if stat in wanted and base and base not in excluded:
            out.append(c)
    return out


def valid_columns(df: DataFrame, columns: Sequence[str], least: float = 0.5) -> list[str]:
    """Columns whose share of finite numbers reaches ``least``: one aggregation over all of them."""
    if not columns:
        return []
    row = df.agg(F.count("*").alias("n"), *(F.count(scalars.number(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if row["n"] and row[f"c{i}"] >= least * row["n"]]


def read_series(spark: SparkSession, path: str, keep: str = "last", mode: str = "all") -> DataFrame:
    """(asset, ts, id, status, <measurements double>): rows without a time or id go, one row stays for each time."""
    raw = read_delimited(spark, path)
    names = require(raw, ["time", "asset", "id"])
    status = scalars.find_column(raw.columns, ALIASES["status"])
    cols = measurement_columns(raw.columns, mode)
    df = raw.select(F.col(names["asset"]).alias("asset"), timestamp(F.col(names["time"])).alias("ts"), F.col(names["id"]).try_cast("int").alias("id"), (scalars.status_token(F.col(status)) if status else F.lit("")).alias("status"), *(scalars.number(F.col(f"`{c}`")).alias(c) for c in cols))
    return dedup_time(df.where("ts is not null and id is not null"), ["asset"], "ts", ["id"], keep)


def long_series(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ("asset", "ts", "id")) -> DataFrame:
    """(key, base, stat, value): one row for each measurement, nulls left out."""
    out = df.unpivot(list(key), list(columns), "name", "value").where("value is not null")
    return out.select(*key, scalars.base_signal(F.col("name")).alias("base"), scalars.statistic(F.col("name")).alias("stat"), "value")


def read_event_info(spark: SparkSession, path: str, farm_id: str = "", strict: bool = False) -> DataFrame:
    """(farm_id, event_id, label, start, end, start_id, end_id, description): invalid intervals go (or fail, if strict),
    of repeated event ids the last by start stays."""
    raw = read_delimited(spark, path)
    names = require(raw, ["event_id", "label", "start", "end"])
    extra = {k: scalars.find_column(raw.columns, ALIASES[k]) for k in ("start_id", "end_id", "description")}
    text = lambda k: F.col(extra[k]) if extra[k] else F.lit(None).cast("string")
    df = raw.select(F.lit(farm_id).alias("farm_id"), scalars.identifier(F.col(names["event_id"])).alias("event_id"), F.lower(F.trim(names["label"])).alias("label"), timestamp(F.col(names["start"])).alias("start"), timestamp(F.col(names["end"])).alias("end"), text("start_id").try_cast("int").alias("start_id"), text("end_id").try_cast("int").alias("end_id"), text("description").alias("description"))
    good = F.col("event_id").isNotNull() & F.col("start").isNotNull() & (F.col("end") > F.col("start"))
    if strict:
        df = df.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("invalid interval of event "), F.coalesce("event_id", F.lit("?")))).cast("boolean")))
    return dedup_time(df.where(good), ["farm_id"], "event_id", ["start", "end"], "last")


def read_feature_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, is_angle, is_counter, unit, statistics_type), by plain name, the first of repeated ones."""
    raw = read_delimited(spark, path)
    sensor = scalars.find_column(raw.columns, ALIASES["sensor"], required=True)
    pick = lambda c: F.col(n) if (n := scalars.find_column(raw.columns, (c,))) else F.lit(None).cast("string")
    df = raw.select(scalars.plain_name(F.col(sensor)).alias("name"), pick("description").alias("description"), scalars.truth(pick("is_angle")).alias("is_angle"), scalars.truth(pick("is_counter")).alias("is_counter"), pick("unit").alias("unit"), pick("statistics_type").alias("statistics_type"), F.monotonically_increasing_id().alias("_at"))
    return df.groupBy("name").agg(F.min_by(F.struct("description", "is_angle", "is_counter", "unit", "statistics_type"), "_at").alias("x")).select("name", "x.*")


def read_parts(spark: SparkSession, combined: str | None, parts: str) -> DataFrame:
    """The combined table if it is there, else the union of the parts under a glob; columns may differ."""
    for path in (combined, parts):
        if path is None:
            continue
        try:
            return read_delimited(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or path == parts:
                raise
    raise AssertionError("unreachable")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a line that is no object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A JSON object, empty if the file is absent."""
    try:
        rows = spark.read.option("multiLine", True).json(path).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return rows[0].asDict(recursive=True) if rows else {}


def pending(df: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among the finished ones: the way to resume."""
    return df.join(done.select(*key).distinct(), list(key), "left_anti")


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that answer to a pattern in any store, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def resolve_one(spark: SparkSession, folder: str, names: Sequence[str], wildcard: str | None = None, required: bool = True) -> str | None:
    """The first of the standard names that is there, else the one path that answers to the wildcard. Several, or none
    if it is required, are an error."""
    for name in names:
        if found := _glob(spark, f"{folder}/{name}"):
            return found[0]
    found = _glob(spark, f"{folder}/{wildcard}") if wildcard else []
    if len(found) > 1 or (required and not found):
        raise FileNotFoundError(f"{len(found)} paths for {list(names)} or {wildcard} in {folder}")
    return found[0] if found else None


def event_names(event_id: str) -> list[str]:
    """Names that an event's file may have."""
    return [f"{event_id}.csv", f"event_{event_id}.csv", f"Event_{event_id}.csv"]


def discover(spark: SparkSession, folder: str, wanted: Sequence[str] | None = None, glob: str = "*.csv") -> dict[str, str]:
    """Paths by stem without an event prefix, all or those wanted."""
    found = {p.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower().removeprefix("event_"): p for p in _glob(spark, f"{folder}/{glob}")}
    return found if wanted is None else {k: v for k, v in found.items() if k in {w.lower().removeprefix("event_") for w in wanted}}


def find_raw(spark: SparkSession, root: str, folders: Sequence[str], stem: str) -> str:
    """A raw file of some spelling of its source's folder: the exact stem if there is one, else the first in order."""
    found = sorted({p for f in folders for suffix in ("csv", "txt") for p in _glob(spark, f"{root}/{f}/*{stem}*.{suffix}")})
    if not found:
        raise FileNotFoundError(f"no file of {stem} below {root}")
    return next((p for p in found if p.rsplit("/", 1)[-1].rsplit(".", 1)[0] == stem), found[0])


def read_row_scores(spark: SparkSession, path: str, time: str, flags: Sequence[str]) -> DataFrame:
    """Row scores with parsed times, rows without one left out, and flags as booleans."""
    df = read_delimited(spark, path)
    return df.withColumns({time: timestamp(F.col(time)), **{f: scalars.truth(F.col(f)) for f in flags if f in df.columns}}).where(F.col(time).isNotNull())


def read_segments(spark: SparkSession, path: str, required: Sequence[str], ids: str = "event_id") -> DataFrame:
    """A table of segments or features: required columns are checked, empty intervals go, of an id the last row stays."""
    df = read_delimited(spark, path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    if {"start", "end"} <= set(df.columns):
        df = df.withColumns({"start": timestamp(F.col("start")), "end": timestamp(F.col("end"))}).where("end > start")
    return dedup_time(df.withColumn("_all", F.lit(0)), ["_all"], ids, [c for c in ("start", "end") if c in df.columns] or [ids], "last").drop("_all")


#: Names that the columns of a warning episode may have (fixed values).
EPISODE_ALIASES = {"start": ("start_time", "episode_start", "start"), "end": ("end_time", "episode_end", "end"), "score": ("max_score", "peak_score", "score")}


def episode_table(df: DataFrame) -> DataFrame:
    """Adds start, end and score of a warning-episode table by their aliases; a missing end, or one before the start, is
    the start."""
    pick = {k: [F.col(c) for c in names if c in df.columns] or [F.lit(None)] for k, names in EPISODE_ALIASES.items()}
    start = F.coalesce(*pick["start"]).cast("timestamp")
    end = F.coalesce(*pick["end"]).cast("timestamp")
    return df.withColumns({"start": start, "end": F.greatest(start, F.coalesce(end, start)), "score": scalars.number(F.coalesce(*pick["score"]))})


def numeric_features(df: DataFrame, denied: Sequence[str] = ()) -> list[str]:
    """Columns that can be read as numbers with two different values or more, without the denied: one aggregation."""
    names = [c for c in df.columns if c not in denied]
    value = lambda c: scalars.number(F.col(f"`{c}`").cast("string"))
    row = df.agg(*(F.min(value(c)).alias(f"a{i}") for i, c in enumerate(names)), *(F.max(value(c)).alias(f"z{i}") for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if row[f"a{i}"] is not None and row[f"a{i}"] != row[f"z{i}"]]


def one_asset(df: DataFrame, asset: str) -> DataFrame:
    """The table; fails at run time if it holds several assets. The check is a one-row aggregation beside it."""
    n = df.agg(F.count_distinct(asset).alias("_assets"))
    sure = F.when(F.col("_assets") > 1, F.raise_error(F.lit("several assets in one event")).cast("boolean")).otherwise(F.lit(True))
    return df.crossJoin(F.broadcast(n)).where(sure).drop("_assets")
