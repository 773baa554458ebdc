"""Sinks: delimited files, JSON lines, JSON manifests, parquet."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import normalised


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities of number columns as null, for formats that have none."""
    fix = {f.name: F.when(~F.isnan(f"`{f.name}`") & (F.abs(f"`{f.name}`") != float("inf")), F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fix) if fix else df


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Text columns with a header; arrays and structs as JSON."""
    flat = {f.name: F.to_json(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    out = finite_columns(df)
    (out.withColumns(flat) if flat else out).write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    finite_columns(df).write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _native(value: Any) -> Any:
    """What json doesn't know: times as ISO texts, numbers of other libraries as Python's, sets as lists."""
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return sorted(value) if isinstance(value, (set, frozenset)) else value.item()


def manifest_text(value: dict) -> str:
    """JSON of a small object; NaN and infinities, which JSON lacks, are null."""
    plain = json.loads(json.dumps(value, default=_native), parse_constant=lambda name: None)
    return json.dumps(plain, ensure_ascii=False)


def write_manifest(spark: SparkSession, value: dict, path: str) -> None:
    """One small JSON object, by Spark, so that the path can be in any store."""
    spark.createDataFrame([(manifest_text(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_rows(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the cache at ``path`` doesn't hold yet, in a folder for each key; returns how many keys
    were new. A run that was stopped goes on from there."""
    try:
        done = df.sparkSession.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new = df.select(key).distinct().count()
    if new:
        df.write.mode("append").partitionBy(key).parquet(path)
    return new


def report_lines(title: str, sections: Sequence[tuple[str, DataFrame]], limit: int = 50) -> list[str]:
    """Lines of a markdown report: a table of the first ``limit`` rows (a report's feature) for each section."""
    out = [f"# {title}"]
    for name, df in sections:
        rows = df.limit(limit).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return out


def write_report(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """Edges (i, j, weight) of a graph and its normalised form, the edge list from the strongest down."""
    write_delimited(edges.where("i < j").orderBy(F.desc("weight"), "i", "j").coalesce(1), f"{path}/edges", mode="overwrite")
    normalised(edges).write.mode("overwrite").parquet(f"{path}/normalised")


def write_bundle(tables: dict[str, DataFrame], path: str, key: str) -> None:
    """The tables of events, each dealt by the event's key and sorted by it: a filter on the key passes over the pages of
    other events. Files follow from the tables' sizes; a folder for each event would be at least a file for each, which
    takes far longer than the rows, and would read keys back as other types."""
    for name, df in tables.items():
        df.hint("rebalance", key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")


def file_manifest(spark: SparkSession, path: str, glob: str, aggregate: str = "figures") -> DataFrame:
    """(scope, name) of the files under a folder: aggregate below a folder of that name, event elsewhere."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
    name = F.substring_index("path", f"{root}/", -1)
    return files.select(F.when(name.startswith(f"{aggregate}/"), "aggregate").otherwise("event").alias("scope"), name.alias("name"))


def bundle_sink(path: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that writes several tables of each batch exactly once.

    A batch's tables lie in folders of its number, which a repeated batch replaces; its commit is written last, and
    readers see committed batches only. So a run that ends between two tables, or between the commit and the stream's own
    note of it, leaves no row out and none twice when it goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, f"{path}/commits/batch={number}/_SUCCESS"):
            return
        batch.persist()
        try:
            for name, make in tables.items():
                make(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()
        spark.range(1).select(F.lit(1).alias("committed")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={number}")

    return write


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one table of a bundle, of its committed batches, with their batch number in ``batch``."""
    commits = spark.read.parquet(f"{path}/commits").select("batch")
    return spark.read.parquet(f"{path}/{name}").join(F.broadcast(commits), "batch", "left_semi")  # one row a batch


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
