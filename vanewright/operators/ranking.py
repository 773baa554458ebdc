"""Top-k, priority and greedy selections with total orders."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import carried


def top_n(df: DataFrame, key: Sequence[str], by: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank; of the table, without a key, by a bounded sort."""
    if not key:
        first = df.orderBy(*by).limit(n)  # n rows: the rank below is over a bounded set
        return first.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where(F.col(rank) <= n)


def by_priority(names: Column, order: Sequence[str]) -> Column:
    """The first name of ``order`` in an array, else its first entry in sort order, else null."""
    listed = F.array(*map(F.lit, order))
    hits = F.filter(listed, lambda x: F.array_contains(names, x))
    return F.coalesce(F.get(hits, 0), F.get(F.array_sort(names), 0))


def spaced(df: DataFrame, key: Sequence[str], score: str, time: str, ids: str, hours: float, limit: int) -> DataFrame:
    """Greedy selection by falling score: a row within ``hours`` of a chosen one is skipped, at most ``limit`` stay.

    A carried fold over the rows of a key by falling score (ties by id) whose state is at most ``limit`` times.
    """
    rows = df.select(*key, (-F.col(score)).alias("_s"), F.col(ids).alias("_id"), (F.unix_micros(time) / 3.6e9).alias("_t"))
    return carried(rows, key, ["_s", "_id"], lambda: _Spaced(hours, limit), f"_id {df.schema[ids].dataType.simpleString()}, rank int").withColumnRenamed("_id", ids)


class _Spaced:
    def __init__(self, hours: float, limit: int):
        self.hours, self.limit = hours, limit
        self.times: list[float] = []

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        chosen = []
        for i, t in enumerate(rows["_t"].tolist()):
            if len(self.times) >= self.limit:
                break
            if all(abs(t - c) >= self.hours for c in self.times):
                self.times.append(t)
                chosen.append((i, len(self.times)))
        return rows.iloc[[i for i, _ in chosen]][["_id"]].assign(rank=[n for _, n in chosen])

    def end(self) -> None:
        return None


def prune_correlated(order: Sequence[str], corr: dict[tuple[str, str], float], limit: float, closed: bool = False) -> list[str]:
    """Ordered scan that keeps a name if |corr| to all kept ones is below the limit (at most, if closed). A driver-side
    loop over at most a few thousand names."""
    kept: list[str] = []
    for name in order:
        values = [abs(corr.get((name, k), corr.get((k, name), 0.0))) for k in kept]
        if all(v <= limit if closed else v < limit for v in values):
            kept.append(name)
    return kept


def sparsify(edges: DataFrame, k: int, least: float) -> DataFrame:
    """Edges (i, j, weight) of the k strongest neighbours of each node with at least that weight, made symmetric by max."""
    best = top_n(edges.where(F.col("weight") >= least), ["i"], [F.desc("weight"), "j"], k).select("i", "j", "weight")
    return best.union(best.select("j", "i", "weight")).groupBy("i", "j").agg(F.max("weight").alias("weight"))


def normalised(edges: DataFrame) -> DataFrame:
    """D^-1/2 (S + I) D^-1/2 of a symmetric edge table."""
    nodes = edges.select("i").union(edges.select("j")).distinct()
    full = edges.where("i <> j").union(nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("weight")))
    degree = full.groupBy("i").agg(F.sum("weight").alias("d"))
    return full.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))
