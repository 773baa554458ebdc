"""Validated and chained equi joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join that fails at run time where a key occurs twice on a side, inside the same plan."""

    def once(df: DataFrame) -> DataFrame:
        values = [c for c in df.columns if c not in key]
        g = df.groupBy(*key).agg(F.count("*").alias("_n"), *(F.first(v).alias(v) for v in values))
        return g.where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"key {list(key)} is not unique")).cast("boolean")).otherwise(F.lit(True))).drop("_n")

    return once(left).join(once(right), list(key))


def left_chain(base: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str]]], zeros: Sequence[str] = ()) -> DataFrame:
    """Left joins one after another; the named columns become 0 where nothing matched."""
    for other, key in others:
        base = base.join(other, list(key), "left")
    return base.na.fill(0, list(zeros)) if zeros else base


def aligned(left: DataFrame, right: DataFrame, key: Sequence[str], l_order: Sequence[str], r_order: Sequence[str]) -> DataFrame:
    """Two tables side by side by row number within a key; the longer one's further rows get nulls. Order columns that
    the tables share come from neither."""
    shared = [c for c in left.columns if c in right.columns and c not in key]

    def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).drop(*shared)

    return numbered(left, l_order).join(numbered(right, r_order), [*key, "n"], "full")
