"""Causal snapshot features of row scores, by row frames only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import every_kth, future_max, keyed, rolling, run_length, trailing


def snapshots(df: DataFrame, key: Sequence[str], time: str, value: str, flag: str, target: str, windows: Sequence[int], horizon: int, positive_every: int = 1, negative_every: int = 6, history: float = 1.0) -> DataFrame:
    """Features of each kept row: current value, mean, max, std, p95 and flag count over trailing windows, change to
    k rows before, run length of the flag, and whether the target comes within the horizon.

    Rows with too little history go first; then each class is thinned in time order by a counter of its own.
    """
    w = keyed(key, [time])
    df = run_length(df, flag, key, [time], "run_points")
    cols = {"current": F.col(value), "target_ahead": future_max(F.col(target).cast("int"), w, horizon), "_row": F.row_number().over(w)}
    for n in windows:
        f = trailing(w, n)
        cols |= {f"mean_{n}": rolling(F.col(value), f, "mean"), f"max_{n}": rolling(F.col(value), f, "max"), f"std_{n}": F.coalesce(rolling(F.col(value), f, "std"), F.lit(0.0)), f"p95_{n}": rolling(F.col(value), f, "quantile", 1, 0.95), f"count_{n}": F.sum(F.col(flag).cast("int")).over(f), f"delta_{n}": F.col(value) - F.lag(value, n).over(w)}
    out = df.withColumns(cols).where(F.col("_row") >= history * max(windows)).drop("_row")
    k = F.when(F.col("target_ahead") == 1, positive_every).otherwise(negative_every)
    return every_kth(out, [*key, "target_ahead"], [time], k)
