"""Data quality of a source's rows, by row frames: shares of missing and frozen signals, and gaps in time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import run_length


@dataclass(frozen=True)
class QualityLimits:
    """Shares and rows of the data-quality detector (fixed values)."""

    missing_candidate: float = 0.10
    missing_confirmed: float = 0.20
    frozen_candidate: float = 0.70
    frozen_confirmed: float = 0.85
    rows: int = 3
    gap_factor: float = 1.5
    gap_confirmed_minutes: float = 30.0


def data_quality(df: DataFrame, key: Sequence[str], order: str, sampling_minutes: float, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Adds candidate and confirmed to rows (key, order, missing, frozen, gap_minutes, stopped).

    A share is a candidate from its lower limit on, and is confirmed in the third candidate row in a row if it is over
    the upper one. Frozen signals don't count while the source stands still. A gap is a candidate over 1.5 sampling
    intervals and confirmed from half an hour on.
    """
    n = limits
    no = F.lit(False)
    yes = lambda c: F.coalesce(c, no)
    flags = {"_m": yes(F.col("missing") >= n.missing_candidate), "_f": yes((F.col("frozen") >= n.frozen_candidate) & ~F.col("stopped")), "_g": yes(F.col("gap_minutes") > n.gap_factor * sampling_minutes)}
    df = df.withColumns(flags)
    for flag in ("_m", "_f"):
        df = run_length(df, flag, key, [order], f"{flag}_run")
    sure = lambda flag, share, limit: (F.col(f"{flag}_run") >= n.rows) & yes(F.col(share) >= limit)
    confirmed: Column = sure("_m", "missing", n.missing_confirmed) | sure("_f", "frozen", n.frozen_confirmed) | yes(F.col("gap_minutes") >= n.gap_confirmed_minutes)
    return df.withColumns({"candidate": F.col("_m") | F.col("_f") | F.col("_g"), "confirmed": confirmed}).drop("_m", "_f", "_g", "_m_run", "_f_run")
