"""Batch replay and streaming query around the online step.

Input is long in time and wide in signals: (source, ts, status, values map<string,double>). A source is one group, as
its state is a recurrence; sources run in parallel. A source that fails yields one row with its error and doesn't stop
the others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .step import State, StreamConfig, finish, step

ROW_SCHEMA = "source string, ts timestamp, warmup_complete boolean, state string, mode string, score double, active boolean, review boolean, families string, short_fraction double, extreme_fraction double, missing double, frozen double, gap_minutes double, episode int, episode_start timestamp, episode_end timestamp, right_censored boolean, error string"


def layout(signals: Sequence[str], power: Sequence[str], groups: dict[str, Sequence[str]]) -> dict[str, Any]:
    """How a row's values lie in arrays: signal numbers by base name, power positions, groups of signals."""
    import re

    base = [re.sub("_(avg|max|min|std)$", "", s) for s in signals]
    names = sorted(set(base))
    number = {b: i for i, b in enumerate(names)}
    return {"signals": list(signals), "bases": np.array([number[b] for b in base], int), "power": np.array([i for i, s in enumerate(signals) if s in set(power)], int), "groups": {g: np.array([number[b] for b in m if b in number], int) for g, m in groups.items()}}


def _run(source: str, pdf: pd.DataFrame, state: State, lay: dict[str, Any], cfg: StreamConfig, end: bool) -> list[dict]:
    rows = []
    fixed = {k: lay[k] for k in ("bases", "power", "groups")}
    for ts, status, values in zip(pdf["ts"], pdf["status"], pdf["values"], strict=True):
        v = dict(values)
        out = step(state, {"time": ts.timestamp(), "status": status, "x": np.array([v.get(s, np.nan) if v.get(s) is not None else np.nan for s in lay["signals"]], float), **fixed}, cfg)
        rows.append({**out, "source": source, "ts": ts})
    if end and rows and (last := finish(state, True)):
        rows[-1]["closed"] = last
    for r in rows:
        if e := r.pop("closed", None):
            r |= {"episode": e["episode"], "episode_start": pd.Timestamp(e["start"], unit="s"), "episode_end": pd.Timestamp(e["end"], unit="s"), "right_censored": e["right_censored"]}
    return rows


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Output rows in the schema's columns, each as plain objects, floats or times."""
    kinds = {"string": str, "boolean": bool, "int": int}
    out = {}
    for spec in ROW_SCHEMA.split(","):
        name, kind = spec.split()
        values = [r.get(name) for r in rows]
        if kind == "double":
            out[name] = pd.Series([np.nan if v is None else float(v) for v in values], dtype="float64")
        elif kind == "timestamp":
            out[name] = pd.Series(pd.to_datetime(pd.Series(values, dtype=object)), dtype="datetime64[ns]")
        else:
            out[name] = pd.Series([None if v is None else kinds[kind](v) for v in values], dtype=object)
    return pd.DataFrame(out)


def in_order(df: DataFrame) -> DataFrame:
    """One row for each source and time: of several the last by status, then values. Order is put in by the replay."""
    return df.groupBy("source", "ts").agg(F.max_by(F.struct("status", "values"), F.struct(F.coalesce("status", F.lit("")), F.to_json("values"))).alias("x")).select("source", "ts", "x.*")


def manifest(rows: DataFrame) -> DataFrame:
    """(source, n_rows, n_episodes, failed, error) of replayed row scores."""
    return rows.groupBy("source").agg(F.count("ts").alias("n_rows"), F.count("episode").alias("n_episodes"), (F.count("error") > 0).alias("failed"), F.max("error").alias("error"))


def replay(df: DataFrame, signals: Sequence[str], power: Sequence[str] = (), groups: dict[str, Sequence[str]] | None = None, cfg: StreamConfig = StreamConfig()) -> DataFrame:
    """Row scores of every source, with an episode's columns in the row that closes it. Of rows with the same time the
    last (by status, then values) counts; the last row closes an open episode as censored."""
    lay = layout(signals, power, groups or {})
    latest = in_order(df)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        try:
            return _frame(_run(source, pdf.sort_values("ts"), State(), lay, cfg, True))
        except Exception as e:  # the error is the source's result; other sources go on
            return _frame([{"source": source, "error": f"{type(e).__name__}: {e}"}])

    return latest.groupBy("source").applyInPandas(run, ROW_SCHEMA)


def stream(df: DataFrame, signals: Sequence[str], power: Sequence[str] = (), groups: dict[str, Sequence[str]] | None = None, cfg: StreamConfig = StreamConfig(), lateness: str = "1 hour") -> DataFrame:
    """The same row scores of a streaming table. A source's rows wait until the watermark has passed them, and are then
    taken in order, of rows with one time the last by status and values: late rows within ``lateness`` count as in the
    replay, later ones are dropped by the watermark. What waits is bounded by the lateness."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    lay = layout(signals, power, groups or {})
    tie = lambda status, values: ("" if status is None else str(status), repr(sorted(dict(values or {}).items())))

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting = pickle.loads(held.get[0]) if held.exists else (State(), {})
        for pdf in batches:
            for ts, status, values in zip(pdf["ts"], pdf["status"], pdf["values"], strict=True):
                old = waiting.get(ts)
                if not ts.timestamp() <= state.last_time and (old is None or tie(*old) < tie(status, values)):
                    waiting[ts] = (status, values)
        mark = held.getCurrentWatermarkMs()
        ready = sorted(t for t in waiting if t.timestamp() * 1000 <= mark)
        rows = []
        if ready:
            taken = [waiting.pop(t) for t in ready]
            rows = _run(key[0], pd.DataFrame({"ts": ready, "status": [x for x, _ in taken], "values": [x for _, x in taken]}), state, lay, cfg, False)
        held.update((pickle.dumps((state, waiting)),))
        if waiting:
            held.setTimeoutTimestamp(max(int(mark) + 1, int(min(waiting).timestamp() * 1000)))
        if rows:
            yield _frame(rows)

    return df.withWatermark("ts", lateness).groupBy("source").applyInPandasWithState(run, ROW_SCHEMA, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def episodes(rows: DataFrame) -> DataFrame:
    """(source, episode, start, end, right_censored) of row scores."""
    return rows.where("episode is not null").select("source", "episode", F.col("episode_start").alias("start"), F.col("episode_end").alias("end"), "right_censored")
