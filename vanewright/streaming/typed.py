"""The alert's life cycle as a streaming query with typed state.

A source keeps a value (phase, run and times of its episode), a map of latches by name, and a map of rows that wait for
the watermark. A timer stands at the earliest waiting row; when it expires, all rows that the watermark has passed are
taken in the order of time. So rows that come late within the watermark's delay count where they belong, and the stream
gives the rows of the batch folds. A source's state is a few numbers, one latch for each name, and the rows of the delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .latches import Latch, LifeCycle
from .step import StreamConfig

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "source string, at long, phase string, closed boolean, episode int, episode_start long, cluster boolean, fused boolean, targeted string"
#: Evidence of a row: what the detectors say of it; ``groups`` are the subsystems with a new onset, joined by ";".
EVIDENCE = ("trigger", "review", "support", "qualified", "low", "fusion")


class AlertProcessor(StatefulProcessor):
    def __init__(self, cfg: StreamConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cycle = handle.getValueState("cycle", "phase string, run int, last long, start long, episodes int, timer long")
        self.latches = handle.getMapState("latches", "name string", "run int, quiet int, latched boolean")
        self.waiting = handle.getMapState("waiting", "at long", ", ".join(f"{c} boolean" for c in EVIDENCE) + ", groups string")

    def _cycle(self) -> list[Any]:
        return list(self.cycle.get()) if self.cycle.exists() else ["normal", 0, None, None, 0, None]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self._cycle()
        for pdf in rows:
            for at, groups, *flags in zip(pdf["at"].tolist(), pdf["groups"].tolist(), *(pdf[c].tolist() for c in EVIDENCE), strict=True):
                row = (*map(bool, flags), groups or "")
                if state[2] is not None and at <= state[2] or self.waiting.containsKey((at,)) and tuple(self.waiting.getValue((at,))) >= row:
                    continue
                self.waiting.updateValue((at,), row)
                due = at // 1000 + 1
                if state[5] is None or due < state[5]:
                    self.handle.registerTimer(due)
                    state[5] = due
        self.cycle.update(tuple(state))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark, state = timerValues.getCurrentWatermarkInMs() * 1000, self._cycle()
        times = sorted(k[0] for k in self.waiting.keys())
        out = []
        for at in (t for t in times if t <= mark):
            out.append((key[0], at, *self._take(state, at, dict(zip((*EVIDENCE, "groups"), self.waiting.getValue((at,)), strict=True)))))
            self.waiting.removeKey((at,))
            state[2] = at
        state[5] = None
        if rest := [t for t in times if t > mark]:
            state[5] = max(rest[0] // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(state[5])
        self.cycle.update(tuple(state))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"episode": "int32"})

    def _latch(self, name: str, wanted: bool, quiet: bool, confirm: int, quiet_rows: int) -> bool:
        kept = Latch(*self.latches.getValue((name,))) if self.latches.containsKey((name,)) else Latch()
        fires = kept.take(wanted, quiet, confirm, quiet_rows)
        self.latches.updateValue((name,), (kept.run, kept.quiet, kept.latched))
        return fires

    def _take(self, state: list[Any], at: int, row: dict[str, Any]) -> tuple:
        cfg = self.cfg
        groups = {g for g in row["groups"].split(";") if g}
        known = {k[0].removeprefix("group ") for k in self.latches.keys() if k[0].startswith("group ")}
        cluster = self._latch("cluster", row["qualified"], row["low"], 1, cfg.rows(cfg.rearm_hours))
        fused = self._latch("fusion", row["fusion"], not row["fusion"], cfg.fusion_rows, cfg.rows(cfg.fusion_quiet_hours))
        fired = [g for g in sorted(groups | known) if self._latch(f"group {g}", g in groups, g not in groups, cfg.targeted_rows, cfg.rows(cfg.targeted_quiet_hours))]
        cycle = LifeCycle(state[0], state[1])
        closed = cycle.take(row["trigger"], row["review"], row["support"], cfg.recovery_rows, cfg.rows(cfg.merge_hours))
        if state[0] == "normal" and cycle.phase != "normal":
            state[3], state[4] = at, state[4] + 1
        start = state[3]
        if cycle.phase == "normal":
            state[3] = None
        state[0], state[1] = cycle.phase, cycle.run
        return cycle.phase, closed, state[4], -1 if start is None else start, cluster, fused, ";".join(fired)


def alert_stream(rows: DataFrame, cfg: StreamConfig = StreamConfig(), lateness: str = "1 hour") -> DataFrame:
    """(source, at, phase, closed, episode, episode_start, cluster, fused, targeted) of a streaming table (source, ts,
    evidence, groups); times in microseconds, episode_start -1 where there is none. Of rows with one time the largest
    counts; null evidence is false. The session needs the RocksDB state store."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in EVIDENCE]
    x = rows.where("source is not null and ts is not null").withWatermark("ts", lateness)
    x = x.select("source", "ts", F.unix_micros("ts").alias("at"), *flags, F.coalesce("groups", F.lit("")).alias("groups"))
    return x.groupBy("source").transformWithStateInPandas(AlertProcessor(cfg), OUT, "Append", "EventTime")


def run_available(spark: SparkSession, rows: DataFrame, root: str, cfg: StreamConfig = StreamConfig(), lateness: str = "1 hour", files: int = 4) -> DataFrame:
    """The alerts of a folder of parquet files (``root``/in), taken a few files at a time until none is left, written to
    ``root``/out. A run that ended early goes on from ``root``/checkpoint."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
        q = alert_stream(source, cfg, lateness).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUT).parquet(f"{root}/out")
