"""The online detector: a pure step from (state, row) to (state, output).

The same function serves the batch replay and the streaming query. Within a row the order is fixed: data quality,
operating state, scores from the old baseline, status, subsystems, power, short standstills, persistent, localized and
trend detectors, latches, fusion, life cycle, and last the baseline update and the histories.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from .latches import Confirmation, Latch, LifeCycle
from .quality import QualityLimits


@dataclass(frozen=True)
class StreamConfig:
    """Levels and lengths, in rows where not said otherwise."""

    sampling_minutes: float = 10.0
    warmup: int = 288
    ewma_points: int = 288
    clip: float = 6.0
    level: float = 8.0
    extreme: float = 12.0
    quiet_fraction: float = 0.05
    short_fraction: float = 0.05
    persistent_mean: float = 0.45
    persistent_window: int = 6
    persistent_run: int = 12
    stopped: float = 0.03
    generating: float = 0.15
    debounce: int = 3
    dip_ratio: float = 0.5
    recovery_ratio: float = 0.7
    power_share: float = 0.75
    dip_window: int = 6
    max_dip: int = 12
    stable_rows: int = 3
    pending_minutes: float = 180.0
    independence_minutes: float = 60.0
    windows_hours: tuple[float, float, float] = (2.0, 6.0, 24.0)
    cluster_counts: tuple[int, int, int] = (3, 2, 6)
    busy_counts: tuple[int, int, int] = (4, 3, 8)
    week_hours: float = 168.0
    history_hours: float = 48.0
    busy_share: float = 0.2
    busy_week: int = 20
    rearm_hours: float = 6.0
    rearm_count: int = 1
    status_hours: float = 720.0
    novel_rows: int = 2
    rare_rows: int = 3
    rare_share: float = 0.0005
    burst: int = 4
    semantic_level: float = 6.0
    semantic_onset: float = 0.10
    semantic_chronic: float = 0.20
    fusion_rows: int = 2
    fusion_quiet_hours: float = 12.0
    targeted_level: float = 10.0
    targeted_rows: int = 2
    targeted_quiet_hours: float = 12.0
    targeted_groups: tuple[str, ...] = ()
    localized_least: int = 3
    localized_coverage: float = 0.6
    localized_overlap: float = 0.4
    localized_points: int = 6
    localized_minutes: float = 120.0
    localized_hours: float = 6.0
    trend_hours: float = 6.0
    trend_shift_hours: float = 24.0
    trend_slope: float = 0.25
    trend_shift: float = 2.5
    trend_signals: int = 2
    trend_run: int = 6
    quality: QualityLimits = QualityLimits()
    communication_rows: int = 2
    strong_fraction: float = 0.10
    localized_strength: float = 8.0
    smoothing: int = 3
    support_hours: float = 1.0
    recovery_rows: int = 6
    merge_hours: float = 6.0

    def rows(self, hours: float) -> int:
        return max(1, round(hours * 60 / self.sampling_minutes))


@dataclass
class Baseline:
    """Exponential mean and variance of each signal; the mean's step is clipped, the variance uses the new mean."""

    mean: np.ndarray
    var: np.ndarray

    @classmethod
    def of(cls, history: np.ndarray) -> Baseline:
        with np.errstate(all="ignore"):
            mean = np.nanmedian(history, axis=0)
            scale = 1.4826 * np.nanmedian(np.abs(history - mean), axis=0)
            spread = np.nanpercentile(history, 75, axis=0) - np.nanpercentile(history, 25, axis=0)
            std = np.nanstd(history, axis=0, ddof=1) if len(history) > 1 else np.zeros(history.shape[1])
        for other in (spread / 1.349, std):
            scale = np.where(np.isfinite(scale) & (scale > 1e-9), scale, other)
        return cls(mean, np.where(np.isfinite(scale) & (scale > 1e-9), scale**2, np.nan))

    def z(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return (x - self.mean) / np.sqrt(self.var)

    def update(self, x: np.ndarray, a: float, clip: float) -> None:
        ok = np.isfinite(x) & np.isfinite(self.mean) & np.isfinite(self.var)
        sd = np.sqrt(np.where(ok, self.var, 1.0))
        step = np.clip(np.where(ok, x - self.mean, 0.0), -clip * sd, clip * sd)
        mean = np.where(ok, self.mean + a * step, self.mean)
        self.var = np.where(ok, (1 - a) * self.var + a * (np.where(ok, x, 0.0) - mean) ** 2, self.var)
        self.mean = mean


@dataclass
class PendingStop:
    """A power dip that may turn out to be a short standstill."""

    start: float = math.nan
    dips: int = 0
    stable: int = 0
    reference: float = math.nan
    recovered: bool = False
    last: float = -math.inf

    def update(self, now: float, power: float, reference: float, dip: bool, opens: bool, cfg: StreamConfig) -> bool:
        """Takes a row in; true if it confirms a standstill far enough from the last one."""
        if math.isnan(self.start):
            if dip and opens:
                self.start, self.dips, self.stable, self.reference, self.recovered = now, 1, 0, reference, False
            return False
        if power >= cfg.recovery_ratio * self.reference:
            self.recovered, self.stable = True, self.stable + 1
        elif self.recovered:
            self.stable = 0
        else:
            self.dips += 1
        if self.stable >= cfg.stable_rows:
            self.start = math.nan
            if now - self.last >= cfg.independence_minutes * 60:
                self.last = now
                return True
        elif self.dips > cfg.max_dip or now - self.start > cfg.pending_minutes * 60:
            self.start = math.nan
        return False


@dataclass
class State:
    """What is kept of one source. All histories are bounded by the configuration."""

    seen: int = 0
    warm: list = field(default_factory=list)
    baseline: Baseline | None = None
    power_scale: float = math.nan
    last_x: np.ndarray | None = None
    last_time: float = math.nan
    mode: str = "unknown"
    proposed: deque = field(default_factory=lambda: deque(maxlen=3))
    statuses: deque = field(default_factory=deque)
    status_counts: dict = field(default_factory=dict)
    transitions: deque = field(default_factory=deque)
    last_status: str | None = None
    power: deque = field(default_factory=deque)
    dipped: bool = False
    dip_reference: float = math.nan
    stop: PendingStop = field(default_factory=lambda: PendingStop())
    shorts: deque = field(default_factory=deque)
    background: deque = field(default_factory=deque)
    background_sums: list = field(default_factory=lambda: [0, 0])
    fractions: deque = field(default_factory=deque)
    persistent_run: int = 0
    active_sets: deque = field(default_factory=deque)
    last_active: frozenset = frozenset()
    overlaps: deque = field(default_factory=deque)
    strengths: deque = field(default_factory=deque)
    confirmation: Confirmation = field(default_factory=Confirmation)
    signed: deque = field(default_factory=deque)
    trend_run: int = 0
    cluster: Latch = field(default_factory=Latch)
    fusion: Latch = field(default_factory=Latch)
    groups: dict = field(default_factory=dict)
    group_history: dict = field(default_factory=dict)
    missing_run: int = 0
    frozen_run: int = 0
    comm_run: int = 0
    novel_run: int = 0
    rare_run: int = 0
    last_trigger: float = -math.inf
    cycle: LifeCycle = field(default_factory=LifeCycle)
    episode: dict | None = None
    episodes: int = 0

    @property
    def phase(self) -> str:
        return self.cycle.phase


def _status(s: State, token: str, now: float, cfg: StreamConfig) -> tuple[bool, bool, bool]:
    """(novel, rare, burst) against the history before this row, which then takes the row in."""
    n = len(s.statuses)
    seen = s.status_counts.get(token, 0)
    ready = n >= cfg.rows(cfg.history_hours)
    novel, rare = ready and seen == 0, ready and 0 < seen <= cfg.rare_share * n
    if s.last_status is not None and token != s.last_status:
        s.transitions.append(now)
    while s.transitions and now - s.transitions[0] > 3600:
        s.transitions.popleft()
    s.statuses.append(token)
    s.status_counts[token] = seen + 1
    if len(s.statuses) > cfg.rows(cfg.status_hours):
        old = s.statuses.popleft()
        s.status_counts[old] -= 1
        if not s.status_counts[old]:
            del s.status_counts[old]
    s.last_status = token
    return novel, rare, len(s.transitions) >= cfg.burst


def _need(n: int) -> int:
    return min(n, 8, max(2, math.ceil(0.2 * n)))


def step(s: State, row: dict[str, Any], cfg: StreamConfig) -> dict[str, Any]:
    """One row: ``time`` (seconds), ``x`` (array of signals, NaN for missing), ``bases`` (signal number of each entry),
    ``power`` (positions of power averages), ``groups`` (name to signal numbers), ``status``. Changes the state."""
    now, x = float(row["time"]), np.asarray(row["x"], float)
    bases, power_at, groups = row["bases"], row["power"], row["groups"]
    x = np.where(np.isfinite(x), x, np.nan)
    out: dict[str, Any] = {"time": now, "warmup_complete": False, "state": "warmup", "score": 0.0, "active": False, "review": False, "families": "", "closed": None}
    missing = float(np.isnan(x).mean()) if len(x) else 1.0
    frozen = 0.0 if s.last_x is None or not len(x) else float(np.isclose(x, s.last_x, rtol=1e-9, atol=1e-12).mean())
    gap = 0.0 if math.isnan(s.last_time) else (now - s.last_time) / 60
    s.last_x, s.last_time = x, now
    p = float(np.nanmedian(x[power_at])) if len(power_at) and np.isfinite(x[power_at]).any() else math.nan
    token = "" if row.get("status") is None else str(row["status"])
    s.seen += 1
    out |= {"missing": missing, "frozen": frozen, "gap_minutes": gap}
    if s.seen <= max(12, cfg.warmup):
        s.warm.append((x, p))
        _status(s, token, now, cfg)
        return out
    if s.baseline is None:
        s.baseline = Baseline.of(np.vstack([w[0] for w in s.warm]))
        ps = np.array([w[1] for w in s.warm])
        s.power_scale = abs(float(np.nanpercentile(ps, 90))) if np.isfinite(ps).any() else math.nan
        s.warm = []
    out["warmup_complete"] = True

    # operating state, accepted after equal proposals
    ratio = p / s.power_scale if s.power_scale and math.isfinite(s.power_scale) else math.nan
    proposal = "unknown" if math.isnan(ratio) else "stopped" if ratio < cfg.stopped else "transition" if ratio < cfg.generating else "generating"
    s.proposed.append(proposal)
    if len(s.proposed) >= cfg.debounce and len(set(list(s.proposed)[-cfg.debounce :])) == 1:
        s.mode = proposal

    # scores from the baseline before this row
    z = s.baseline.z(x)
    n = int(bases.max()) + 1 if len(bases) else 0
    base = np.zeros(n)
    np.maximum.at(base, bases, np.where(np.isfinite(z), np.abs(z), 0.0))
    short_fraction, extreme_fraction = (float((base >= v).mean()) if n else 0.0 for v in (cfg.level, cfg.extreme))

    novel, rare, burst = _status(s, token, now, cfg)
    s.novel_run, s.rare_run = s.novel_run + 1 if novel else 0, s.rare_run + 1 if rare else 0
    status_hit = s.novel_run >= cfg.novel_rows or s.rare_run >= cfg.rare_rows

    # subsystems: candidates against the share of earlier rows in which the group was busy
    onset, targeted = [], []
    for name, members in groups.items():
        v = base[members]
        history = s.group_history.setdefault(name, deque(maxlen=cfg.rows(24)))
        busy = int((v >= cfg.semantic_level).sum()) >= _need(len(members)) and s.mode != "transition"
        burden = sum(history) / len(history) if history else 0.0
        new = busy and burden <= cfg.semantic_onset
        if new:
            onset.append(name)
        listed = not cfg.targeted_groups or name in cfg.targeted_groups
        wanted = bool(listed and new and burden < cfg.semantic_chronic and len(v) and v.max() >= cfg.targeted_level)
        if s.groups.setdefault(name, Latch()).take(wanted, not wanted, cfg.targeted_rows, cfg.rows(cfg.targeted_quiet_hours)):
            targeted.append(name)
        history.append(int(busy))

    q = cfg.quality
    s.missing_run = s.missing_run + 1 if missing >= q.missing_candidate else 0
    s.frozen_run = s.frozen_run + 1 if frozen >= q.frozen_candidate and s.mode != "stopped" else 0
    bad_data = (s.missing_run >= q.rows and missing >= q.missing_confirmed) or (s.frozen_run >= q.rows and frozen >= q.frozen_confirmed) or gap >= q.gap_confirmed_minutes
    s.comm_run = s.comm_run + 1 if bad_data and (novel or rare or burst) else 0

    # power: a dip is judged against the median of earlier finite values, its recovery by the next row
    reference = float(np.median(s.power)) if len(s.power) >= 3 else math.nan
    dip = bool(reference > 0 and p <= cfg.dip_ratio * reference)
    recovered = bool(s.dipped and s.dip_reference > 0 and p >= cfg.recovery_ratio * s.dip_reference)
    if math.isfinite(p):
        s.power.append(p)
        if len(s.power) > cfg.dip_window:
            s.power.popleft()

    # short standstills: a dip opens, a stable recovery confirms, time or length cancels
    started = s.stop.update(now, p, reference, dip, short_fraction >= cfg.short_fraction, cfg)
    s.dipped, s.dip_reference = dip, reference if dip else s.dip_reference
    while s.shorts and now - s.shorts[0] > max(cfg.windows_hours) * 3600:
        s.shorts.popleft()
    n_before = len(s.background)
    busy_background = n_before >= cfg.rows(cfg.history_hours) and (s.background_sums[1] >= cfg.busy_share * n_before or s.background_sums[0] >= cfg.busy_week)
    if started:
        s.shorts.append(now)
    counts = [sum(now - t <= h * 3600 for t in s.shorts) for h in cfg.windows_hours]
    needs = cfg.busy_counts if busy_background else cfg.cluster_counts
    over = started and (counts[0] >= needs[0] or (counts[1] >= needs[1] and counts[2] >= needs[2]))

    s.fractions.append(extreme_fraction)
    if len(s.fractions) > cfg.persistent_window:
        s.fractions.popleft()
    high = len(s.fractions) == cfg.persistent_window and sum(s.fractions) / len(s.fractions) >= cfg.persistent_mean
    s.persistent_run = s.persistent_run + 1 if high else 0
    persistent = s.persistent_run >= cfg.persistent_run

    # localized: the same few signals stay active and strong, confirmed by a power dip near the start
    active = frozenset(np.flatnonzero(base >= cfg.level).tolist())
    s.active_sets.append(active)
    if len(s.active_sets) > cfg.persistent_window:
        s.active_sets.popleft()
    union = active | s.last_active
    strongest = np.sort(base)[-cfg.localized_least :]
    for kept, value in ((s.overlaps, len(active & s.last_active) / len(union) if union else 1.0), (s.strengths, float(strongest.mean()) if len(strongest) else 0.0)):
        kept.append(value)
        if len(kept) > cfg.smoothing:
            kept.popleft()
    seen = frozenset().union(*s.active_sets)
    stable = sum(sum(i in a for a in s.active_sets) >= cfg.localized_coverage * len(s.active_sets) for i in seen)
    raw = len(s.active_sets) == cfg.persistent_window and stable >= cfg.localized_least and sum(s.overlaps) / len(s.overlaps) >= cfg.localized_overlap and sum(s.strengths) / len(s.strengths) >= cfg.localized_strength
    s.last_active = active
    _, localized = s.confirmation.take(now, raw, dip, s.mode == "generating", cfg.localized_points, cfg.localized_minutes, cfg.rows(cfg.localized_hours), cfg.sampling_minutes)
    candidate = s.confirmation.run >= cfg.localized_points

    rows, all_rows = max(4, cfg.rows(cfg.trend_hours)), cfg.rows(cfg.trend_shift_hours)
    s.signed.append(np.where(np.isfinite(z), z, 0.0))
    if len(s.signed) > max(all_rows, rows + 1):
        s.signed.popleft()
    rising = 0
    if s.mode == "generating" and len(s.signed) >= rows:
        m = np.vstack(s.signed)
        t = (np.arange(rows) - (rows - 1) / 2) * cfg.sampling_minutes / 60
        slope = t @ m[-rows:] / (t @ t)
        shift = np.median(m[-rows:], axis=0) - (np.median(m[:-rows], axis=0) if len(m) >= max(all_rows, rows + 1) else 0.0)
        rising = int(((np.abs(slope) >= cfg.trend_slope) & (np.abs(shift) >= cfg.trend_shift)).sum())
    s.trend_run = s.trend_run + 1 if rising >= cfg.trend_signals else 0
    trend = s.trend_run >= cfg.trend_run

    # latches fire once and are armed again after a quiet time
    qualified = over and (high or candidate or short_fraction >= cfg.strong_fraction)
    cluster = s.cluster.take(qualified, counts[1] <= cfg.rearm_count and not started, 1, cfg.rows(cfg.rearm_hours))
    corroborated = localized or cluster or (status_hit and (novel or rare))
    wanted = 1 <= len(onset) <= 2 and corroborated
    fused = s.fusion.take(wanted, not wanted, cfg.fusion_rows, cfg.rows(cfg.fusion_quiet_hours))
    onset_hit = 1 <= len(targeted) <= 2
    comm = s.comm_run >= cfg.communication_rows

    # evidence: triggers may open an episode, reviews only mark it
    evidence = {"cluster": (cluster, 0.9), "localized": (localized, 0.95), "fusion": (fused, 0.96), "targeted": (onset_hit, 0.97), "communication": (comm, 0.98)}
    reviews = {"persistent": (persistent, 0.95), "short": (started, 0.6), "status": (status_hit, 0.65), "trend": (trend, 0.58), "semantic": (bool(onset), 0.55), "candidate": (candidate, 0.55)}
    on = [k for k, (v, _) in evidence.items() if v]
    score = max([w for v, w in [*evidence.values(), *reviews.values()] if v], default=0.0)
    if len(on) >= 2:
        score = max(score, min(1.0, 0.55 + 0.2 * len(on)))
    trigger = bool(on)
    review = any(v for v, _ in reviews.values())
    s.last_trigger = now if trigger else s.last_trigger
    support = trigger or now - s.last_trigger <= cfg.support_hours * 3600

    closed = advance(s, now, trigger, review, support, score, on, cfg)
    is_active = s.phase in ("active_alert", "recovery_pending")
    out |= {"state": s.phase, "mode": s.mode, "score": score, "active": is_active, "review": review and not trigger, "families": ";".join(sorted(on)), "short_fraction": short_fraction, "extreme_fraction": extreme_fraction, "closed": closed}

    s.background.append((int(started), int(is_active)))
    s.background_sums = [a + b for a, b in zip(s.background_sums, s.background[-1], strict=True)]
    if len(s.background) > cfg.rows(cfg.week_hours):
        s.background_sums = [a - b for a, b in zip(s.background_sums, s.background.popleft(), strict=True)]
    quiet = s.phase in ("normal", "candidate") and s.mode in ("generating", "stopped") and short_fraction < cfg.quiet_fraction and not trigger
    if quiet:
        s.baseline.update(x, 2 / (cfg.ewma_points + 1), cfg.clip)
    return out


def advance(s: State, now: float, trigger: bool, review: bool, support: bool, score: float, on: list[str], cfg: StreamConfig) -> dict | None:
    """Takes a row into the life cycle and its episode; returns an episode that closes now."""
    before = s.phase
    closes = s.cycle.take(trigger, review, support, cfg.recovery_rows, cfg.rows(cfg.merge_hours))
    if closes:
        return finish(s, False)
    if s.phase == "normal":
        s.episode = None
        return None
    if before == "normal":
        s.episode = {"start": now, "first_active": None, "end": now, "max_score": 0.0, "rows": 0, "families": set()}
    e = s.episode
    if s.phase == "active_alert" and e["first_active"] is None:
        e["first_active"] = now
    if s.phase in ("candidate", "active_alert"):
        e["max_score"] = max(e["max_score"], score)
        e["families"] |= set(on)
        e["rows"] += 1
        if trigger or support or (review and s.phase == "candidate"):
            e["end"] = now
    return None


def finish(s: State, censored: bool) -> dict | None:
    """The open episode as a record, if it ever was active; at the end of a source it is censored."""
    e, s.episode = s.episode, None
    if e is None or e["first_active"] is None:
        return None
    s.episodes += 1
    return {"episode": s.episodes, "start": e["start"], "first_active": e["first_active"], "end": e["end"], "max_score": e["max_score"], "rows": e["rows"], "families": ";".join(sorted(e["families"])), "right_censored": censored}
