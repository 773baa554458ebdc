"""Small state machines of the online detector. Each keeps a few numbers, so that the replay, the batch folds and the
streaming query share them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Latch:
    """Fires once when its condition has held for ``confirm`` rows in a row, and is armed again after ``quiet_rows`` quiet
    rows in a row. A row first counts as quiet or not, may arm the latch, and then may fire it."""

    run: int = 0
    quiet: int = 0
    latched: bool = False

    def take(self, wanted: bool, quiet: bool, confirm: int, quiet_rows: int) -> bool:
        self.run = self.run + 1 if wanted else 0
        self.quiet = self.quiet + 1 if quiet else 0
        if self.latched and self.quiet >= quiet_rows:
            self.latched, self.quiet = False, 0
        fires = self.run >= confirm and not self.latched
        self.latched = self.latched or fires
        return fires


@dataclass
class LifeCycle:
    """normal, candidate, active_alert, recovery_pending, inactive_pending.

    A trigger opens an alert from any calm phase; review evidence makes a candidate, which goes back to normal in the
    first row without. The row that loses support is the first of the recovery; after ``recovery_rows`` the alert is
    inactive, and after ``merge_rows`` more without a trigger its episode closes.
    """

    phase: str = "normal"
    run: int = 0

    def take(self, trigger: bool, review: bool, support: bool, recovery_rows: int, merge_rows: int) -> bool:
        """Takes a row in; true if an episode closes with it."""
        if self.phase in ("normal", "candidate"):
            self.phase, self.run = ("active_alert", 0) if trigger else ("candidate", self.run + 1) if review else ("normal", 0)
        elif self.phase == "active_alert":
            if not support:
                self.phase, self.run = "recovery_pending", 1
        elif self.phase == "recovery_pending":
            if support:
                self.phase, self.run = "active_alert", 0
            else:
                self.run += 1
                if self.run >= recovery_rows:
                    self.phase, self.run = "inactive_pending", 0
        elif trigger:
            self.phase, self.run = "active_alert", 0
        else:
            self.run += 1
            if self.run >= merge_rows:
                self.phase, self.run = "normal", 0
                return True
        return False


@dataclass
class Confirmation:
    """One-shot confirmation of a stretch of raw rows: within ``window_minutes`` of its start, once it has lasted for
    ``least_rows``, by a support that came since its start. It stays confirmed for ``support_rows``."""

    start: float | None = None
    run: int = 0
    supported: bool = False
    confirmed_at: float | None = None

    def take(self, now: float, raw: bool, support: bool, allowed: bool, least_rows: int, window_minutes: float, support_rows: int, sampling_minutes: float) -> tuple[bool, bool]:
        """(confirms in this row, is confirmed) at the time ``now`` in seconds."""
        self.run = self.run + 1 if raw else 0
        if not raw:
            self.start, self.supported, self.confirmed_at = None, False, None
            return False, False
        if self.start is None:
            self.start, self.supported, self.confirmed_at = now, False, None
        self.supported = self.supported or support
        candidate = self.run >= least_rows
        fires = allowed and candidate and self.confirmed_at is None and (now - self.start) / 60 <= window_minutes and self.supported
        if fires:
            self.confirmed_at = now
        held = self.confirmed_at is not None and round((now - self.confirmed_at) / 60 / sampling_minutes) <= support_rows
        return fires, candidate and held
