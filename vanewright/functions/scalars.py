"""Scalar column functions: identifiers, names, booleans, labels, safe arithmetic, interval expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

STAT_SUFFIXES = ("avg", "max", "min", "std")
TRUE_WORDS = ("true", "1", "yes", "y", "t")
#: Label synonyms (fixed values).
NORMAL_WORDS = ("normal", "healthy", "0", "false", "no")
ANOMALY_WORDS = ("anomaly", "anomalous", "fault", "faulty", "abnormal", "1", "true", "yes")
#: Subsystems by parts of a signal's description, in order; the first match wins (fixed values).
SUBSYSTEMS = (
    ("dc_link_voltage", ("dc link", "direct current link", "dc-link")),
    ("grid_voltage", ("grid voltage", "line voltage", "mains voltage", "phase voltage", "transformer voltage")),
    ("generator_current", ("generator current", "stator current", "phase current")),
    ("converter_electrical", ("converter", "inverter", "rectifier")),
    ("auxiliary_supply", ("supply voltage", "battery voltage", "control voltage", "cabinet voltage", "auxiliary voltage")),
    ("pitch_axis", ("pitch", "blade", "axis 1", "axis 2", "axis 3", "pitching")),
    ("yaw", ("yaw",)),
    ("gearbox_oil", ("gear oil", "gearbox oil", "oil pump", "oil pressure", "oil level", "lubric")),
    ("gearbox_thermal", ("gearbox temperature", "gear bearing temperature", "gearbox bearing temperature")),
    ("generator_thermal", ("generator temperature", "generator bearing temperature", "stator temperature", "rotor temperature")),
    ("converter_thermal", ("converter temperature", "inverter temperature", "power module temperature")),
    ("cabinet_thermal", ("cabinet temperature", "nacelle temperature", "hub temperature", "ambient cabinet")),
    ("cooling_system", ("cooling", "coolant", "cooler", "heat exchanger", "water pump", "cooling fan")),
    ("hydraulic_brake", ("hydraulic", "brake", "accumulator pressure")),
    ("vibration_mechanical", ("vibration", "acceleration", "shaft", "coupling", "main bearing")),
)
#: Names that are no signals, and parts of names that give the outcome away (fixed values).
NO_SIGNALS = ("time_stamp", "timestamp", "time", "datetime", "date_time", "asset_id", "event_id", "id", "train_test", "status_type_id", "label", "target", "event_label", "event_start", "event_end", "description")
LEAKS = ("fault", "failure", "anomaly", "label", "target", "prediction", "event_")
#: Names of power signals, what excludes one, and the signals of a source whose names don't tell (fixed values).
POWER_NAMES = ("(^|_)power($|_)", "active_power", "generator_power", "electrical_power", "(^|_)pwr($|_)")
NO_POWER_NAMES = ("reactive", "power_factor", "setpoint", "limit", "rated")
POWER_SIGNALS = {"C": ("power_2", "power_5", "power_6", "power_17")}


def identifier(c: Column) -> Column:
    """Trimmed id text without a trailing ``.0``; null stays null."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def status_token(c: Column) -> Column:
    """An identifier where null is the empty text."""
    return F.coalesce(identifier(c), F.lit(""))


def plain_name(c: Column) -> Column:
    """Lower-case name with runs of other characters as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def plain_name_py(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def find_column(columns: Iterable[str], candidates: Sequence[str], required: bool = False) -> str | None:
    """The first candidate that a column answers to, by plain name."""
    by_name = {}
    for c in columns:
        by_name.setdefault(plain_name_py(c), c)
    for want in candidates:
        if (got := by_name.get(plain_name_py(want))) is not None:
            return got
    if required:
        raise ValueError(f"none of the columns {list(candidates)} is present")
    return None


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number(c: Column, default: float | None = None) -> Column:
    """Numeric coercion: what can't be read, NaN and infinities give the default."""
    value = finite(c.try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def truth(c: Column) -> Column:
    """Text boolean; null and unknown texts are false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def label(c: Column) -> Column:
    """1 for anomaly words and numbers over 0, 0 for normal words and numbers up to 0, else null."""
    text = F.lower(F.trim(c.cast("string")))
    n = text.try_cast("double")
    return F.when(text.isin(*ANOMALY_WORDS), 1).when(text.isin(*NORMAL_WORDS), 0).when(n > 0, 1).when(n <= 0, 0)


def base_signal(c: Column) -> Column:
    return F.regexp_replace(c, f"_({'|'.join(STAT_SUFFIXES)})$", "")


def statistic(c: Column) -> Column:
    """The name's statistic, or the empty text."""
    return F.regexp_extract(c, f"_({'|'.join(STAT_SUFFIXES)})$", 1)


def family(c: Column) -> Column:
    """Prefix family; reactive power is looked for before power."""
    return F.when(c.startswith("reactive_power"), "reactive_power").when(c.startswith("wind_speed"), "wind_speed").when(c.startswith("power"), "power").when(c.startswith("sensor"), "sensor").otherwise("other")


def subsystem(description: Column, is_angle: Column | None = None, is_counter: Column | None = None, groups: Sequence[tuple[str, Sequence[str]]] = SUBSYSTEMS) -> Column:
    """The first group one of whose parts occurs in the description; null if none does, and for angles and counters."""
    text = F.lower(F.trim(description))
    no = F.lit(False)
    left_out = F.coalesce(is_angle if is_angle is not None else no, no) | F.coalesce(is_counter if is_counter is not None else no, no)
    out = F.when(left_out, F.lit(None).cast("string"))
    for name, words in groups:
        hit = no
        for w in words:
            hit = hit | text.contains(w)
        out = out.when(hit, name)
    return out


def admissible(name: Column, mode: str = "all") -> Column:
    """Whether a column may be a feature: no identifier, no leak, and of the wanted statistic (avg, avg_std or all)."""
    plain = plain_name(name)
    leak = F.lit(False)
    for part in LEAKS:
        leak = leak | plain.contains(part)
    kind = {"avg": plain.endswith("_avg"), "avg_std": plain.endswith("_avg") | plain.endswith("_std"), "all": F.lit(True)}[mode]
    return ~plain.isin(*NO_SIGNALS) & ~leak & kind


def power_signal(base: Column, source: Column, has_avg: Column) -> Column:
    """Whether a base signal is power: by the source's own list if it has one, else by its name; it needs an average."""
    name = F.lower(base)
    by_name = name.rlike("|".join(POWER_NAMES)) & ~name.rlike("|".join(NO_POWER_NAMES))
    out = None
    for key, listed in POWER_SIGNALS.items():
        out = F.when(source == key, base.isin(*listed)) if out is None else out.when(source == key, base.isin(*listed))
    return has_avg & (by_name if out is None else out.otherwise(by_name))


def label_text(c: Column) -> Column:
    """Labels as "normal" or "anomaly" where they are synonyms, else as they are, in lower case."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*ANOMALY_WORDS), "anomaly").when(text.isin(*NORMAL_WORDS), "normal").otherwise(text)


def period(time: Column, start: Column, end: Column, names: tuple[str, str, str] = ("before", "event", "after"), otherwise: str = "unknown") -> Column:
    """Where a time lies to a closed interval; ``otherwise`` where one of the three is null."""
    known = time.isNotNull() & start.isNotNull() & end.isNotNull()
    return F.when(~known, otherwise).when(time < start, names[0]).when(time <= end, names[1]).otherwise(names[2])


def divide(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, the default where b is zero or null."""
    out = a / F.when(b != 0, b)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def relative_change(old: Column, new: Column, least: float = 1e-9) -> Column:
    """(new - old) / |old|, null where |old| is below ``least``."""
    return F.when(F.abs(old) >= least, (new - old) / F.abs(old))


def consensus(n: Column, fraction: float = 0.75, minimum: int = 2) -> Column:
    """How many of n signals have to agree: min(n, max(minimum, ceil(n * fraction))), one of one."""
    need = F.when(n == 1, 1).otherwise(minimum)
    return F.least(n, F.greatest(need, F.ceil(n * fraction))).cast("int")


def points(hours: float, sampling_minutes: float, least: int = 1) -> int:
    """Hours as a number of rows, rounded half to even."""
    return max(least, round(hours * 60 / sampling_minutes))


def points_column(hours: Column, sampling_minutes: float, least: int = 1) -> Column:
    return F.greatest(F.lit(least), F.bround(hours * 60 / sampling_minutes).cast("int"))


def seconds(c: Column) -> Column:
    """A timestamp as seconds with fraction."""
    return F.unix_micros(c) / 1e6


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def overlap_hours(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), hours_between(F.greatest(a0, b0), F.least(a1, b1)))


def interval_relation(e0: Column, e1: Column, w0: Column, w1: Column, buffer_hours: float) -> Column:
    """How an episode lies to a window: overlap, pre_window, post_window (within the buffer) or unrelated."""
    b = F.expr(f"interval {int(buffer_hours * 3600)} seconds")
    return F.when((e1 >= w0) & (e0 <= w1), "overlap").when((e1 < w0) & (e1 >= w0 - b), "pre_window").when((e0 > w1) & (e0 <= w1 + b), "post_window").otherwise("unrelated")


def families(c: Column) -> Column:
    """A list text split at ``;``, ``,`` and the broken bar: distinct, trimmed, sorted, joined by ``;``."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,¦]+"), lambda x: F.trim(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ";")


def parse_hours(text: str) -> list[float]:
    """A comma list of positive hours."""
    out = [float(x) for x in text.split(",") if x.strip()]
    if not out or any(not math.isfinite(x) or x <= 0 for x in out):
        raise ValueError(f"not a list of positive hours: {text!r}")
    return out


def hours_list(text: Column) -> Column:
    """The positive hours of a comma list, as doubles; what is none is left out."""
    parts = F.transform(F.split(text, ","), lambda x: number(F.trim(x)))
    return F.filter(parts, lambda x: x > 0)
