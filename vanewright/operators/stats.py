"""Robust statistics of long tables (key, signal, value) and thresholds made from reference rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import attach

MAD = 1.4826
IQR = 1.349
LEAST = 1e-9


#: Accuracy of the sketch that brackets a quantile: it is off by at most one rank in so many.
ACCURACY = 10_000
QUARTILES = (0.25, 0.5, 0.75)


def bracketed_quantiles(df: DataFrame, key: Sequence[str], value: str, qs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(key, n, q): interpolated quantiles, equal to ``percentile``'s, of groups of any size; null values don't count.

    A quantile sketch brackets each quantile. A second pass counts the values below the bracket and the distinct values
    inside, about 4 n / accuracy of a group's n, and running counts tell which of them stand at the wanted ranks. So no
    buffer holds a group's values.
    """
    known = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    slack = 2.0 / accuracy
    ends = [min(1.0, max(0.0, q + s)) for q in qs for s in (-slack, slack)]
    marks = known.groupBy(*key).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_m"))
    marked = attach(known, marks, key)
    low, high = ([F.col("_m")[2 * i + j] for i in range(len(qs))] for j in (0, 1))
    v = F.col("_v")
    outside = marked.groupBy(*key, "_n").agg(
        *(F.count_if(v < low[i]).alias(f"_below{i}") for i in range(len(qs))), *(F.max(F.when(v < low[i], v)).alias(f"_last{i}") for i in range(len(qs))), *(F.min(F.when(v > high[i], v)).alias(f"_next{i}") for i in range(len(qs)))
    )
    per = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.col(f"_below{i}").alias("below"), F.col(f"_last{i}").alias("last"), F.col(f"_next{i}").alias("next")) for i, q in enumerate(qs)))
    outside = outside.select(*key, "_n", F.explode(per).alias("_x")).select(*key, "_n", "_x.*")
    inside = marked.select(*key, "_v", F.explode(F.array_compact(F.array(*(F.when((v >= low[i]) & (v <= high[i]), F.lit(i)) for i in range(len(qs)))))).alias("i"))
    inside = inside.groupBy(*key, "i", "_v").agg(F.count("*").alias("_c"))
    inside = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*key, "i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("q") * (F.col("_n") - 1)
    rows = attach(inside, outside, [*key, "i"]).withColumns({"_a": F.floor(at), "_b": F.ceil(at), "_end": F.col("below") + F.col("_upto")})
    picked = rows.groupBy(*key, "i", "_n", "q", "below", "last", "next", "_a", "_b").agg(F.max("_end").alias("_end"), *(F.min(F.when(F.col("_end") > F.col(c), F.col("_v"))).alias(f"{c}v") for c in ("_a", "_b")))
    missed = (F.col("_a") < F.col("below") - 1) | (F.col("_b") > F.col("_end"))
    value_at = lambda c: F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).when(F.col(c) < F.col("below"), F.col("last")).otherwise(F.coalesce(F.col(f"{c}v"), F.col("next")))
    part = at - F.col("_a")
    q = (1 - part) * value_at("_a") + part * value_at("_b")
    return picked.groupBy(*key, F.col("_n").alias("n")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("q"))


def bracketed_scale(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """robust_scale of groups of any size: the quantiles are bracketed ones."""
    first = attach(bracketed_quantiles(df, key, value, QUARTILES), df.groupBy(*key).agg(F.stddev_samp(value).alias("_std")), key)
    centred = attach(df.where(F.col(value).isNotNull()), first.select(*key, F.col("q")[1].alias("_centre")), key).select(*key, F.abs(F.col(value) - F.col("_centre")).alias("_d"))
    out = attach(first, bracketed_quantiles(centred, key, "_d", (0.5,)).select(*key, (MAD * F.col("q")[0]).alias("_mad")), key)
    usable = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (c > LEAST), c)
    return out.select(*key, "n", F.col("q")[1].alias("centre"), F.coalesce(usable(F.col("_mad")), usable((F.col("q")[2] - F.col("q")[0]) / IQR), usable(F.col("_std"))).alias("scale"))


def bracketed_threshold(df: DataFrame, key: Sequence[str], value: str, q: float, floor: float, reference: Column) -> DataFrame:
    """adaptive_threshold of groups of any size."""
    found = bracketed_quantiles(df.where(reference), key, value, (q,)).select(*key, F.col("q")[0].alias("_q"))
    return attach(df.select(*key).distinct(), found, key, "left").select(*key, F.greatest(F.lit(floor), "_q").alias("threshold"))


def bracketed_reference(df: DataFrame, reference: Column, key: Sequence[str], value: str) -> DataFrame:
    """(key, mean, std, median, min, max, mad) of the reference rows, for groups of any size."""
    ref = df.where(reference)
    plain = ref.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    median = bracketed_quantiles(ref, key, value, (0.5,)).select(*key, F.col("q")[0].alias("median"))
    away = attach(ref.where(F.col(value).isNotNull()), median, key).select(*key, F.abs(F.col(value) - F.col("median")).alias("_d"))
    return attach(attach(plain, median, key), bracketed_quantiles(away, key, "_d", (0.5,)).select(*key, F.col("q")[0].alias("mad")), key)


def robust_scale(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, n, centre, scale): median and 1.4826 MAD, else IQR / 1.349, else the standard deviation; each has to be
    over 1e-9, else the scale is null. Two aggregations; the second joins the first's medians back."""
    first = df.groupBy(*key).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.stddev_samp(value).alias("_std"))
    spread = df.join(first.select(*key, F.col("_q")[1].alias("_centre")), list(key)).groupBy(*key).agg((MAD * F.percentile(F.abs(F.col(value) - F.col("_centre")), 0.5)).alias("_mad"))
    iqr = (F.col("_q")[2] - F.col("_q")[0]) / IQR
    usable = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (c > LEAST), c)
    return first.join(spread, list(key)).select(*key, "n", F.col("_q")[1].alias("centre"), F.coalesce(usable(F.col("_mad")), usable(iqr), usable(F.col("_std"))).alias("scale"))


def robust_variability(df: DataFrame, key: Sequence[str], value: str, least_values: int = 10) -> DataFrame:
    """(key, variability): max(IQR, 1.4826 MAD), 0 with fewer values."""
    first = df.groupBy(*key).agg(F.count(value).alias("_n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    spread = df.join(first.select(*key, F.col("_q")[1].alias("_c")), list(key)).groupBy(*key).agg((MAD * F.percentile(F.abs(F.col(value) - F.col("_c")), 0.5)).alias("_mad"))
    return first.join(spread, list(key)).select(*key, F.when(F.col("_n") >= least_values, F.greatest(F.col("_q")[2] - F.col("_q")[0], "_mad")).otherwise(0.0).alias("variability"))


def robust_z(df: DataFrame, reference: Column, key: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Adds |value - centre| / scale by the key's reference rows; null where there is no scale."""
    stats = robust_scale(df.where(reference), key, value)
    return df.join(stats.select(*key, "centre", "scale"), list(key), "left").withColumn(name, F.abs(F.col(value) - F.col("centre")) / F.col("scale"))


def describe(df: DataFrame, key: Sequence[str], value: str, position: str | None = None) -> DataFrame:
    """(key, n_rows, n_valid, mean, std, min, max, range, median, q25, q75, missing_ratio[, slope])."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs = [F.count("*").alias("n_rows"), F.count(value).alias("n_valid"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q")]
    if position:
        aggs.append(F.regr_slope(value, position).alias("slope"))
    out = df.groupBy(*key).agg(*aggs)
    return out.withColumns({"range": F.col("max") - F.col("min"), "median": F.col("_q")[1], "q25": F.col("_q")[0], "q75": F.col("_q")[2], "missing_ratio": 1 - F.col("n_valid") / F.col("n_rows")}).drop("_q")


def compare_periods(stats: DataFrame, key: Sequence[str], period: str, old: str, new: str, values: Sequence[str]) -> DataFrame:
    """Two periods side by side with difference and relative change of each value."""
    wide = stats.groupBy(*key).pivot(period, [old, new]).agg(F.first(F.struct(*values)))
    out = list(key)
    for v in values:
        a, b = F.col(old)[v], F.col(new)[v]
        out += [a.alias(f"{v}_{old}"), b.alias(f"{v}_{new}"), (b - a).alias(f"{v}_diff"), F.when(F.abs(a) >= LEAST, (b - a) / F.abs(a)).alias(f"{v}_relative")]
    return wide.select(*out)


def adaptive_threshold(df: DataFrame, key: Sequence[str], value: str, q: float, floor: float, reference: Column) -> DataFrame:
    """(key, threshold): max(floor, quantile of the reference rows); the floor where there are none."""
    return df.groupBy(*key).agg(F.greatest(F.lit(floor), F.percentile(F.when(reference, F.col(value)), q)).alias("threshold"))


def signal_quality(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, missing_ratio, n_distinct, top_share, std): what decides whether a signal is worth keeping."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("_c"))
    top = counts.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max("_c").alias("_top"), F.count("*").alias("n_distinct"))
    base = df.groupBy(*key).agg(F.count("*").alias("_n"), F.count(value).alias("_v"), F.stddev_pop(value).alias("std"))
    return base.join(top, list(key), "left").select(*key, (1 - F.col("_v") / F.col("_n")).alias("missing_ratio"), "n_distinct", (F.col("_top") / F.col("_v")).alias("top_share"), "std")


def summary(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, n, mean, std, median, q25, q75, p2_5, p97_5)."""
    q = F.percentile(value, F.array(*map(F.lit, (0.025, 0.25, 0.5, 0.75, 0.975))))
    return df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), q.alias("_q")).select(*key, "n", "mean", "std", *(F.col("_q")[i].alias(n) for i, n in enumerate(("p2_5", "q25", "median", "q75", "p97_5"))))


def reference_z(df: DataFrame, reference: Column, key: Sequence[str], value: str) -> DataFrame:
    """Adds mean, std, median, mad, min and max of the reference rows, and z by the median and 1.4826 MAD, else by mean
    and standard deviation, else 0."""
    first = df.where(reference).groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))
    mad = df.where(reference).join(first.select(*key, "median"), list(key)).groupBy(*key).agg(F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    out = df.join(first.join(mad, list(key)), list(key), "left")
    z = F.when(F.col("mad") > LEAST, F.abs(F.col(value) - F.col("median")) / (MAD * F.col("mad"))).when(F.col("std") > LEAST, F.abs(F.col(value) - F.col("mean")) / F.col("std")).otherwise(0.0)
    return out.withColumn("z", z)
