"""Evaluation: confusion metrics, areas, votes, thresholds, exact tests, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, key: Sequence[str], actual: str, predicted: str, zero: float | None = None) -> DataFrame:
    """Counts and rates by key; a rate without cases is ``zero`` (null by default)."""
    hit = lambda a, p: F.count_if((F.col(actual) == a) & (F.col(predicted) == p))
    counts = df.groupBy(*key).agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))

    def rate(a: Column, b: Column) -> Column:
        out = a / F.when(b != 0, b)
        return out if zero is None else F.coalesce(out, F.lit(float(zero)))

    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall, specificity, precision = rate(tp, tp + fn), rate(tn, tn + fp), rate(tp, tp + fp)
    return counts.withColumns({
        "accuracy": rate(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "specificity": specificity, "fpr": rate(fp, fp + tn),
        "balanced_accuracy": (recall + specificity) / 2, "f1": rate(2 * tp, 2 * tp + fp + fn), "f2": rate(5 * tp, 5 * tp + 4 * fn + fp),
    })


def roc_auc(df: DataFrame, key: Sequence[str], actual: str, score: str) -> DataFrame:
    """(key, roc_auc) by rank sums with averaged ties; null with one class.

    Equal scores are counted first, so what is ordered is one row for each distinct score.
    """
    by_score = df.groupBy(*key, score).agg(F.sum(F.when(F.col(actual) == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(actual) == 0, 1).otherwise(0)).alias("_q"))
    w = Window.partitionBy(*key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = by_score.withColumn("_below", F.coalesce(F.sum("_q").over(w), F.lit(0)))
    sums = below.groupBy(*key).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)).alias("_u"), F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))
    return sums.select(*key, (F.col("_u") / F.when((F.col("_np") > 0) & (F.col("_nq") > 0), F.col("_np") * F.col("_nq"))).alias("roc_auc"))


def average_precision(df: DataFrame, key: Sequence[str], actual: str, score: str) -> DataFrame:
    """(key, pr_auc): precision at each score, weighted by the recall gained there; null without positives."""
    by_score = df.groupBy(*key, score).agg(F.sum(F.when(F.col(actual) == 1, 1).otherwise(0)).alias("_p"), F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    cum = by_score.withColumns({"_tp": F.sum("_p").over(w), "_all": F.sum("_n").over(w)})
    sums = cum.groupBy(*key).agg(F.sum(F.col("_p") * F.col("_tp") / F.col("_all")).alias("_s"), F.sum("_p").alias("_np"))
    return sums.select(*key, (F.col("_s") / F.when(F.col("_np") > 0, F.col("_np"))).alias("pr_auc"))


def votes(df: DataFrame, key: Sequence[str], probability: str, threshold: str, predicted: str, low: float = 0.4, high: float = 0.6, cut: float = 0.5) -> DataFrame:
    """Repeated predictions by key: vote share, probability and threshold statistics, margin, decision and stability."""
    q = df.groupBy(*key).agg(
        F.count("*").alias("n_votes"), F.avg(predicted).alias("vote_fraction"), F.avg(probability).alias("probability_mean"), F.percentile(probability, 0.5).alias("probability_median"), F.stddev_samp(probability).alias("probability_std"),
        F.min(probability).alias("probability_min"), F.max(probability).alias("probability_max"), F.avg(threshold).alias("threshold_mean"), F.stddev_samp(threshold).alias("threshold_std"), F.avg(F.col(probability) - F.col(threshold)).alias("margin_mean"),
    )
    v = F.col("vote_fraction")
    return q.withColumns({"decision": (v >= cut).cast("int"), "status": F.when(v < low, "normal").when(v > high, "anomaly").otherwise("review"), "stability": F.when(F.greatest(v, 1 - v) >= 0.9, "stable").when(F.greatest(v, 1 - v) >= 0.7, "moderate").otherwise("unstable")})


def threshold_grid(df: DataFrame, actual: str, score: str, steps: int, max_fpr: float) -> DataFrame:
    """The threshold of an even grid with the best balanced accuracy at a bounded false positive rate; ties take the
    larger. Rows are binned to the grid first, so the search is over ``steps`` + 1 rows, whatever the input."""
    binned = df.select(F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).cast("int").alias("_b"), F.col(actual).alias("_y")).groupBy("_b").agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_n"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("_b"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    cum = grid.join(binned, "_b", "left").na.fill(0, ["_p", "_n"]).withColumns({"_tp": F.sum("_p").over(w), "_fp": F.sum("_n").over(w), "_np": F.sum("_p").over(whole), "_nn": F.sum("_n").over(whole)})
    rated = cum.select((F.col("_b") / steps).alias("threshold"), (F.col("_tp") / F.col("_np")).alias("recall"), (F.col("_fp") / F.col("_nn")).alias("fpr")).withColumn("balanced_accuracy", (F.col("recall") + 1 - F.col("fpr")) / 2)
    return rated.where(F.col("fpr") <= max_fpr).orderBy(F.desc("balanced_accuracy"), F.desc("threshold")).limit(1)


def binomial_two_sided(successes: int, trials: int) -> float:
    """Exact two-sided binomial p at one half: twice the smaller tail, 1 at most."""
    if trials == 0:
        return 1.0
    k = min(successes, trials - successes)
    return min(1.0, 2 * sum(math.comb(trials, i) for i in range(k + 1)) / 2**trials)


def binomial_column(b: Column, c: Column) -> Column:
    """The same for two discordant counts in columns (an exact McNemar test), by logs of factorials."""
    n, k = b + c, F.least(b, c)
    lgamma = lambda x: F.aggregate(F.when(x >= 1, F.sequence(F.lit(1), x.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    tail = F.aggregate(F.transform(F.sequence(F.lit(0), k.cast("int")), lambda i: F.exp(lgamma(n) - lgamma(i) - lgamma(n - i) - n * math.log(2))), F.lit(0.0), lambda s, x: s + x)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def resampled(pairs: DataFrame, a: str, b: str, ids: str, resamples: int, seed: int = 0) -> DataFrame:
    """(resample, drawn, m): rows drawn and their mean of a - b, for each resample.

    Each row gets a Poisson(1) weight for each resample, from a digest of (seed, resample, id): resamples are then made
    in one pass with partial sums, and no row is drawn by position.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col(ids).cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint") + 0.5) / float(1 << 40)
    cdf, p, weight = 0.0, math.exp(-1), F.lit(0)
    for k in range(9):
        cdf += p
        weight = weight + F.when(u > cdf, 1).otherwise(0)
        p /= k + 1
    draws = pairs.select(ids, (F.col(a) - F.col(b)).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    return draws.withColumn("w", weight).groupBy("resample").agg(F.sum("w").alias("drawn"), (F.sum(F.col("w") * F.col("d")) / F.when(F.sum("w") > 0, F.sum("w"))).alias("m"))


def bootstrap_difference(pairs: DataFrame, a: str, b: str, ids: str, resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean of a - b over resampled rows with a percentile interval, and the share of resamples where it is positive."""
    q = (1 - level) / 2
    return resampled(pairs, a, b, ids, resamples, seed).agg(F.avg("m").alias("mean_difference"), F.percentile("m", q).alias("low"), F.percentile("m", 1 - q).alias("high"), F.avg((F.col("m") > 0).cast("int")).alias("support"))


def rank_candidates(df: DataFrame, targets: dict[str, tuple[float, str]], by: Sequence[Column | str]) -> DataFrame:
    """Adds feasible (every target met), miss (how far the targets are missed together) and rank: feasible ones first,
    then those that miss least, then ``by``. One row for each candidate is ordered."""
    miss = sum((F.greatest(F.lit(0.0), (limit - F.col(c)) if kind == "least" else (F.col(c) - limit)) for c, (limit, kind) in targets.items()), F.lit(0.0))
    met = F.lit(True)
    for c, (limit, kind) in targets.items():
        met = met & (F.col(c) >= limit if kind == "least" else F.col(c) <= limit)
    rated = df.withColumns({"feasible": met, "miss": F.round(miss, 9)})
    return rated.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("feasible").cast("int")), "miss", *by)))


def candidate_bank(spark: SparkSession, base: dict[str, float], bank: dict[str, dict[str, float]]) -> DataFrame:
    """(candidate, <settings>, distance): named candidates, each the base settings with some changed, and how many."""
    rows = [(name, *(float(change.get(k, v)) for k, v in base.items()), sum(change.get(k, v) != v for k, v in base.items())) for name, change in bank.items()]
    return spark.createDataFrame(rows, "candidate string, " + ", ".join(f"{k} double" for k in base) + ", distance int")
