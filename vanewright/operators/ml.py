"""Model operators on MLlib, and the feature steps around them.

Deep models of the monitored domain have no library here: their place is taken by principal-component reconstruction
and by MLlib classifiers behind the same tables (window scores, fold predictions).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .frames import hashed_rank, percent_rank_average
from .metrics import confusion, roc_auc
from .ranges import nth


def balanced_weights(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds ``weight``: one over the group's size, with mean 1. As the raw weights add up to the number of groups, the
    mean needs only two counts and no window over all rows."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_groups"))
    return df.join(sizes, list(group)).crossJoin(F.broadcast(totals)).withColumn("weight", F.col("_rows") / (F.col("_n") * F.col("_groups"))).drop("_n", "_rows", "_groups")


def balance_classes(df: DataFrame, label: str, strata: Sequence[str], ids: str, ratio: int) -> DataFrame:
    """All rows of class 1 and at most ``ratio`` times as many of class 0, taken round robin from the strata in a
    hashed order. A row's place follows from its rank in its stratum and the strata's sizes: nothing ranks a class."""
    x = hashed_rank(df, [label, *strata], ids, "_k")
    sizes = df.groupBy(label, *strata).agg(F.count("*").alias("_size"))
    # one row for each class, with its strata in order
    listed = sizes.groupBy(label).agg(F.sort_array(F.collect_list(F.struct(F.struct(*strata).alias("s"), F.col("_size").alias("n")))).alias("_all"))
    most = df.where(F.col(label) == 1).agg((F.count("*") * ratio).alias("_most"))
    x = x.join(F.broadcast(listed), label).crossJoin(F.broadcast(most))
    here = F.struct(*strata)
    place = F.aggregate("_all", F.lit(0).cast("bigint"), lambda a, y: a + F.least(y["n"], F.col("_k") - 1) + F.when((y["s"] <= here) & (y["n"] >= F.col("_k")), 1).otherwise(0))
    return x.where((F.col(label) == 1) | (place <= F.col("_most"))).drop("_k", "_all", "_most")


def spearman(df: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """(key, rho): correlation of average ranks."""
    ranked = df.withColumns({"_a": percent_rank_average(F.col(a), key), "_b": percent_rank_average(F.col(b), key)})
    return ranked.groupBy(*key).agg(F.corr("_a", "_b").alias("rho"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """(mi) of two binned columns in nats: only the table of bin pairs is larger than a row."""
    joint = df.groupBy(x, y).agg(F.count("*").alias("_n"))
    t = joint.withColumns({"_x": F.sum("_n").over(Window.partitionBy(x)), "_y": F.sum("_n").over(Window.partitionBy(y)), "_t": F.sum("_n").over(Window.partitionBy(F.lit(0)))})
    return t.agg(F.sum(F.col("_n") / F.col("_t") * F.log(F.col("_n") * F.col("_t") / (F.col("_x") * F.col("_y")))).alias("mi"))


def scale_channels(df: DataFrame, key: Sequence[str], value: str, clip: float = 10.0) -> DataFrame:
    """Adds ``scaled``: (value - mean) / std of the key, nulls at the median, clipped; 0 where there is no spread."""
    s = df.groupBy(*key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.percentile(value, 0.5).alias("_q"))
    z = F.coalesce((F.coalesce(F.col(value), F.col("_q")) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")), F.lit(0.0))
    return df.join(s, list(key)).withColumn("scaled", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("_m", "_s", "_q")


def chronological_holdout(df: DataFrame, group: str, time: str, label: str, fraction: float) -> DataFrame:
    """(group, part): the last groups by first time (ties by group) are the test part: the fraction rounded up, one at
    least, and two groups at least stay to train on. If there are labelled groups but none among these, the latest of them
    takes the place of the last. There have to be four groups."""
    g = df.groupBy(group).agg(F.min(time).alias("_s"), F.coalesce(F.bool_or(F.col(label) == 1), F.lit(False)).alias("_hit"))
    g = stored(g, "groups")
    n = g.count()
    if n < 4:
        raise ValueError("at least four groups are needed")
    latest = [F.desc("_s"), F.desc(group)]
    size = min(max(1, math.ceil(n * fraction)), n - 2)
    test = g.orderBy(*latest).limit(size)
    forced = g.where("_hit").orderBy(*latest).limit(1)
    if not forced.isEmpty() and test.where("_hit").isEmpty():
        test = g.join(g.orderBy(*latest).limit(1), group, "left_anti").orderBy(*latest).limit(size - 1).union(forced)
    return g.join(test.select(group, F.lit(True).alias("_test")), group, "left").select(group, F.when(F.col("_test"), "test").otherwise("train").alias("part"))


def purged_holdout(df: DataFrame, time: str, fraction: float, purge_hours: float) -> DataFrame:
    """Adds ``part``: rows from the time on at which the last fraction of the rows begins are the test part, rows at
    least ``purge_hours`` before it the training part, those between are purged. Null times are purged."""
    known = df.where(F.col(time).isNotNull()).withColumn("_us", F.unix_micros(time))
    n = known.count()
    start = nth(known, "_us", min(max(1, math.floor(n * (1 - fraction))), n - 1)) if n else None
    at = F.unix_micros(time)
    if start is None:
        return df.withColumn("part", F.lit("purged"))
    return df.withColumn("part", F.when(at >= start, "test").when(at < start - int(purge_hours * 3.6e9), "train").otherwise("purged"))


def reconstruction_scores(df: DataFrame, ids: str, vector: str, k: int) -> DataFrame:
    """(id, score, top): mean absolute error of a k-component reconstruction, and the component that is worst."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.where(F.col(vector).isNotNull()).select(ids, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    x = StandardScaler(inputCol="raw", outputCol="std", withMean=True).fit(x).transform(x)
    model = PCA(k=k, inputCol="std", outputCol="low").fit(x)
    basis = model.pc.toArray()  # dimension x k, fixed by the schema
    rows = F.array(*(F.array(*map(F.lit, map(float, row))) for row in basis))
    back = F.transform(rows, lambda b: F.aggregate(F.zip_with(b, vector_to_array("low"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
    errors = F.zip_with(vector_to_array("std"), back, lambda p, q: F.abs(p - q))
    out = model.transform(x).select(ids, errors.alias("e"))
    return out.select(ids, (F.aggregate("e", F.lit(0.0), lambda s, v: s + v) / F.size("e")).alias("score"), (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("top"))


def folds(df: DataFrame, ids: str, label: str, splits: int, repeat: int) -> DataFrame:
    """Adds ``fold`` and ``inner`` (0 or 1): stratified, in a hashed order that depends on the repeat. Whichever fold is
    left out, the others' rows are halved by ``inner`` class by class."""
    at = F.col("_rank") - 1
    return hashed_rank(df, [label], ids, "_rank", f"{repeat}:").withColumns({"fold": (at % splits).cast("int"), "inner": (F.floor(at / splits) % 2).cast("int")}).drop("_rank")


def model_specs() -> dict[str, list[tuple]]:
    """Candidates by name with a small grid each: (regularisation,), (depth,), (depth, trees)."""
    return {"logistic_regression": [(0.0,), (0.1,)], "decision_tree": [(3,), (5,)], "random_forest": [(4, 20)]}


def model_pipeline(name: str, setting: tuple, features: Sequence[str], label: str):
    """Median imputation, scaling by median and quartiles, and a class-weighted classifier."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, RobustScaler, VectorAssembler

    filled = [f"{f}__filled" for f in features]
    common = {"labelCol": label, "weightCol": "weight", "featuresCol": "scaled"}
    model = {
        "logistic_regression": lambda reg: LogisticRegression(regParam=reg, maxIter=30, **common), "decision_tree": lambda depth: DecisionTreeClassifier(maxDepth=depth, seed=7, **common),
        "random_forest": lambda depth, trees: RandomForestClassifier(maxDepth=depth, numTrees=trees, seed=7, **common),
    }[name](*setting)
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), RobustScaler(inputCol="raw", outputCol="scaled", withCentering=True), model])


def out_of_fold(df: DataFrame, ids: str, label: str, features: Sequence[str], splits: int = 3, specs: dict[str, list[tuple]] | None = None) -> DataFrame:
    """(id, fold, model, setting, actual, probability) of every candidate and setting, each row scored by models that
    didn't see it."""
    from pyspark.ml.functions import vector_to_array

    x = stored(balanced_weights(folds(df.withColumn(label, F.col(label).cast("double")), ids, label, splits, 0), [label]), "folds")
    out = None
    for name, grid in (specs or model_specs()).items():
        for setting in grid:
            for k in range(splits):
                p = model_pipeline(name, setting, features, label).fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k))
                part = p.select(ids, "fold", F.lit(name).alias("model"), F.lit(str(setting)).alias("setting"), F.col(label).cast("int").alias("actual"), vector_to_array("probability")[1].alias("probability"))
                out = part if out is None else out.union(part)
    return out


def thresholds(predictions: DataFrame, steps: int = 20, max_fpr: float = 0.2) -> DataFrame:
    """(model, setting, auc, threshold, recall, fpr, balanced_accuracy): for each candidate the threshold of an even grid
    with the best balanced accuracy at a bounded false positive rate (1.0, which takes nothing, if none is under it)."""
    key = ["model", "setting"]
    auc = roc_auc(predictions, key, "actual", "probability")
    binned = predictions.groupBy(*key, F.least(F.floor(F.col("probability") * steps + 1e-9), F.lit(steps)).cast("int").alias("_b")).agg(F.sum("actual").alias("_p"), F.sum(1 - F.col("actual")).alias("_n"))
    grid = predictions.select(*key).distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(steps + 1))))
    w = Window.partitionBy(*key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    cum = grid.join(binned, [*key, "_b"], "left").na.fill(0, ["_p", "_n"]).select(*key, "_b", (F.sum("_p").over(w) / F.sum("_p").over(whole)).alias("recall"), (F.sum("_n").over(w) / F.sum("_n").over(whole)).alias("fpr"))
    cum = cum.withColumn("balanced_accuracy", (F.col("recall") + 1 - F.col("fpr")) / 2).where(F.col("fpr") <= max_fpr)
    best = cum.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("balanced_accuracy"), F.desc("_b")))).where("_k = 1")
    return best.join(auc, key).select(*key, F.col("roc_auc").alias("auc"), (F.col("_b") / steps).alias("threshold"), "recall", "fpr", "balanced_accuracy")


def fold_comparison(predictions: DataFrame, chosen: DataFrame) -> DataFrame:
    """(model, setting, mean and std over folds of balanced accuracy, F1 and AUC) at the chosen thresholds."""
    key = ["model", "setting", "fold"]
    p = predictions.join(chosen.select("model", "setting", "threshold"), ["model", "setting"]).withColumn("_hit", (F.col("probability") >= F.col("threshold")).cast("int"))
    m = confusion(p, key, "actual", "_hit").join(roc_auc(p, key, "actual", "probability"), key)
    return m.groupBy("model", "setting").agg(*(f(c).alias(f"{n}_{c}") for c in ("balanced_accuracy", "f1", "roc_auc") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def final_fit(df: DataFrame, ids: str, label: str, features: Sequence[str], chosen: tuple[str, tuple, float]) -> DataFrame:
    """(id, probability, decision) of the chosen candidate refitted on all rows, at its out-of-fold threshold."""
    from pyspark.ml.functions import vector_to_array

    name, setting, threshold = chosen
    x = balanced_weights(df.withColumn(label, F.col(label).cast("double")), [label])
    p = model_pipeline(name, setting, features, label).fit(x).transform(x)
    return p.select(ids, vector_to_array("probability")[1].alias("probability")).withColumn("decision", (F.col("probability") >= threshold).cast("int"))


def graph_reconstruction(x: DataFrame, edges: DataFrame, ids: str) -> DataFrame:
    """(id, node, value, rebuilt, error): each node's value rebuilt from its neighbours by a normalised graph (i, j,
    weight), without itself; weights of a node add up to one. It stands in for a trained graph autoencoder."""
    w = edges.where("i <> j")
    w = w.join(w.groupBy("i").agg(F.sum("weight").alias("_d")), "i").select(F.col("i").alias("node"), F.col("j").alias("_j"), (F.col("weight") / F.col("_d")).alias("_w"))
    rebuilt = x.select(ids, F.col("node").alias("_j"), F.col("value").alias("_x")).join(F.broadcast(w), "_j").groupBy(ids, "node").agg(F.sum(F.col("_w") * F.col("_x")).alias("rebuilt"))
    return x.join(rebuilt, [ids, "node"]).withColumn("error", F.abs(F.col("value") - F.col("rebuilt")))


def nested_cv(df: DataFrame, ids: str, label: str, features: Sequence[str], splits: int = 5, repeats: int = 5, grid: Sequence[float] = (0.0, 0.1)) -> DataFrame:
    """(id, repeat, fold, actual, probability, regularisation): out-of-fold probabilities of a weighted logistic model
    with median imputation and scaling; the regularisation is chosen on inner folds by area under the curve."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def pipeline(reg: float) -> Pipeline:
        filled = [f"{f}__filled" for f in features]
        return Pipeline(stages=[
            Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            LogisticRegression(labelCol=label, weightCol="weight", regParam=reg, maxIter=30),
        ])

    score = BinaryClassificationEvaluator(labelCol=label)
    parts = []
    for repeat in range(repeats):
        x = stored(balanced_weights(folds(df.withColumn(label, F.col(label).cast("double")), ids, label, splits, repeat), [label]), "folds")
        for k in range(splits):
            train, test = x.where(F.col("fold") != k), x.where(F.col("fold") == k)
            rated = [(sum(score.evaluate(pipeline(g).fit(train.where(F.col("inner") != j)).transform(train.where(F.col("inner") == j))) for j in (0, 1)), -i, g) for i, g in enumerate(grid)]
            best = max(rated)[2]
            p = pipeline(best).fit(train).transform(test)
            parts.append(p.select(ids, F.lit(repeat).alias("repeat"), "fold", F.col(label).cast("int").alias("actual"), vector_to_array("probability")[1].alias("probability"), F.lit(float(best)).alias("regularisation")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def neighbour_information(rows: DataFrame, signals: Sequence[str], ids: str, neighbours: int = 3, most: int = 5000) -> DataFrame:
    """(i, j, mi, weight) of each pair of signals: mutual information by nearest neighbours, and its share of the 0.95
    quantile of the positive ones (of the largest, if that is 0), at most 1.

    A row counts its neighbours in each signal that are nearer than its k-th nearest in both, by the larger of the two
    scaled distances. Both directions give the same estimate, as no noise is added. Rows with a null or NaN are left out;
    of more than ``most`` rows a sample in the order of a hash of ``ids`` counts (bounded: most x signals numbers, which
    every task holds). Pairs are spread over tasks, and a pair's distances are made in blocks of rows.
    """
    ok = F.lit(True)
    for s in signals:
        ok = ok & F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    sample = rows.where(ok).orderBy(F.xxhash64(ids), ids).limit(most).select(*(F.col(s).cast("double").alias(s) for s in signals)).toPandas().to_numpy(float)
    spark = rows.sparkSession
    names = list(signals)
    with np.errstate(all="ignore"):
        spread = sample.std(axis=0) if len(sample) else np.ones(len(names))
        scaled = sample / np.where(spread > 0, spread, 1.0)
    pairs = spark.createDataFrame([(a, b) for a in range(len(names)) for b in range(a + 1, len(names))], "a int, b int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(names[a], names[b], nearest_information(scaled[:, a], scaled[:, b], neighbours)) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pd.DataFrame(got, columns=["i", "j", "mi"])

    found = pairs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "i string, j string, mi double")
    scale = found.where("mi > 0").agg(F.percentile("mi", 0.95).alias("_q"), F.max("mi").alias("_m")).select(F.when(F.col("_q") > 0, F.col("_q")).otherwise(F.col("_m")).alias("_scale"))
    return found.crossJoin(F.broadcast(scale)).select("i", "j", "mi", F.when(F.col("_scale") > 0, F.least(F.lit(1.0), F.col("mi") / F.col("_scale"))).otherwise(0.0).alias("weight"))  # one row


def nearest_information(x: np.ndarray, y: np.ndarray, k: int, block: int = 512) -> float:
    """Nearest-neighbour estimate of the mutual information of two series, 0 at least; 0 with k rows or fewer."""
    n = len(x)
    if n <= k:
        return 0.0
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, n + 1))]) - np.euler_gamma  # digamma of 1, 2, ...
    total = 0.0
    for at in range(0, n, block):
        apart = [np.abs(v[at : at + block, None] - v[None, :]) for v in (x, y)]
        reach = np.partition(np.maximum(*apart), k, axis=1)[:, k]  # place 0 is the row itself
        for one in apart:
            inside = (one < reach[:, None]).sum(axis=1)
            total += harmonic[np.maximum(inside, 1) - 1].sum()
    return max(0.0, float(harmonic[n - 1] + harmonic[k - 1] - total / n))


def graph_components(x: DataFrame, edges: DataFrame, ids: str, k: int, train: Column) -> DataFrame:
    """(id, node, value, rebuilt, error): values rebuilt from k components of the graph-smoothed rows, fitted on the
    ``train`` rows. It stands in for a trained graph autoencoder: smoothing, a narrow code, and a linear decoder.

    ``edges`` is a normalised graph (i, j, weight) with loops, bounded by the nodes; ``x`` is (id, node, value), a missing
    node counts as 0. A partition adds up its rows' products of smoothed by smoothed and smoothed by plain values, so what
    comes to the driver are two matrices of nodes by nodes. Their leading components and the decoder's normal equations
    give one more such matrix, with which all rows are rebuilt by a join.
    """
    spark = x.sparkSession
    links = edges.select("i", "j", "weight").toPandas()
    names = sorted(set(links["i"]) | set(links["j"]))
    place = {n: a for a, n in enumerate(names)}
    graph = np.zeros((len(names), len(names)))
    for i, j, w in links.itertuples(index=False):
        graph[place[i], place[j]] += w
    rows = x.where(train).groupBy(ids).agg(F.map_from_entries(F.collect_list(F.struct("node", F.col("value").cast("double")))).alias("v"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cross = np.zeros_like(graph), np.zeros_like(graph)
        for pdf in batches:
            m = np.array([[(dict(v).get(n) or 0.0) for n in names] for v in pdf["v"]], float).reshape(-1, len(names))
            y = m @ graph.T
            own += y.T @ y
            cross += y.T @ m
        a, b = np.indices(graph.shape)
        yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "own": own.ravel(), "crossed": cross.ravel()})

    sums = rows.select("v").mapInPandas(products, "a int, b int, own double, crossed double").groupBy("a", "b").agg(F.sum("own").alias("own"), F.sum("crossed").alias("crossed")).toPandas()
    own, cross = np.zeros_like(graph), np.zeros_like(graph)
    own[sums["a"], sums["b"]], cross[sums["a"], sums["b"]] = sums["own"], sums["crossed"]
    _, vectors = np.linalg.eigh(own)
    code = vectors[:, ::-1][:, :k]
    decoder = np.linalg.pinv(code.T @ own @ code) @ (code.T @ cross)
    whole = graph.T @ code @ decoder
    w = spark.createDataFrame([(names[j], names[i], float(whole[j, i])) for j in range(len(names)) for i in range(len(names))], "_j string, node string, _w double")
    rebuilt = x.select(ids, F.col("node").alias("_j"), F.col("value").alias("_x")).join(F.broadcast(w), "_j").groupBy(ids, "node").agg(F.sum(F.col("_w") * F.col("_x")).alias("rebuilt"))
    return x.join(rebuilt, [ids, "node"]).withColumn("error", F.abs(F.col("value") - F.col("rebuilt")))
