import numpy as np
from pyspark.sql import functions as F

from vanewright.operators import ml, ranking
from vanewright.plans.queries_models import _ref, _standard_graph, m13_components

NODES = [f"s{i}" for i in range(6)]


def made(spark):
    """Two hidden factors behind six signals; edges inside each half."""
    rng = np.random.default_rng(3)
    hidden = rng.normal(size=(400, 2))
    mix = np.array([[1, 1, 1, 0.2, 0, 0], [0, 0.2, 0, 1, -1, 1]], float)
    m = hidden @ mix + 0.1 * rng.normal(size=(400, 6))
    rows = [(i, n, float(v)) for i, r in enumerate(m) for n, v in zip(NODES, r, strict=True)]
    edges = [(a, b, 1.0) for a in NODES for b in NODES if a != b and NODES.index(a) // 3 == NODES.index(b) // 3]
    return m, spark.createDataFrame(rows, "id int, node string, value double"), ranking.normalised(spark.createDataFrame(edges, "i string, j string, weight double"))


def dense(m, train, graph, k):
    y = m[train] @ graph.T
    code = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, :k]
    decoder = np.linalg.lstsq(y @ code, m[train], rcond=None)[0]
    return m @ graph.T @ code @ decoder


def matrix(df):
    wide = df.groupBy("id").pivot("node", NODES).agg(F.first("rebuilt")).orderBy("id").toPandas()
    return wide[NODES].to_numpy(float)


def test_equals_dense_algebra_and_beats_the_neighbour_mean(spark):
    m, x, edges = made(spark)
    graph = np.zeros((6, 6))
    for r in edges.collect():
        graph[NODES.index(r["i"]), NODES.index(r["j"])] = r["weight"]
    train = np.arange(400) < 200
    got = ml.graph_components(x, edges, "id", 2, F.col("id") < 200)
    assert np.allclose(matrix(got), dense(m, train, graph, 2), atol=1e-8)
    error = lambda df: df.where("id >= 200").agg(F.avg("error")).first()[0]
    assert error(got) < 0.7 * error(ml.graph_reconstruction(x, edges, "id"))


def test_query_on_held_out_days(spark):
    sf = "/root/testdata/sf0.01"
    z, edges = _standard_graph(spark, sf)
    held = lambda df: df.where(~_ref()).agg(F.avg("error")).first()[0]
    assert held(ml.graph_components(z, ranking.normalised(edges), "t", 3, _ref())) < held(ml.graph_reconstruction(z, edges, "t"))
    assert m13_components(spark, sf).count() == z.count()
