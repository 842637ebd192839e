"""Hand-made graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from cellspark.operators import complex as cx
from cellspark.operators import evaluation as ev
from cellspark.operators import graph as gr
from cellspark.operators import hypergraph as hy
from cellspark.operators import points as pt

#: An undirected graph of eight nodes and its node features.
EDGES = [(0, 1), (0, 2), (0, 4), (0, 7), (1, 2), (1, 4), (2, 3), (2, 4), (2, 5), (2, 7), (3, 6), (5, 6), (5, 7)]
X = [1, 5, 10, 50, 100, 500, 1000, 5000]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(X)], "node long, x double").cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long").cache()


@pytest.fixture(scope="module")
def cells(nodes, edges):
    return cx.clique_lifting(nodes, edges, 3).cache()


def keys(df, rank):
    return sorted("".join(map(str, r["key"])) for r in df.where(F.col("rank") == rank).collect())


def test_cliques(cells):
    assert keys(cells, 2) == ["012", "014", "024", "027", "124", "257"]
    assert keys(cells, 3) == ["0124"]


def test_projection_sum(nodes, cells):
    x = nodes.select(F.array("node").alias("cell"), "x")
    want = [None, [6, 11, 101, 5001, 15, 105, 60, 110, 510, 5010, 1050, 1500, 5500], [32, 212, 222, 10022, 230, 11020], [696]]
    for rank in (1, 2, 3):
        x = cx.projection_sum(x, cx.incidence(cells, rank))
        assert [r["x"] for r in x.orderBy("cell").collect()] == want[rank]


def test_signed_incidence_squares_to_zero(cells):
    for rank in (2, 3):
        assert cx.product(cx.incidence(cells, rank - 1, True), cx.incidence(cells, rank, True)).count() == 0


def test_names_of_neighbourhoods(cells):
    with pytest.raises(ValueError, match="no such neighbourhood"):
        cx.neighborhood(cells, "sideways_adjacency-1")
    assert [cx.route(n) for n in ("up_adjacency-1", "2-down_incidence-2")] == [(1, 2), (2, 0)]
    assert cx.neighborhood(cells, "2-up_adjacency-0").count() == 20  # both ways, between nodes of a triangle


def test_forman_components(nodes, edges):
    bent = gr.forman_curvature(edges.withColumn("w", F.lit(1.0)))
    bar = sorted(r["curvature"] for r in bent.collect())
    kept = bent.where(F.col("curvature") <= bar[7] + (bar[8] - bar[7]) * 0.2 + 1e-9)
    labels = gr.components(nodes, kept)
    assert sorted(r["count"] for r in labels.groupBy("comp").count().collect()) == [1, 7]


def test_components_and_strong_ones(spark):
    n = spark.range(8).withColumnRenamed("id", "node")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (4, 5), (5, 4)], "src long, dst long")
    assert {r["node"]: r["comp"] for r in gr.components(n, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r["node"]: r["comp"] for r in gr.strong_components(n, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_rwse_of_a_directed_ring(spark):
    n = spark.range(3).withColumnRenamed("id", "node")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    got = {(r["node"], r["step"]): r["p"] for r in gr.rwse(n, e, 6).collect()}
    assert all(p == (1.0 if step % 3 == 0 else 0.0) for (_, step), p in got.items())


def test_pagerank_adds_up(nodes, edges):
    assert gr.pagerank(nodes, edges).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_one_hot_degree_above_the_maximum(nodes, edges):
    with pytest.raises(Exception, match="degree above the maximum"):
        gr.one_hot_degrees(gr.degrees(nodes, gr.symmetric(edges)), 2).collect()


def test_containment_ranks(spark):
    sets = [[0, 1, 2, 3], [4, 5, 6, 7], [0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3], [0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3], [3, 4], [4, 5], [4, 7], [5, 6], [6, 7]]
    members = spark.createDataFrame([(i, v) for i, s in enumerate(sets) for v in s], "he long, node long")
    got = {r["he"]: r["rank"] for r in hy.containment_rank(members).collect()}
    assert sorted(got.values()) == [1] * 11 + [2] * 5 + [3]
    assert (got[0], got[1]) == (3, 2)


def test_points(spark):
    cloud = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (10, 0, 0), (10, 0, 1), (10, 1, 0), (10, 1, 1), (20, 0, 0), (20, 0, 1), (20, 1, 0), (20, 1, 1), (30, 0, 0)]
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(cloud)], "node long, x array<double>")
    sizes = pt.voronoi(points, 0.26).groupBy("he").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 3, 4, 4]
    assert {(r["center"], r["node"]) for r in pt.knn(points, 1, loop=True).collect()} == {(i, i) for i in range(12)}
    assert {r["node"] for r in pt.radius(points, 1.0).where("center = 0").collect()} == {1, 2}


def test_metrics(spark):
    p = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "y double, pred double")
    assert ev.regression_metrics(p).first()[:3] == (1.0, 1.0, 1.0)
    z = spark.createDataFrame([([0.0, 0.0], [1.0, None]), ([0.0, 0.0], [None, None])], "z array<double>, y array<double>")
    assert ev.masked_bce(z).first()["loss"] == pytest.approx(0.6931471805599453)


def test_splits_have_exact_sizes(spark):
    items = spark.range(300).withColumnRenamed("id", "node")
    got = {r["split"]: r["count"] for r in ev.random_split(items, "node", 0.7).groupBy("split").count().collect()}
    assert got == {"train": 210, "valid": 45, "test": 45}
