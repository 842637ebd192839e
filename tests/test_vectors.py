"""Operators on pairs of vectors, and farthest points, held against brute force over several blocks and rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import messages as ms
from cellspark.operators import points as pt


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 5)), 2)
    x[40:46] = x[7]  # ties
    return x


@pytest.fixture(scope="module")
def rows(spark, x):
    made = [(i % 2, i, x[i].tolist()) for i in range(90)] + [(0, 500, None)]
    return spark.createDataFrame(made, "graph_id int, cell long, x array<double>").repartition(5).cache()


def test_cosine_over_a_bar(rows, x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j): unit[i] @ unit[j] for i in range(90) for j in range(90) if i != j and i % 2 == j % 2}
    got = {(r["row"], r["col"]): r["similarity"] for r in ms.cosine_similarities(rows, 0.3).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0.3})
    plan = ms.cosine_similarities(rows, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan  # pairs of rows aren't rows


def test_latent_graph_with_ties(rows, x):
    square = np.square(x[:, None] - x[None]).sum(2)
    want = {(i, j) for i in range(90) for j in sorted((j for j in range(90) if i % 2 == j % 2), key=lambda j: (square[i, j], j))[:4]}
    assert {(r["row"], r["col"]) for r in ms.latent_graph(rows, 4).collect()} == want


def test_farthest_points_in_rounds(spark, rows, x):
    points = rows.select(F.col("cell").alias("node"), "x")
    picked = [0]
    while len(picked) < 30:
        gap = np.sqrt(np.square(x[:, None] - x[picked][None]).sum(2)).min(1)
        picked.append(int(np.lexsort((np.arange(90), -gap))[0]))
    assert [i for i, _ in pt.farthest_points(points, 30, most=3)] == picked
    assert [i for i, _ in pt.farthest_points(points, 30)] == picked
    assert len(pt.farthest_points(points, 90, most=10)) == len(np.unique(x, axis=0))
    nearest = np.square(x[:, None] - x[[i for i, _ in pt.farthest_points(points, 27)]][None]).sum(2).argmin(1)
    assert {r["node"]: r["he"] for r in pt.voronoi(points.where("x IS NOT NULL"), 0.3).collect()} == dict(enumerate(nearest))
