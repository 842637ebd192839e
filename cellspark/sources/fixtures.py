"""Small structures for tests and examples, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Edges, features, labels, members and points of the small structures.
EDGES = [(0, 1), (0, 2), (0, 4), (0, 7), (1, 2), (1, 4), (2, 3), (2, 4), (2, 5), (2, 7), (3, 6), (5, 6), (5, 7)]
X = [1, 5, 10, 50, 100, 500, 1000, 5000]
Y = [0, 1, 1, 1, 0, 0, 0, 0]
SPARSE_EDGES = [(0, 1), (0, 2), (0, 4), (2, 3), (2, 5), (5, 6), (3, 6), (2, 7)]
SECOND_EDGES = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (3, 6), (3, 9), (4, 5), (4, 6), (4, 7), (5, 0), (5, 7), (5, 10), (5, 11), (6, 9), (7, 8), (8, 6), (10, 11)]
MEMBERS = [
    *([0, 1, 2, 3], [4, 5, 6, 7], [0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3], [0, 1], [0, 2], [0, 3]),
    *([1, 2], [1, 3], [2, 3], [3, 4], [4, 5], [4, 7], [5, 6], [6, 7]),
]
CLOUD = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (10, 0, 0), (10, 0, 1), (10, 1, 0), (10, 1, 1), (20, 0, 0), (20, 0, 1), (20, 1, 0), (20, 1, 1), (30, 0, 0)]
POINTS = [(1, 1), (7, 0), (4, 6), (9, 6), (0, 14), (2, 19), (9, 17)]
SIMPLICES = [[0, 1], [0, 2], [1, 2], [1, 3], [2, 3], [0, 4], [2, 4], [0, 1, 2], [1, 2, 3], [0, 2, 4]]


def graph_of(spark: SparkSession, edges: list[tuple[int, int]], x: list[float] | None = None, y: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, x, y), edges (src < dst))."""
    n = 1 + max(max(e) for e in edges)
    rows = [(i, float(x[i]) if x else None, y[i] if y else None) for i in range(n)]
    return spark.createDataFrame(rows, "node long, x double, y long"), spark.createDataFrame(sorted({(min(e), max(e)) for e in edges}), "src long, dst long")


def manual_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Eight nodes and thirteen edges."""
    return graph_of(spark, EDGES, X, Y)


def sparse_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Eight nodes and eight edges."""
    return graph_of(spark, SPARSE_EDGES, X, Y)


def second_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Twelve nodes and eighteen edges."""
    return graph_of(spark, SECOND_EDGES)


def manual_hypergraph(spark: SparkSession) -> DataFrame:
    """(he, node) of seventeen hyperedges on eight nodes."""
    return spark.createDataFrame([(i, v) for i, he in enumerate(MEMBERS) for v in he], "he long, node long")


def manual_cloud(spark: SparkSession) -> DataFrame:
    """(node, x) of twelve points in space."""
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(CLOUD)], "node long, x array<double>")


def manual_points(spark: SparkSession) -> DataFrame:
    """(node, x) of seven points in the plane."""
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(POINTS)], "node long, x array<double>")


def manual_complex(spark: SparkSession) -> DataFrame:
    """(rank, key) of five nodes, seven edges and three triangles."""
    keys = [[i] for i in range(5)] + SIMPLICES
    return spark.createDataFrame([(len(k) - 1, k) for k in keys], "rank int, key array<long>")


def with_graph_id(df: DataFrame, graph_id: int = 0) -> DataFrame:
    return df.withColumn("graph_id", F.lit(graph_id).cast("long"))
