"""Simplicial complexes as cell tables (rank, key): liftings, incidence, and the algebra of neighbourhoods.

A key is the ascending array of a cell's vertices. Operators between cells are tables (row, col, val) of keys.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import symmetric
from .ranges import cliques, graph_of


def clique_lifting(nodes: DataFrame, edges: DataFrame, dim: int = 2, only: int | None = None) -> DataFrame:
    """Cells (rank, key) of all cliques of up to dim + 1 nodes, or those of rank `only`; a rank over 3 is grown from the last
    by common neighbours."""
    dim = dim if only is None else min(dim, only)
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ranks = [nodes.select(F.array("node").alias("key")), pairs.select(F.array("a", "b").alias("key"))]
    if dim >= 2:
        graph = graph_of(edges, nodes.select("node"))  # written once for both ranks
        ranks += [cliques(graph, nodes.select("node"), r + 1) for r in range(2, min(dim, 3) + 1)]
    for r in range(4, dim + 1):
        grown = ranks[-1].join(edges, F.element_at("key", -1) == F.col("src")).select("key", "dst")
        for i in range(r - 1):
            grown = grown.withColumn("at", F.get("key", F.lit(i))).join(edges.toDF("at", "dst", *edges.columns[2:]).select("at", "dst"), ["at", "dst"], "left_semi")
        ranks.append(grown.select(F.concat("key", F.array("dst")).alias("key")))
    return reduce(DataFrame.union, (k.select(F.lit(r).alias("rank"), "key") for r, k in enumerate(ranks[: dim + 1]) if only in (None, r)))


def incidence(cells: DataFrame, rank: int, signed: bool = False) -> DataFrame:
    """(row, col, val) of cells of `rank` over their facets; deleting the i-th vertex has the sign (-1)^i."""
    own = cells.where(F.col("rank") == rank)
    faces = F.transform(F.sequence(F.lit(0), F.lit(rank)), lambda i: F.struct(F.filter("key", lambda _, j: j != i).alias("row"), i.alias("i")))
    out = own.select(F.col("key").alias("col"), F.explode(faces).alias("f"))
    sign = F.when(F.col("f.i") % 2 == 0, 1.0).otherwise(-1.0) if signed else F.lit(1.0)
    return out.select("f.row", "col", sign.alias("val"))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sparse matrix product of two tables (row, col, val), zeros dropped."""
    both = left.toDF("row", "mid", "a").join(right.toDF("mid", "col", "b"), "mid")
    return both.groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("val")).where("val <> 0")


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def without_sign(m: DataFrame, signed: bool) -> DataFrame:
    return m if signed else m.withColumn("val", F.abs("val"))


def up_laplacian(cells: DataFrame, rank: int, signed: bool = False) -> DataFrame:
    b = incidence(cells, rank + 1, True)
    return without_sign(product(b, transposed(b)), signed)


def down_laplacian(cells: DataFrame, rank: int, signed: bool = False) -> DataFrame:
    b = incidence(cells, rank, True)
    return without_sign(product(transposed(b), b), signed)


def hodge_laplacian(cells: DataFrame, rank: int, signed: bool = False) -> DataFrame:
    parts = [up_laplacian(cells, rank, True)] + ([down_laplacian(cells, rank, True)] if rank else [])
    both = reduce(DataFrame.union, parts).groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0")
    return without_sign(both, signed)


def off_diagonal(m: DataFrame) -> DataFrame:
    return m.where("row <> col").withColumn("val", F.lit(1.0))


def chain(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Which cells of rank `high` lie over which of rank `low`, as ones."""
    steps = [incidence(cells, r) for r in range(low + 1, high + 1)]
    return reduce(product, steps).withColumn("val", F.lit(1.0))


def neighborhood(cells: DataFrame, name: str, signed: bool = False) -> DataFrame:
    """The operator of a name `[r-]{up,down}_{adjacency,laplacian,incidence}-{rank}` or `hodge_laplacian-{rank}`."""
    m = re.fullmatch(r"(?:(\d+)-)?(up|down)_(adjacency|laplacian|incidence)-(\d+)", name)
    if h := re.fullmatch(r"hodge_laplacian-(\d+)", name):
        return hodge_laplacian(cells, int(h[1]), signed)
    if not m:
        raise ValueError(f"no such neighbourhood: {name}")
    steps, way, kind, rank = int(m[1] or 1), m[2], m[3], int(m[4])
    if steps == 1:
        if kind == "incidence":
            return transposed(incidence(cells, rank + 1, signed)) if way == "up" else incidence(cells, rank, signed)
        found = (up_laplacian if way == "up" else down_laplacian)(cells, rank, signed)
        return found if kind == "laplacian" else off_diagonal(found)
    b = chain(cells, rank, rank + steps) if way == "up" else chain(cells, rank - steps, rank)
    if kind == "incidence":
        return transposed(b) if way == "up" else b
    square = product(b, transposed(b)) if way == "up" else product(transposed(b), b)
    return off_diagonal(square) if kind == "adjacency" else square.withColumn("val", F.lit(1.0))


def route(name: str) -> tuple[int, int]:
    """Ranks (source, destination) that a neighbourhood's name stands for."""
    steps, rank = int(name.split("-")[0]) if name[0].isdigit() else 1, int(name.rsplit("-", 1)[1])
    return rank, rank - steps if "down" in name else rank + steps


def projection_sum(x: DataFrame, b: DataFrame) -> DataFrame:
    """(cell, x): the sums of |val| * x over each column's rows; x is (cell, x) with numbers."""
    joined = b.join(x.toDF("row", "x"), "row")
    return joined.groupBy(F.col("col").alias("cell")).agg(F.sum(F.abs("val") * F.col("x")).alias("x"))


def concatenation(x: DataFrame, b: DataFrame) -> DataFrame:
    """(cell, x): the arrays of each column's rows, in ascending order of the rows, one after the other. Cells with
    boundaries of several sizes are an error."""
    joined = b.join(x.toDF("row", "x"), "row").groupBy(F.col("col").alias("cell"))
    made = joined.agg(F.array_sort(F.collect_list(F.struct("row", "x"))).alias("parts"))
    same = F.size("parts") == F.size("cell")
    parts = F.when(same, F.flatten(F.transform("parts", lambda p: p["x"]))).otherwise(F.raise_error(F.lit("boundaries of unequal size")))
    return made.select("cell", parts.alias("x"))


def set_lifting(cells: DataFrame, rank: int) -> DataFrame:
    """(cell, x): each cell's vertices."""
    return cells.where(F.col("rank") == rank).select(F.col("key").alias("cell"), F.col("key").alias("x"))


def coface_lifting(cells: DataFrame) -> DataFrame:
    """3-cells of a combinatorial complex: each triangle's vertices with those of all triangles that share an edge."""
    b = incidence(cells, 2)
    near = b.select("row", "col").join(b.select("row", F.col("col").alias("other")), "row")
    key = F.array_sort(F.array_distinct(F.flatten(F.collect_set("other"))))
    return near.groupBy("col").agg(key.alias("key")).select("key").distinct()


def maximal_triangles(cells: DataFrame) -> DataFrame:
    """Triangles in no tetrahedron; cells must reach rank 3."""
    inside = incidence(cells, 3).select(F.col("row").alias("key")).distinct()
    return cells.where("rank = 2").select("key").join(inside, "key", "left_anti")


def text(key: str | Column) -> Column:
    return F.array_join(F.col(key).cast("array<string>") if isinstance(key, str) else key.cast("array<string>"), "-")


def line_graph(edges: DataFrame) -> DataFrame:
    """Pairs (row < col) of edges that share an end, keys being the edges' ends."""
    ends = edges.select(F.array("src", "dst").alias("key"), F.explode(F.array("src", "dst")).alias("node"))
    return ends.toDF("row", "node").join(ends.toDF("col", "node"), "node").where("row < col").select("row", "col").distinct()


def neighborhood_complex(edges: DataFrame) -> DataFrame:
    """(node, member): a node with the nodes two hops away, less its neighbours."""
    both = symmetric(edges)
    two = both.toDF("node", "mid").join(both.toDF("mid", "member"), "mid").select("node", "member")
    own = both.select(F.col("src").alias("node"), F.col("src").alias("member"))
    return two.union(own).distinct().join(both.toDF("node", "member"), ["node", "member"], "left_anti")
