"""Combinatorial complexes (rank, key), their operators, and liftings that make them; configurations of agents on a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .complex import off_diagonal, product, transposed
from .graph import components, dense_ids, hashed, triangles
from .hypergraph import containment_rank


def containment(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(row, col, val): cells of rank `low` whose vertices all are in one of rank `high`."""
    small = cells.where(F.col("rank") == low).select(F.col("key").alias("row"), F.size("key").alias("n"), F.explode("key").alias("node"))
    large = cells.where(F.col("rank") == high).select(F.col("key").alias("col"), F.explode("key").alias("node"))
    both = small.join(large, "node").groupBy("row", "col", "n").agg(F.count(F.lit(1)).alias("common"))
    return both.where("common = n").select("row", "col", F.lit(1.0).alias("val"))


def combinatorial_connectivity(cells: DataFrame, max_rank: int) -> dict[str, DataFrame]:
    """incidence_r between ranks r - 1 and r by containment; up_laplacian_r and down_laplacian_r from them, adjacency_r and
    coadjacency_r without their diagonals, hodge_laplacian_r their sum. Ranks without cells give empty tables."""
    b = {r: containment(cells, r - 1, r) for r in range(1, max_rank + 1)}
    empty = containment(cells.where("false"), 0, 1)
    out = {f"incidence_{r}": m for r, m in b.items()}
    for r in range(max_rank + 1):
        up = product(b[r + 1], transposed(b[r + 1])) if r + 1 in b else empty
        down = product(transposed(b[r]), b[r]) if r in b else empty
        whole = up.union(down).groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0")
        out |= {f"up_laplacian_{r}": up, f"down_laplacian_{r}": down, f"adjacency_{r}": off_diagonal(up), f"coadjacency_{r}": off_diagonal(down), f"hodge_laplacian_{r}": whole}
    return out


def universal_strict(members: DataFrame) -> DataFrame:
    """(rank, key): each distinct hyperedge with one more than the greatest rank of those properly inside it, at least 1
    from two nodes on; the nodes have rank 0."""
    ranks = containment_rank(members)
    keys = members.join(ranks, "he").groupBy("he", "rank").agg(F.array_sort(F.collect_set("node")).alias("key"))
    nodes = members.select(F.lit(0).alias("rank"), F.array("node").alias("key"))
    return keys.select("rank", "key").union(nodes).distinct()


def maximal_triples(edges: DataFrame) -> DataFrame:
    """(id, a, b, c): triangles that no fourth node is joined to wholly; ids are hashes of the nodes."""
    tri = triangles(edges)
    out = tri.join(edges.toDF("a", "x", *edges.columns[2:]).select("a", "x"), "a").join(edges.select(F.col("src").alias("b"), F.col("dst").alias("x")), ["b", "x"])
    four = out.join(edges.select(F.col("src").alias("c"), F.col("dst").alias("x")), ["c", "x"]).select("a", "b", "c", "x")  # a < b < c < x
    faces = reduce(DataFrame.union, (four.select(*(F.col(x).alias(y) for x, y in zip(k, "abc", strict=True))) for k in ("abc", "abx", "acx", "bcx")))
    return written(tri.join(faces.distinct(), ["a", "b", "c"], "left_anti").select(F.xxhash64("a", "b", "c").alias("id"), "a", "b", "c"), "triples")


def triangle_induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rank, key): the graph, and unions of maximal triangles. A 2-cell joins a chain of triangles of which each two
    neighbours share exactly one node, or exactly two; a 3-cell one of which they share any. A triangle that shares
    nothing makes no cell.

    Sharing an edge, or any node, goes through that edge or node, so no pairs are made; sharing exactly one node needs the
    pairs of triangles at a node.
    """
    tri = maximal_triples(edges)
    at = tri.select("id", F.explode(F.array("a", "b", "c")).alias("node"))
    sides = tri.select("id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("a"), F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("side")).select("id", "side.a", "side.b")

    def hub_pairs(rows: DataFrame, *by: str) -> DataFrame:
        hubs = rows.groupBy(*by).agg(F.min("id").alias("hub"))
        return rows.join(hubs, [*by]).where("id <> hub").select(F.col("id").alias("src"), F.col("hub").alias("dst"))

    pairs = at.toDF("src", "node").join(at.toDF("dst", "node"), "node").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    cells = [(0, nodes.select(F.array("node").alias("key"))), (1, edges.select(F.array("src", "dst").alias("key")))]
    for rank, links in ((2, pairs.where("n = 1").select("src", "dst")), (2, hub_pairs(sides, "a", "b")), (3, hub_pairs(at, "node"))):
        links = written(links, "links")
        comps = components(links.select(F.col("src").alias("node")).union(links.select("dst")), links)
        joined = at.join(comps.toDF("id", "comp"), "id").groupBy("comp").agg(F.array_sort(F.collect_set("node")).alias("key"))
        cells.append((rank, joined.select("key")))
    return reduce(DataFrame.union, (k.select(F.lit(r).alias("rank"), "key") for r, k in cells)).distinct()


def configurations(nodes: DataFrame, edges: DataFrame, k: int = 2) -> DataFrame:
    """(rank, key) of the cubical complex of k agents on a graph: a key names each agent's place in order, a node as
    `v` or an edge as `u~v`; places have no node in common; the rank, at most 2, is the number of edges."""
    if k < 2:
        raise ValueError("two agents at least")
    places = nodes.select(F.col("node").cast("string").alias("name"), F.array("node").alias("of"), F.lit(0).alias("edge"))
    places = places.union(edges.select(F.concat_ws("~", "src", "dst"), F.array("src", "dst"), F.lit(1)))
    found = places.select(F.array("name").alias("key"), "of", F.col("edge").alias("rank"))
    for _ in range(k - 1):
        more = found.crossJoin(places.toDF("name", "own", "edge")).where(~F.arrays_overlap("of", "own") & (F.col("rank") + F.col("edge") <= 2))
        found = more.select(F.concat("key", F.array("name")).alias("key"), F.concat("of", "own").alias("of"), (F.col("rank") + F.col("edge")).alias("rank"))
    return found.select("rank", "key")


def configuration_features(cells: DataFrame, x: DataFrame, how: str = "mean") -> DataFrame:
    """(key, x) of the 0-cells of configurations from numbers (node, x): mean, sum, or concat (an array, agents in order)."""
    rows = cells.where("rank = 0").select("key", F.posexplode("key").alias("agent", "node"))
    joined = rows.withColumn("node", F.col("node").cast("long")).join(x, "node").groupBy("key")
    if how == "concat":
        return joined.agg(F.transform(F.array_sort(F.collect_list(F.struct("agent", "x"))), lambda s: s["x"]).alias("x"))
    return joined.agg({"mean": F.avg, "sum": F.sum}[how]("x").alias("x"))


def key_ids(cells: DataFrame, rank: int) -> DataFrame:
    """(key, id): the cells of a rank numbered 0, 1, .. in the order of hashes of their keys."""
    own = cells.where(F.col("rank") == rank).select("key", hashed("key").alias("h"))
    return own.join(dense_ids(own, "h", "id"), "h").select("key", "id")
