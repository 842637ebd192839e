"""Liftings of graphs to simplicial complexes, as cell tables (rank, key), and what is computed on their cells."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .complex import clique_lifting, hodge_laplacian, incidence, down_laplacian, neighborhood, off_diagonal, up_laplacian
from .graph import clustering, degrees, dense_ids, khop, pagerank, symmetric, triangles, undirected
from .ranges import curvature


def ordered_subsets(sets: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """(center, key): the subsets of `size` nodes of each centre's set (center, node), keys ascending.

    With `most`, the first most + 1 of each centre in the order of their keys; these lie among its least most + size
    nodes, so a hub gives no more pairs than they have.
    """
    own = sets.select("center", "node").distinct()
    if most is not None:
        place = F.row_number().over(Window.partitionBy("center").orderBy("node"))
        own = own.withColumn("place", place).where(F.col("place") <= most + size).drop("place")
    found = own.select("center", F.array("node").alias("key"))
    for _ in range(size - 1):
        found = found.join(own, "center").where(F.col("node") > F.element_at("key", -1)).select("center", F.concat("key", F.array("node")).alias("key"))
    if most is None:
        return found
    place = F.row_number().over(Window.partitionBy("center").orderBy("key"))
    return found.withColumn("place", place).where(F.col("place") <= most + 1).drop("place")


def closure(keys: DataFrame, largest: int) -> DataFrame:
    """(rank, key): all faces of keys with at most `largest` vertices, once each."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("key")) - 1)
    face = F.filter("key", lambda _, i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    faces = keys.where(F.size("key") <= largest).select("key", F.explode(masks).alias("mask")).select(face.alias("key")).distinct()
    return faces.select((F.size("key") - 1).alias("rank"), "key")


def complex_of(nodes: DataFrame, edges: DataFrame, tops: Iterable[DataFrame], dim: int) -> DataFrame:
    """(rank, key): the nodes, the edges (src < dst) and all faces of the tops' keys."""
    keys = [nodes.select(F.array("node").alias("key")), edges.select(F.array("src", "dst").alias("key")), *(t.select("key") for t in tops)]
    return closure(reduce(DataFrame.union, keys), dim + 1)


def neighbourhoods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(center, node): each node with its neighbours and itself."""
    return symmetric(edges).toDF("center", "node").union(nodes.select(F.col("node").alias("center"), "node")).distinct()


def khop_complex(nodes: DataFrame, edges: DataFrame, dim: int = 2, most: int | None = None) -> DataFrame:
    """The graph, and the subsets of 3 to dim + 1 nodes of each closed neighbourhood; with `most`, the first most + 1 of
    each centre and size, in order where the usual definition draws them at random."""
    near = neighbourhoods(nodes, edges)
    return complex_of(nodes, edges, [ordered_subsets(near, s, most) for s in range(3, dim + 2)], dim)


def far_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(center, node): each node, and those two steps away, less its neighbours."""
    both = symmetric(edges)
    two = both.toDF("center", "mid").join(both.toDF("mid", "node"), "mid").select("center", "node")
    own = nodes.select(F.col("node").alias("center"), "node")
    return two.union(own).distinct().join(both.toDF("center", "node"), ["center", "node"], "left_anti")


def neighborhood_cells(nodes: DataFrame, edges: DataFrame, dim: int = 2, most: int | None = None) -> DataFrame:
    """The graph, and the subsets of 3 to dim + 1 nodes of each node's far_neighbours, as khop_complex takes them."""
    far = far_neighbours(nodes, edges)
    return complex_of(nodes, edges, [ordered_subsets(far, s, most) for s in range(3, dim + 2)], dim)


def connected_subsets(edges: DataFrame, size: int) -> DataFrame:
    """(key): all sets of `size` nodes that induce a connected graph, grown by a neighbour at a time."""
    both = symmetric(edges).toDF("near", "node")
    found = edges.select(F.array("src", "dst").alias("key"))
    for _ in range(size - 2):
        grown = found.select("key", F.explode("key").alias("near")).join(both, "near").where(~F.array_contains("key", F.col("node")))
        found = grown.select(F.array_sort(F.concat("key", F.array("node"))).alias("key")).distinct()
    return found


def induced_complex(nodes: DataFrame, edges: DataFrame, dim: int = 2) -> DataFrame:
    """The graph and all connected sets of 3 to dim + 1 nodes, with their faces."""
    return complex_of(nodes, edges, [connected_subsets(edges, s) for s in range(3, dim + 2)], dim)


def distances(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(center, node, d): steps between nodes that paths of at most `most` edges join (None: any), 0 to itself. A written
    table ends each step; only the last step's front is joined."""
    both = symmetric(edges).toDF("near", "node")
    front = nodes.select(F.col("node").alias("center"), "node", F.lit(0).alias("d"))
    found, d = written(front, "distances"), 0
    front = found
    while most is None or d < most:
        d += 1
        step = front.select("center", F.col("node").alias("near")).join(both, "near").select("center", "node").distinct()
        front = written(step.join(found, ["center", "node"], "left_anti").withColumn("d", F.lit(d)), "front")
        if not front.limit(1).count():
            break
        found = found.union(front)
    return found


def vietoris_rips(nodes: DataFrame, edges: DataFrame, dim: int = 2, threshold: int = 1, most: int | None = None) -> DataFrame:
    """The graph and the cliques of 3 to dim + 1 nodes that are within `threshold` steps of each other; with `most`, of
    each node and size those among its first `most` in the order of keys."""
    near = distances(nodes, edges, threshold).where("center < node").select(F.col("center").alias("src"), F.col("node").alias("dst"))
    cliques = clique_lifting(nodes, near, dim).where("rank >= 2")
    if most is not None:
        place = F.row_number().over(Window.partitionBy("node", "rank").orderBy("key"))
        cliques = cliques.withColumn("node", F.explode("key")).withColumn("place", place).where(F.col("place") <= most).select("rank", "key").distinct()
    return complex_of(nodes, edges, [cliques], dim)


def eccentricities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, eccentricity): the steps to the farthest node; an error where some node cannot be reached."""
    far = distances(nodes, edges).groupBy(F.col("center").alias("node")).agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"))
    all_of = nodes.agg(F.count(F.lit(1)).alias("total"))
    checked = F.when(F.col("n") == F.col("total"), F.col("d")).otherwise(F.raise_error(F.lit("the graph is not connected")))
    return far.crossJoin(F.broadcast(all_of)).select("node", checked.alias("eccentricity"))  # one row


def eccentricity_complex(nodes: DataFrame, edges: DataFrame, dim: int = 2, most_nodes: int = 2000) -> DataFrame:
    """All subsets of 1 to dim nodes: a neighbourhood as wide as the eccentricity is the whole connected graph. The number
    of cells is a power of the number of nodes, so more than most_nodes are an error."""
    if nodes.limit(most_nodes + 1).count() > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes")
    whole = eccentricities(nodes, edges).select(F.lit(0).alias("center"), "node")
    sets = [ordered_subsets(whole, s).select("key") for s in range(1, dim + 1)]
    return closure(reduce(DataFrame.union, sets), dim)


def line_complex(nodes: DataFrame, edges: DataFrame, dim: int = 2, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edge ids, cells): the clique complex of the line graph. Edges are its vertices, numbered in order; the edge ids
    (id, src, dst, x) carry the mean of the ends' x where nodes have it. Its cliques are edges of one node, or the sides of a triangle; with
    `most`, the first most + 1 of each size of these."""
    order = edges.select("src", "dst").distinct()
    place = dense_ids(order.select("src").distinct(), "src", "at")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    sizes = order.groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(place, "src").select("src", "at", "n")
    ids = order.select("src", "dst", rank.alias("rank")).join(with_starts(sizes, "at", "n"), "src").select((F.col("start") + F.col("rank") - 1).cast("long").alias("id"), "src", "dst")
    ids = written(ids, "line-ids")
    stars = ids.select(F.explode(F.array("src", "dst")).alias("of"), F.col("id").alias("node")).select(F.struct(F.lit(0).alias("kind"), F.col("of").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("center"), "node")
    tri = triangles(edges).select("a", "b", "c", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("a").alias("src"), F.col("c").alias("dst")), F.struct(F.col("b").alias("src"), F.col("c").alias("dst")))).alias("e"))
    sides = tri.select(F.struct(F.lit(1).alias("kind"), "a", "b", "c").alias("center"), "e.src", "e.dst").join(ids, ["src", "dst"]).select("center", F.col("id").alias("node"))
    sets = stars.union(sides)
    tops = [ordered_subsets(sets, s, most) for s in range(2, dim + 2)]
    cells = closure(reduce(DataFrame.union, [ids.select(F.array("id").alias("key")), *(t.select("key") for t in tops)]), dim + 1)
    if "x" in nodes.columns:
        x = nodes.select("node", "x")
        ids = ids.join(x.toDF("src", "xs"), "src").join(x.toDF("dst", "xd"), "dst").select("id", "src", "dst", ((F.col("xs") + F.col("xd")) / 2).alias("x"))
    return ids, cells


def with_starts(sizes: DataFrame, at: str, n: str, rows: int = 4096) -> DataFrame:
    """sizes with start, the sum of n over lesser `at`: sums within ranges of `at`, which are 0, 1, .., and of ranges."""
    ranged = sizes.withColumn("range", F.floor(F.col(at) / rows))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum(n).alias("total"))
    totals = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("own", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return summed.join(totals, "range").withColumn("start", F.col("base") + F.col("own")).drop("range", "base", "own")


def eigenvector_centrality(nodes: DataFrame, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, centrality): power iteration of A + 1 from equal values, of unit length."""
    both = written(symmetric(edges), "edges")
    x = nodes.select("node", F.lit(1.0).alias("v"))
    for i in range(rounds):
        got = both.toDF("near", "node").join(x.toDF("near", "v"), "near").groupBy("node").agg(F.sum("v").alias("s"))
        x = x.join(got, "node", "left").select("node", (F.col("v") + F.coalesce("s", F.lit(0.0))).alias("v"))
        if i % 4 == 3 or i == rounds - 1:
            norm = x.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
            x = written(x.crossJoin(F.broadcast(norm)).select("node", (F.col("v") / F.col("norm")).alias("v")), "centrality")  # one row
    return x.withColumnRenamed("v", "centrality")


def dice_radii(nodes: DataFrame, edges: DataFrame, dim: int = 2, seed: int = 0) -> DataFrame:
    """(node, size, radius): a die of 20 sides, by hash, plus 20 times an attribute of the node, over 10. The attribute is
    degree centrality for pairs, clustering for triples, eigenvector centrality for four nodes, PageRank above."""
    n = nodes.count()
    attributes = [
        lambda: degrees(nodes, symmetric(edges)).select("node", (F.col("degree") / max(1, n - 1)).alias("v")),
        lambda: clustering(nodes, edges).toDF("node", "v"),
        lambda: eigenvector_centrality(nodes, edges).toDF("node", "v"),
        lambda: pagerank(nodes, edges).toDF("node", "v"),
    ]
    out = []
    for k in range(1, dim + 1):
        die = F.pmod(F.xxhash64("node", F.lit(k), F.lit(seed)), F.lit(20)) + 1
        out.append(attributes[min(k, 4) - 1]().select("node", F.lit(k + 1).alias("size"), F.floor((die + F.floor(F.col("v") * 20)) / 10).alias("radius")))
    return reduce(DataFrame.union, out)


def dice_complex(nodes: DataFrame, edges: DataFrame, dim: int = 2, most: int = 10, seed: int = 0) -> DataFrame:
    """Of each node and size, the first most + 1 subsets of the nodes within the radius that a die gives, the node first,
    the others in hashed order; with their faces."""
    radii = written(dice_radii(nodes, edges, dim, seed), "radii")
    widest = radii.agg(F.max("radius")).first()[0] or 0
    near = distances(nodes, edges, int(widest)).toDF("center", "member", "d")
    near = near.join(radii.toDF("center", "size", "radius"), "center").where("d <= radius")
    turn = F.when(F.col("member") == F.col("center"), F.lit(-(1 << 63))).otherwise(F.xxhash64("center", "member", F.lit(seed)))
    place = F.row_number().over(Window.partitionBy("center", "size").orderBy(turn, "member"))
    near = near.withColumn("place", place).where(F.col("place") <= most + F.col("size"))
    tops = []
    for size in range(2, dim + 2):
        own = near.where(F.col("size") == size)
        picks = ordered_subsets(own.select("center", F.col("place").alias("node")), size, most)  # in the order of places
        named = picks.withColumn("pick", F.monotonically_increasing_id()).select("center", "pick", F.explode("key").alias("place")).join(own.select("center", "place", "member"), ["center", "place"])
        tops.append(named.groupBy("center", "pick").agg(F.array_sort(F.collect_list("member")).alias("key")).select("key"))
    return closure(reduce(DataFrame.union, [nodes.select(F.array("node").alias("key")), *tops]), dim + 1)


def cell_counts(cells: DataFrame, max_rank: int) -> list[int]:
    """How many cells each rank has, 0 for those without; the shape of a complex."""
    counts = {r["rank"]: r["count"] for r in cells.groupBy("rank").count().collect()}
    return [counts.get(r, 0) for r in range(max_rank + 1)]


def connectivity(cells: DataFrame, max_rank: int, signed: bool = False, neighborhoods: list[str] | None = None) -> dict[str, DataFrame]:
    """The operators of every rank by name, tables (row, col, val): incidence, down_laplacian, up_laplacian, adjacency,
    coadjacency, hodge_laplacian. Those that a rank hasn't got are empty. With `neighborhoods`, those by their names, and
    all incidences."""
    empty = incidence(cells.where("false"), 1, signed)
    out = {"incidence_0": cells.where("rank = 0").select(F.array().cast("array<bigint>").alias("row"), F.col("key").alias("col"), F.lit(1.0).alias("val"))}
    for r in range(max_rank + 1):
        if r:
            out[f"incidence_{r}"] = incidence(cells, r, signed)
        if neighborhoods is not None:
            continue
        up = up_laplacian(cells, r, signed) if r < max_rank else empty
        down = down_laplacian(cells, r, signed) if r else empty
        whole = hodge_laplacian(cells, r, signed) if r < max_rank else down
        out |= {f"down_laplacian_{r}": down, f"up_laplacian_{r}": up, f"adjacency_{r}": off_diagonal(up), f"coadjacency_{r}": off_diagonal(down), f"hodge_laplacian_{r}": whole}
    for name in neighborhoods or []:
        out[name] = neighborhood(cells, name, signed)
    return out


def zero_connectivity(like: DataFrame) -> DataFrame:
    """An operator without entries, of the kind of `like`."""
    return like.where("false")


def edge_features(cells: DataFrame, edges: DataFrame, x: DataFrame, strict: bool = True) -> DataFrame | None:
    """(key, x) of the 1-cells from edge features (src, dst, x). Where the lifting added edges, an error if strict, as for
    simplicial complexes, and None otherwise, as for cell complexes."""
    n, m = cells.where("rank = 1").count(), undirected(edges).count()
    if n != m:
        if strict:
            raise ValueError(f"{n} 1-cells for {m} edges with features")
        return None
    return undirected_features(x).select(F.array("src", "dst").alias("key"), "x")


def undirected_features(x: DataFrame) -> DataFrame:
    """One row src < dst of features (src, dst, x); of several the greatest."""
    return x.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("x").alias("x"))


def simplicial_curvature(cells: DataFrame) -> dict[int, DataFrame]:
    """(key, curvature) of ranks 1, 0 and 2: an edge has 4 less the degrees of its ends plus 3 for each triangle on it; a
    node the sum over its edges; a triangle 3, plus its tetrahedra, less, over the other triangles, shared edges less
    shared tetrahedra."""
    b1, b2, b3 = (incidence(cells, r) for r in (1, 2, 3))
    node_degree = b1.groupBy("row").agg(F.count(F.lit(1)).alias("d"))
    edge_degree = b2.groupBy(F.col("row").alias("key")).agg(F.count(F.lit(1)).alias("t"))
    ends = b1.join(node_degree, "row").groupBy(F.col("col").alias("key")).agg(F.sum("d").alias("d"))
    one = ends.join(edge_degree, "key", "left").select("key", (4.0 - F.col("d") + 3 * F.coalesce("t", F.lit(0))).alias("curvature"))
    zero = b1.join(one.withColumnRenamed("key", "col"), "col").groupBy(F.col("row").alias("key")).agg(F.sum("curvature").alias("curvature"))
    lonely = cells.where("rank = 0").select("key").join(zero, "key", "left").select("key", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))
    # Over an edge with t triangles each has t - 1 others; over a tetrahedron each of its triangles has 3 others.
    shared = b2.join(edge_degree.withColumnRenamed("key", "row"), "row").groupBy(F.col("col").alias("key")).agg(F.sum(F.col("t") - 1).alias("shared"))
    tops = b3.groupBy(F.col("row").alias("key")).agg(F.count(F.lit(1)).alias("tets"))
    tets = F.coalesce("tets", F.lit(0))
    two = shared.join(tops, "key", "left").select("key", (3.0 + tets - (F.col("shared") - 3 * tets)).alias("curvature"))
    return {1: one, 0: lonely, 2: two}


def clique_curvature(nodes: DataFrame, edges: DataFrame, ranks: Iterable[int] = (0, 1, 2)) -> dict[int, DataFrame]:
    """simplicial_curvature of the clique complex of a graph, of the ranks asked for, without a table of cells."""
    ids = nodes.select("node")
    made = {r: curvature(edges, ids, r) for r in ranks}
    if 0 in made:
        zero = nodes.select(F.array("node").alias("key")).join(made[0], "key", "left")
        made[0] = zero.select("key", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))
    return made


def from_adjacency(nodes: DataFrame, adjacency: DataFrame, dim: int = 2) -> DataFrame:
    """The cells that node ids and the entries (row, col) of an adjacency stand for, up to `dim`, by common neighbours."""
    edges = undirected(adjacency.select(F.col("row").alias("src"), F.col("col").alias("dst")))
    return clique_lifting(nodes, edges, dim)


def redefined(nodes: DataFrame, adjacency: DataFrame, dim: int, neighborhoods: list[str] | None = None, signed: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The complex rebuilt from its nodes and adjacency, and its operators anew."""
    cells = written(from_adjacency(nodes, adjacency, dim), "cells")
    return cells, connectivity(cells, dim, signed, neighborhoods)


def khop_sets(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(center, node) of all nodes within k steps."""
    return khop(nodes, edges, k)
