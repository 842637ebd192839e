"""Graph operators over edge tables (src, dst) and node tables (node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from . import ranges


def undirected(edges: DataFrame) -> DataFrame:
    """One row src < dst per pair of different ends."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def symmetric(edges: DataFrame, *more: str) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select("src", "dst", *more).union(edges.select("dst", "src", *more)).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree): out-degree with multiplicity of the edges as given, 0 for the rest."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(out, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def one_hot_degrees(degree: DataFrame, most: int) -> DataFrame:
    """(node, x): an array of most + 1 entries with a 1 at the degree; a greater degree is an error."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.when(i == F.col("degree"), 1.0).otherwise(0.0))
    checked = F.when(F.col("degree") <= most, hot).otherwise(F.raise_error(F.concat(F.lit("degree above the maximum: "), F.col("degree").cast("string"))))
    return degree.select("node", checked.alias("x"))


def hashed(*columns: str | Column) -> Column:
    """A hash whose differences are longs, as dense_ids asks."""
    return F.shiftright(F.xxhash64(*columns), 1)


def dense_ids(df: DataFrame, id_col: str, out_col: str, rows: int = 4096) -> DataFrame:
    """df's distinct ids with 0, 1, .. in ascending order, by counts of id ranges and ranks within each."""
    ids = df.select(id_col).distinct()
    at = ids.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not at["n"]:
        return ids.withColumn(out_col, F.lit(0).cast("long"))
    width = max(1, (at["hi"] - at["lo"] + 1) * rows // max(rows, at["n"]))
    ids = ids.withColumn("range", F.floor((F.col(id_col) - F.lit(at["lo"])) / width))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ids.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(id_col)) - 1
    return ids.withColumn("rank", rank).join(starts, "range").select(id_col, (F.col("start") + F.col("rank")).cast("long").alias(out_col))


def without_isolated(edges: DataFrame) -> DataFrame:
    """Edges with ends renumbered 0, 1, .. among the nodes that have an edge."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    ids = dense_ids(ends, "node", "id")
    renamed = edges.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst")
    return renamed.select(F.col("s").alias("src"), F.col("d").alias("dst"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that undirected edges reach; a written table cuts the lineage each round."""
    both = written(symmetric(edges), "edges")
    labels = written(nodes.select("node").distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        near = both.join(labels.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        least = labels.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        hooks = least.where("comp < old").groupBy(F.col("old").alias("node")).agg(F.min("comp").alias("hook"))
        least = written(least.join(hooks, "node", "left").select("node", "old", F.least("comp", F.coalesce("hook", "comp")).alias("comp")), "least")
        jump = least.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = written(least.join(jump, "comp", "left").select("node", "old", F.coalesce("next", "comp").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if not step.where("comp <> old").limit(1).count():
            return labels


def reachable(edges: DataFrame, forward: bool = True) -> DataFrame:
    """All (src, dst) pairs that directed paths join, grown to a fixed point."""
    step = edges.select("src", "dst").distinct() if forward else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    found = written(step, "reach")
    while True:
        more = found.toDF("src", "mid").join(found.toDF("mid", "dst"), "mid").select("src", "dst").union(found).distinct()
        more = written(more, "reach")
        if more.count() == found.count():
            return more
        found = more


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that can be reached and reaches back; for graphs whose closure fits the cluster."""
    far = reachable(edges)
    back = far.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    least = far.intersect(back).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("c"))
    return nodes.select("node").distinct().join(least, "node", "left").select("node", F.least("node", F.coalesce("c", "node")).alias("comp"))


def largest_components(labels: DataFrame, n: int = 1) -> DataFrame:
    """Nodes of the n largest components (of equals the lesser label), renumbered."""
    size = labels.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(n).select("comp")
    kept = labels.join(F.broadcast(size), "comp", "left_semi")  # n labels
    return kept.join(dense_ids(kept, "node", "id"), "node").select("node", "comp", "id")


def khop(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(center, node): every node within k undirected hops of each center, itself included."""
    both = symmetric(edges).toDF("near", "node")
    found = nodes.select(F.col("node").alias("center"), "node")
    for _ in range(k):
        found = found.union(found.toDF("center", "near").join(both, "near").select("center", "node")).distinct()
    return found


def triangles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b, c), a < b < c, of edges; nodes, if they are at hand, save a reading of the edges."""
    ids = edges.select(F.col("src").alias("node")) if nodes is None else nodes.select("node")
    key = F.col("key")
    return ranges.cliques(edges, ids, 3).select(key[0].alias("a"), key[1].alias("b"), key[2].alias("c"))


def forman_curvature(edges: DataFrame, node_weight: DataFrame | None = None) -> DataFrame:
    """(src, dst, curvature) of edges (src, dst, w): w * (wu/w + wv/w - sums over the other edges at each end of
    w_end / sqrt(w * w_other)). Without node weights all are 1; unweighted edges have w = 1."""
    both = edges.select("src", "w").union(edges.select("dst", "w")).toDF("node", "w")
    sums = both.groupBy("node").agg(F.sum(1 / F.sqrt("w")).alias("s"))
    sums = sums.withColumn("nw", F.lit(1.0)) if node_weight is None else sums.join(node_weight, "node")
    e = edges.join(sums.toDF("src", "su", "wu"), "src").join(sums.toDF("dst", "sv", "wv"), "dst")

    def side(s: str, n: str) -> Column:
        return F.col(n) / F.sqrt("w") * (F.col(s) - 1 / F.sqrt("w"))

    return e.select("src", "dst", (F.col("wu") + F.col("wv") - F.col("w") * (side("su", "wu") + side("sv", "wv"))).alias("curvature"))


def rwse(nodes: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(node, step, p): the probability to be back after 1 .. steps of a random walk; degrees count parallel edges, moves
    do not."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    move = edges.select("src", "dst").distinct().join(out.toDF("src", "degree"), "src").select("src", "dst", (1 / F.col("degree")).alias("p"))
    move = written(move, "moves")
    power, found = move, []
    for k in range(1, steps + 1):
        if k > 1:
            power = power.toDF("src", "mid", "p").join(move.toDF("mid", "dst", "q"), "mid").groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
            power = written(power, "power") if k < steps else power  # read by its diagonal and by the next step
        found.append(power.where("src = dst").select(F.col("src").alias("node"), F.lit(k).alias("step"), "p"))
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    steps_of = nodes.select("node").select("node", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return steps_of.join(every, ["node", "step"], "left").select("node", "step", F.coalesce("p", F.lit(0.0)).alias("p"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after some rounds from 1 / n, over both directions; a node without edges gives its rank to all."""
    n = nodes.count()
    both = symmetric(edges)
    out = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = written(nodes.select("node").join(out, "node", "left"), "pagerank-nodes")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    for i in range(rounds):
        got = both.toDF("node", "to").join(ranks.where("degree IS NOT NULL"), "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        lost = ranks.where("degree IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))  # one row
        ranks = nodes.join(got, "node", "left").join(F.broadcast(lost)).select("node", "degree", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        ranks = written(ranks, "pagerank") if i % 4 == 3 else ranks
    return ranks.select("node", "rank")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, coefficient): closed share of the pairs of neighbours, 0 below two neighbours."""
    d = nodes.select("node").join(ranges.closed_paths(edges, nodes.select("node")), "node", "left")
    pairs = F.col("degree") * (F.col("degree") - 1)
    return d.select("node", F.when(pairs > 0, 2 * F.col("t") / pairs).otherwise(0.0).alias("coefficient"))


def gcn_propagate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, x): D^-1/2 (A + I) D^-1/2 x of nodes (node, x)."""
    links = symmetric(edges).union(nodes.select("node", "node"))
    d = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    x = nodes.select("node", "x").join(d, "node").select("node", (F.col("x") / F.sqrt("d")).alias("v"))
    got = links.join(x.toDF("src", "v"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("v").alias("s"))
    return got.join(d, "node").select("node", (F.col("s") / F.sqrt("d")).alias("x"))
