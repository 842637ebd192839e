"""Hypergraph operators over member tables (he, node)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written


def khop_hyperedges(reach: DataFrame) -> DataFrame:
    """(he, node): the hyperedge of a centre holds the nodes within k hops; reach is (center, node)."""
    return reach.select(F.col("center").alias("he"), "node")


def with_singletons(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """members, and a hyperedge of its own, numbered after the others, for each node without one."""
    lone = nodes.select("node").join(members, "node", "left_anti").withColumn("he", F.col("node"))
    top = members.agg(F.coalesce(F.max("he"), F.lit(-1)).alias("top"))
    return members.select("he", "node").union(lone.crossJoin(F.broadcast(top)).select((F.col("he") + F.col("top") + 1).alias("he"), "node"))


def label_counts(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(he, y, n): how many members of a hyperedge have each label."""
    return members.join(labels, "node").groupBy("he", "y").agg(F.count(F.lit(1)).alias("n"))


def group_homophily(members: DataFrame, labels: DataFrame, top_k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For the top_k most frequent hyperedge sizes k other than 1 (of equals the lesser): D (k, node, t, n), how many
    size-k hyperedges of a node have t members of its label; Dt (k, y, t, share), the same over classes, normalised over
    t; B (k, y, t, share), what members drawn at random would give."""
    size = members.groupBy("he").agg(F.count(F.lit(1)).cast("int").alias("k"))
    kinds = size.where("k > 1").groupBy("k").count().orderBy(F.desc("count"), "k").limit(top_k).select("k")
    own = members.join(size.join(F.broadcast(kinds), "k"), "he").join(labels, "node")  # top_k sizes
    same = own.groupBy("he", "y").agg(F.count(F.lit(1)).alias("t"))
    d = own.join(same, ["he", "y"]).groupBy("k", "node", "y", "t").agg(F.count(F.lit(1)).alias("n"))
    dt = d.groupBy("k", "y", "t").agg(F.sum("n").alias("n"))
    dt = dt.select("k", "y", "t", (F.col("n") / F.sum("n").over(Window.partitionBy("k", "y"))).alias("share"))
    classes = labels.groupBy("y").agg(F.count(F.lit(1)).alias("nc")).withColumn("n", F.sum("nc").over(Window.partitionBy()))

    def log_choose(n, k):
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    def log_factorial(n):  # ln n! by Stirling's series, exact to 1e-10 from 10 on, by a product below
        small = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
        m = (n + 1).cast("double")
        large = (m - 0.5) * F.log(m) - m + F.lit(0.9189385332046727) + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * F.pow(m, F.lit(5)))
        return F.when(n < 10, small).otherwise(large)

    b = kinds.crossJoin(classes).select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("t"))
    fits = (F.col("t") - 1 <= F.col("nc") - 1) & (F.col("k") - F.col("t") <= F.col("n") - F.col("nc"))
    k, t, n, nc = (F.col(c) for c in ("k", "t", "n", "nc"))
    chance = F.exp(log_choose(nc - 1, t - 1) + log_choose(n - nc, k - t) - log_choose(n - 1, k - 1))
    return d.select("k", "node", "t", "n"), dt, b.select("k", "y", "t", F.when(fits, chance).otherwise(0.0).alias("share"))


def normalised_bias(d: DataFrame, b: DataFrame) -> DataFrame:
    """(k, y, t, bias): (D - B) / (1 - B) above the baseline, (D - B) / B below it."""
    both = b.withColumnRenamed("share", "base").join(d.withColumnRenamed("share", "seen"), ["k", "y", "t"], "left").fillna(0.0, ["seen"])
    s, base = F.col("seen"), F.col("base")
    bias = F.when(s >= base, F.when(base < 1, (s - base) / (1 - base)).otherwise(0.0)).otherwise((s - base) / base)
    return both.select("k", "y", "t", bias.alias("bias"))


def message_homophily(members: DataFrame, labels: DataFrame, steps: int = 3) -> DataFrame:
    """(step, node, y, p): step 0 takes for each node the mean of its hyperedges' label shares; each later step spreads
    node values to hyperedges and back."""
    members = written(members, "members")
    share = label_counts(members, labels)
    edge = share.select("he", "y", (F.col("n") / F.sum("n").over(Window.partitionBy("he"))).alias("p"))
    found = []
    count_he = members.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    count_node = members.groupBy("he").agg(F.count(F.lit(1)).alias("c"))
    for step in range(steps):
        node = members.join(edge, "he").groupBy("node", "y").agg(F.sum("p").alias("s")).join(count_he, "node")
        node = written(node.select("node", "y", (F.col("s") / F.col("c")).alias("p")), "node-shares")
        found.append(node.select(F.lit(step).alias("step"), "node", "y", "p"))
        edge = members.join(node, "node").groupBy("he", "y").agg(F.sum("p").alias("s")).join(count_node, "he")
        edge = edge.select("he", "y", (F.col("s") / F.col("c")).alias("p"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def mean_scatter(members: DataFrame, x: DataFrame) -> DataFrame:
    """(node, x): the mean over a node's hyperedges of the mean over their members; x is (node, x)."""
    edge = members.join(x, "node").groupBy("he").agg(F.avg("x").alias("x"))
    return members.join(edge, "he").groupBy("node").agg(F.avg("x").alias("x"))


def containment_rank(members: DataFrame) -> DataFrame:
    """(he, rank) of the distinct hyperedges' member sets: 0 for one node, else one more than the greatest rank of the
    sets properly inside, at least 1. Ranks are raised until none changes, at most as often as the largest set has
    members."""
    sets = members.groupBy("he").agg(F.array_sort(F.collect_set("node")).alias("key")).groupBy("key").agg(F.min("he").alias("he"))
    sets = written(sets.withColumn("size", F.size("key")), "sets")
    rows = sets.select("he", "size", F.explode("key").alias("node"))
    inside = rows.toDF("small", "ss", "node").join(rows.toDF("large", "ls", "node"), "node").where("ss < ls")
    inside = inside.groupBy("small", "large", "ss").agg(F.count(F.lit(1)).alias("common")).where("common = ss").select("small", "large")
    inside = written(inside, "inside")
    ranks = sets.select("he", F.when(F.col("size") == 1, 0).otherwise(1).alias("rank"))
    while True:
        up = inside.join(ranks.toDF("small", "r"), "small").groupBy(F.col("large").alias("he")).agg((F.max("r") + 1).alias("r"))
        new = ranks.join(up, "he", "left").select("he", F.col("rank").alias("old"), F.greatest("rank", F.coalesce("r", "rank")).alias("rank"))
        new = written(new, "ranks")
        ranks = new.select("he", "rank")
        if not new.where("rank > old").limit(1).count():
            return ranks
