"""Liftings of graphs and point clouds to hypergraphs and flag complexes, as member tables (he, node) or cells (rank, key)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .complex import clique_lifting
from .graph import components, dense_ids, forman_curvature, hashed, symmetric
from .points import balls, farthest_points, knn, radius
from .spectral import laplacian, per_graph


def knn_hyperedges(points: DataFrame, k: int) -> DataFrame:
    """(he, node): hyperedge j holds the points that have j among their k nearest, each point being its own first."""
    near = knn(points, k - 1).select(F.col("node").alias("he"), F.col("center").alias("node")) if k > 1 else points.select(F.col("node").alias("he"), "node").where("false")
    return near.union(points.select(F.col("node").alias("he"), "node"))


def modularity_matrix(edges: DataFrame) -> DataFrame:
    """(src, dst, b) for all pairs of nodes that have an edge out: the edge's count less k(src) k(dst) / 2m, where k counts
    edges out as they are given and m is half their number."""
    k = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    m = edges.agg((F.count(F.lit(1)) / 2).alias("m"))
    a = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("a"))
    pairs = k.toDF("src", "ks").crossJoin(k.toDF("dst", "kd")).crossJoin(F.broadcast(m)).join(a, ["src", "dst"], "left")
    return pairs.select("src", "dst", (F.coalesce("a", F.lit(0)) - F.col("ks") * F.col("kd") / (2 * F.col("m"))).alias("b"))


def k_means(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """The cluster of each row, from the farthest-first rows as centres."""
    picked = [0]
    while len(picked) < min(k, len(x)):
        gap = np.min([np.square(x - x[p]).sum(1) for p in picked], axis=0)
        if gap.max() <= 1e-18:
            break
        picked.append(int(gap.argmax()))
    centres = x[picked]
    for _ in range(rounds):
        own = np.square(x[:, None] - centres[None]).sum(2).argmin(1)
        new = np.stack([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(new, centres):
            break
        centres = new
    return own


def communities(nodes: DataFrame, edges: DataFrame, n: int = 2) -> DataFrame:
    """(graph_id, node, community): k-means of the leading n eigenvectors of each graph's modularity matrix."""

    def make(own: pd.DataFrame, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
        if own.empty:
            return own.assign(community=pd.Series(dtype="int64"))
        a = np.zeros((len(own), len(own)))
        np.add.at(a, (src, dst), 1)
        k = a.sum(1)
        b = a - np.outer(k, k) / max(len(src), 1)
        values, vectors = np.linalg.eigh((b + b.T) / 2)
        return own.assign(community=k_means(vectors[:, np.argsort(-values)[:n]], n))

    return per_graph(nodes, edges, "graph_id long, node long, community long", make)


def modularity_hyperedges(nodes: DataFrame, edges: DataFrame, n: int = 2, k: int = 3) -> DataFrame:
    """(graph_id, he, node): hyperedge j holds j and the nodes that have j among the k nearest, by x, of their community;
    nodes is (graph_id, node, x array). Nearest counts the node itself, ties go to the lesser id."""
    own = written(communities(nodes, edges, n).join(nodes.select("graph_id", "node", "x"), ["graph_id", "node"]), "communities")
    other = own.toDF("graph_id", "other", "community", "y")
    gap = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    place = F.row_number().over(Window.partitionBy("graph_id", "node").orderBy("gap", "other"))
    near = own.join(other, ["graph_id", "community"]).withColumn("gap", gap).withColumn("place", place).where(F.col("place") <= k)
    near = near.select("graph_id", F.col("other").alias("he"), "node")
    return near.union(own.select("graph_id", F.col("node").alias("he"), "node")).distinct()


#: Kernels of a graph's normalised Laplacian, by name.
KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "heat": lambda values, t=1.0: np.exp(-t * values),
    "matern": lambda values, nu=1, kappa=1: (2 * nu / kappa**2 + np.maximum(values, 0)) ** -nu,
    "identity": lambda values: np.ones_like(values),
}


def graph_kernel(name: str, n: int, src: np.ndarray, dst: np.ndarray, **parameters: float) -> np.ndarray:
    """The kernel matrix; `identity` stands for one of all ones, which changes nothing in a product."""
    if name == "identity":
        return np.ones((n, n))
    values, vectors = np.linalg.eigh(laplacian(n, src, dst))
    return (vectors * KERNELS[name](values, **parameters)) @ vectors.T


def feature_kernel(name: str, x: np.ndarray, **parameters: float) -> np.ndarray:
    """Of the rows of x: `identity` (all ones), `linear`, or `rbf` with gamma."""
    if name == "identity":
        return np.ones((len(x), len(x)))
    if name == "linear":
        return x @ x.T
    if name == "rbf":
        square = np.maximum(np.square(x).sum(1)[:, None] + np.square(x).sum(1)[None] - 2 * x @ x.T, 0)
        return np.exp(-parameters.get("gamma", 1.0) * square)
    raise ValueError(f"no such feature kernel: {name}")


def kernel_members(nodes: DataFrame, edges: DataFrame, graph: str = "heat", feature: str = "identity", combine: str = "prod", fraction: float = 0.5) -> DataFrame:
    """(graph_id, key): for each node those whose combined kernel with it reaches the (1 - fraction) quantile of the whole
    matrix; hyperedges of one node go, equal ones stay once. nodes has x (array) where a feature kernel reads it."""
    if combine not in ("prod", "sum"):
        raise ValueError(f"no such combination: {combine}")
    if graph not in KERNELS:
        raise ValueError(f"no such graph kernel: {graph}")
    x = nodes if "x" in nodes.columns else nodes.withColumn("x", F.array().cast("array<double>"))

    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node").reset_index(drop=True)
        if own.empty:
            return pd.DataFrame({"graph_id": pd.Series(dtype="int64"), "key": pd.Series(dtype=object)})
        at = pd.Series(own.index, index=own["node"])
        links = links[links["src"].isin(at.index) & links["dst"].isin(at.index)]
        k = graph_kernel(graph, len(own), at[links["src"]].to_numpy(dtype=int), at[links["dst"]].to_numpy(dtype=int))
        f = feature_kernel(feature, np.stack([np.asarray(v, float) for v in own["x"]]))
        k = k * f if combine == "prod" else k + f
        bar, ids = np.quantile(k, 1 - fraction), own["node"].to_numpy()
        keys = sorted({tuple(int(v) for v in ids[column >= bar - 1e-12]) for column in k.T})
        keys = [key for key in keys if len(key) > 1]
        return pd.DataFrame({"graph_id": np.full(len(keys), own["graph_id"].iloc[0], np.int64), "key": pd.Series(keys, dtype=object)})

    return x.select("graph_id", "node", "x").groupBy("graph_id").cogroup(edges.select("graph_id", "src", "dst").groupBy("graph_id")).applyInPandas(run, "graph_id long, key array<long>")


def forman_hyperedges(nodes: DataFrame, edges: DataFrame, threshold: float = 0.1, kind: str = "quantile", direction: str = "below", weighted: bool = False) -> DataFrame:
    """(he, node): the components that are left when edges whose curvature is above, or below, the threshold go; numbered
    from the largest on, of equals by the least node. A quantile threshold is taken over all edges, exactly, by counting
    the distinct curvatures in order."""
    if kind not in ("quantile", "absolute") or direction not in ("above", "below"):
        raise ValueError(f"no such threshold: {kind}, {direction}")
    w = edges if weighted else edges.withColumn("w", F.lit(1.0))
    bent = written(forman_curvature(w.select("src", "dst", "w")), "curvature")
    bar = quantile(bent, "curvature", threshold) if kind == "quantile" else threshold
    gone = F.col("curvature") > bar if direction == "above" else F.col("curvature") < bar
    labels = components(nodes, bent.where(~gone).select("src", "dst"))
    size = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).withColumn("order", F.col("n") * -1)
    ids = ranked(size, "order", "comp")
    return labels.join(ids, "comp").select(F.col("id").alias("he"), "node")


def ranked(rows: DataFrame, first: str, then: str) -> DataFrame:
    """rows with id, 0, 1, .. in the order of two columns of longs: ranks within each first value after the sums before."""
    counts = rows.groupBy(first).agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(first, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))  # a row for each distinct value
    inside = rows.withColumn("in", F.row_number().over(Window.partitionBy(first).orderBy(then)) - 1)
    return inside.join(starts, first).select(then, (F.col("start") + F.col("in")).cast("long").alias("id"))


def quantile(rows: DataFrame, value: str, q: float) -> float:
    """The quantile with linear interpolation, by counts of distinct values; a few values go to the driver. Values are
    dealt into 4,096 ranges, so only the ranges that hold the wanted places are ordered."""
    at = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if not at["n"]:
        return 0.0
    lo, hi, n = at["lo"], at["hi"], at["n"]
    if lo == hi:
        return float(lo)
    place = (n - 1) * q
    wanted = [int(place), min(int(place) + 1, n - 1)]
    ranged = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.least(F.lit(4095), F.floor((F.col(value) - lo) / (hi - lo) * 4096)).alias("range"))
    sizes = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())
    found, start = {}, 0
    for key, size in sizes:
        inside = [w for w in wanted if start <= w < start + size]
        if inside:
            values = ranged.where(F.col("range") == key).groupBy("v").count().orderBy("v")
            total = start
            for r in values.toLocalIterator():
                for w in inside:
                    if total <= w < total + r["count"]:
                        found[w] = r["v"]
                total += r["count"]
        start += size
    low, high = found[wanted[0]], found[wanted[1]]
    return float(low + (high - low) * (place - wanted[0]))


def mapper_cover(values: DataFrame, resolution: int = 10, gain: float = 0.3) -> DataFrame:
    """(node, i): the intervals, 0 .. resolution - 1, that hold each node's value; they overlap by the share `gain` and
    reach 0.001 beyond the least and the greatest value; ends count. An interval without nodes has no row."""
    if not 0 < gain <= 0.5 or resolution <= 0 or int(resolution) != resolution:
        raise ValueError("gain must be over 0 and at most 0.5, resolution a positive whole number")
    ends = values.agg((F.min("value") - 1e-3).alias("lo"), (F.max("value") + 1e-3).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / (resolution - (resolution - 1) * gain)
    step = width * (1 - gain)
    # Only the intervals near the value: its own place, and the one before, may hold it.
    near = values.crossJoin(F.broadcast(ends)).withColumn("w", width).withColumn("step", step).withColumn("top", F.floor((F.col("value") - F.col("lo")) / F.col("step")))  # one row
    near = near.withColumn("i", F.explode(F.sequence(F.col("top") - 2, F.col("top") + 1))).where((F.col("i") >= 0) & (F.col("i") < resolution))
    low = F.col("lo") + F.col("i") * F.col("step")
    slack = 1e-8 + 1e-5 * F.abs(low)
    high_slack = 1e-8 + 1e-5 * F.abs(low + F.col("w"))
    return near.where((F.col("value") > low - slack) & (F.col("value") < low + F.col("w") + high_slack)).select("node", F.col("i").cast("int").alias("i"))


def mapper_hyperedges(edges: DataFrame, values: DataFrame, resolution: int = 10, gain: float = 0.3) -> DataFrame:
    """(kind, a, b, node): a hyperedge `edge` for each row of edges as given, in both directions if so, and a hyperedge
    `cluster` (interval, least node) for each connected part of what an interval holds; values is (node, value)."""
    cover = written(mapper_cover(values, resolution, gain), "cover")
    spots = cover.select((F.col("node") * resolution + F.col("i")).alias("spot"), "node", "i")
    links = symmetric(edges).join(spots.select(F.col("spot").alias("s"), F.col("node").alias("src"), "i"), "src")
    links = links.join(spots.select(F.col("spot").alias("d"), F.col("node").alias("dst"), "i"), ["dst", "i"]).select(F.col("s").alias("src"), F.col("d").alias("dst"))
    comps = components(spots.select(F.col("spot").alias("node")), links)
    clusters = comps.select(F.lit("cluster").alias("kind"), (F.col("comp") % resolution).alias("a"), F.floor(F.col("comp") / resolution).alias("b"), F.floor(F.col("node") / resolution).alias("node"))
    return edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.explode(F.array("src", "dst")).alias("node")).union(clusters)


def feature_sum(points: DataFrame) -> DataFrame:
    """(node, value): the sum of x; the filter of mapper that all engines give alike."""
    return points.select("node", F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda s, v: s + v).alias("value"))


def moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of points, their mean, and the sums of products of their coordinates, from d x d aggregates."""
    pairs = points.select(F.posexplode("x").alias("i", "a"), "x").select("i", "a", F.posexplode("x").alias("j", "b"))
    sums = pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.sum("a").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    d = max((r["i"] for r in sums), default=-1) + 1
    gram, mean, n = np.zeros((d, d)), np.zeros(d), sums[0]["n"] if sums else 0
    for r in sums:
        gram[r["i"], r["j"]] = r["s"]
        mean[r["i"]] = r["m"] / n
    return n, mean, gram


def principal_values(points: DataFrame, centred: bool = False) -> DataFrame:
    """(node, value): x projected on its first right singular vector (of x less its mean if centred), from the d x d sums
    of products, which are all that goes to the driver. The entry of greatest magnitude of the vector is positive."""
    n, mean, gram = moments(points)
    if not n:
        return points.select("node", F.lit(0.0).alias("value"))
    if centred:
        gram = gram - n * np.outer(mean, mean)
    vector = np.linalg.eigh(gram)[1][:, -1]
    vector = vector * (1 if vector[np.abs(vector).argmax()] > 0 else -1)
    return points.select("node", F.aggregate(F.zip_with("x", F.array(*map(F.lit, vector.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("value"))


def expander_hyperedges(nodes: DataFrame, degree: int, seed: int = 0, tries: int = 50) -> DataFrame:
    """(he, node): a random graph in which each node has `degree` neighbours, an even number, as hyperedges of two nodes:
    degree / 2 cycles through all nodes in hashed orders, each drawn anew while it repeats an edge."""
    if degree <= 0 or degree % 2:
        raise ValueError("the degree must be even and positive")
    n = nodes.count()
    if n <= degree:
        raise ValueError("more nodes than the degree are needed")
    found = None
    for cycle in range(degree // 2):
        for attempt in range(tries):
            drawn = nodes.select("node", hashed("node", F.lit(seed), F.lit(cycle), F.lit(attempt)).alias("h"))
            order = written(drawn.join(dense_ids(drawn, "h", "at"), "h").select("node", "at"), "order")
            after = order.select(F.col("node").alias("next"), F.pmod(F.col("at") - 1, F.lit(n)).alias("at"))
            step = order.join(after, "at").select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b"))
            both = step if found is None else found.union(step)
            both = written(both, "expander")
            if both.distinct().count() == (cycle + 1) * n:
                found = both
                break
        else:
            raise ValueError("no cycle without a repeated edge was found")
    keyed = found.select(hashed("a", "b").alias("h"), "a", "b")
    ids = keyed.join(dense_ids(keyed, "h", "he"), "h")
    return ids.select("he", F.explode(F.array("a", "b")).alias("node"))


def pointnet_hyperedges(points: DataFrame, ratio: float, r: float) -> DataFrame:
    """(he, node): the points within r of each support, which are farthest-point samples, ratio of the points; a point
    in no ball has a hyperedge of its own, numbered after the others in the order of ids."""
    supports = farthest_points(points, max(1, -(-int(points.count() * ratio * 1_000_000) // 1_000_000)))
    met = balls(points, np.array([x for _, x in supports]), r)
    lone = written(met.where("he < 0").select("node"), "lone")
    return met.where("he >= 0").union(lone.join(dense_ids(lone, "node", "id"), "node").select((F.col("id") + len(supports)).alias("he"), "node"))


def spanning_tree(gaps: np.ndarray) -> list[tuple[int, int]]:
    """A minimum spanning tree of a full distance matrix, by Prim."""
    n = len(gaps)
    inside, best, parent, out = [0], gaps[0].copy(), np.zeros(n, int), []
    while len(inside) < n:
        best[inside] = np.inf
        k = int(best.argmin())
        out.append((int(parent[k]), k))
        inside.append(k)
        nearer = gaps[k] < best
        parent[nearer], best[nearer] = k, gaps[k][nearer]
    return out


def mixture_hyperedges(points: DataFrame, least: int | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """(he, node): the Gaussian mixture of least AIC over least .. most components, over powers of two up to n / 2 where
    neither is given, or of `least` alone; hyperedge c holds the members of c, hyperedge K + c those of its neighbours in
    the minimum spanning tree of the means. Without a model all points are one hyperedge."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    sizes = [least or 1]
    if least is not None and most is not None:
        sizes = list(range(least, most + 1))
    elif least is None and most is None:
        sizes = [2**i for i in range(1, int(np.log2(max(n, 2) / 2)) + 1)]
    rows = written(points.select("node", "x"), "points").withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
    best = None
    for k in sizes:
        if k == 1:
            _, mean, gram = moments(points)
            d, model = len(mean), None
            spread = np.linalg.slogdet(gram / max(n, 1) - np.outer(mean, mean) + 1e-6 * np.eye(d))[1]
            likelihood = -n / 2 * (d * np.log(2 * np.pi) + spread + d)
        else:
            model = GaussianMixture(k=k, seed=seed).fit(rows)
            d, likelihood = len(model.gaussians[0].mean), model.summary.logLikelihood
        aic = 2 * (k * (d + d * (d + 1) // 2) + k - 1) - 2 * likelihood
        if best is None or aic < best[0]:
            best = (aic, k, model)
    if best is None or best[2] is None:
        return points.select(F.lit(0).cast("long").alias("he"), "node")
    _, k, model = best
    own = model.transform(rows).select("node", F.col("prediction").cast("long").alias("c"))
    means = np.array([g.mean.toArray() for g in model.gaussians])
    tree = spanning_tree(np.sqrt(np.square(means[:, None] - means[None]).sum(2)))
    near = points.sparkSession.createDataFrame([p for a, b in tree for p in ((a, b + k), (b, a + k))], "c long, he long")
    return own.select(F.col("c").alias("he"), "node").union(own.join(F.broadcast(near), "c").select("he", "node"))  # 2 (k - 1) rows


def circumsphere(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and squared radius of the least sphere through all points, within their affine hull."""
    d = p[1:] - p[0]
    t = np.linalg.lstsq(2 * d @ d.T, np.square(d).sum(1), rcond=None)[0] if len(d) else np.zeros(0)
    centre = p[0] + t @ d if len(d) else p[0]
    return centre, float(np.square(p[0] - centre).sum())


def alpha_complex(clouds: DataFrame, alpha: float, dim: int = 2, most: int = 80) -> DataFrame:
    """(graph_id, rank, key): of each cloud (graph_id, node, x), the Delaunay simplices whose value is at most alpha, up to
    rank dim, and all points. A simplex's value is its squared circumradius if no other point is inside that sphere, else
    the least value of the simplices over it. Cells are found by trying all sets of points, so clouds of more than `most`
    points are an error."""

    def run(cloud: pd.DataFrame) -> pd.DataFrame:
        cloud = cloud.sort_values("node")
        ids, x = cloud["node"].to_numpy(), np.stack([np.asarray(v, float) for v in cloud["x"]])
        if len(ids) > most:
            raise ValueError(f"more than {most} points in a cloud")
        top = min(x.shape[1], len(ids) - 1)
        values: dict[tuple[int, ...], float] = {}
        for pick in combinations(range(len(ids)), top + 1):
            p = x[list(pick)]
            if top and np.linalg.matrix_rank(p[1:] - p[0]) < top:
                continue
            centre, square = circumsphere(p)
            others = np.delete(np.arange(len(ids)), pick)
            if not len(others) or (np.square(x[others] - centre).sum(1) >= square - 1e-12).all():
                values[pick] = square
        for size in range(top, 0, -1):
            over: dict[tuple[int, ...], list[float]] = {}
            for key, value in list(values.items()):
                if len(key) == size + 1:
                    for face in combinations(key, size):
                        over.setdefault(face, []).append(value)
            for face, least in over.items():
                centre, square = circumsphere(x[list(face)])
                others = np.delete(np.arange(len(ids)), face)
                empty = (np.square(x[others] - centre).sum(1) >= square - 1e-12).all()
                values[face] = square if empty else min(least)
        keys = {k for k, v in values.items() if v <= alpha and len(k) <= dim + 1} | {(i,) for i in range(len(ids))}
        return pd.DataFrame([(int(cloud["graph_id"].iloc[0]), len(k) - 1, [int(ids[i]) for i in k]) for k in sorted(keys)], columns=["graph_id", "rank", "key"])

    if alpha <= 0:
        raise ValueError("alpha must be positive")
    return clouds.select("graph_id", "node", "x").groupBy("graph_id").applyInPandas(run, "graph_id long, rank int, key array<long>")


#: Pairs that a task of random_flag holds at once.
PAIRS = 100_000


def pair_batch(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[k] for h in held]).astype(np.int64)) for k in (0, 1)], ["id", "other"])


def random_flag(nodes: DataFrame, steps: int = 1, p: float | None = None, alpha: float | None = None, dim: int = 2, seed: int = 0, only: int | None = None) -> DataFrame:
    """(rank, key): the cliques, or those of rank `only`, of a random graph that has each pair with probability 1 - (1 - p)^steps, by a hash of the
    pair; p is n^-alpha where it isn't given. Each node draws how many of its greater nodes it joins, and which, so only
    pairs that are kept are made."""
    n = nodes.count()
    if (p is None) == (alpha is None):
        raise ValueError("either p or alpha is needed")
    chance = 1 - (1 - (p if p is not None else float(n) ** -alpha)) ** steps
    ids = written(nodes.select("node").join(dense_ids(nodes, "node", "id"), "node"), "ids")

    def others(i: int) -> np.ndarray:
        """The ids over i that node i joins: gaps between them are geometric, so only pairs that are kept are drawn."""
        if not 0 < chance < 1:
            return np.arange(i + 1, n if chance >= 1 else i + 1)
        rng, last, found = np.random.default_rng([seed, i]), i, []
        while last < n:
            mean = (n - last) * chance
            found.append(last + np.cumsum(rng.geometric(chance, int(mean + 4 * mean**0.5) + 4)))
            last = int(found[-1][-1])
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        return found[found < n]

    def draw(batches):
        for batch in batches:
            held, size = [], 0
            for i in batch.column("id").to_pylist():
                more = others(i)
                held.append((np.full(len(more), i, np.int64), more))
                size += len(more)
                if size >= PAIRS:
                    yield pair_batch(held)
                    held, size = [], 0
            if held:
                yield pair_batch(held)

    pairs = ids.select("id").mapInArrow(draw, "id long, other long")
    named = pairs.join(ids.toDF("src", "id"), "id").join(ids.toDF("dst", "other"), "other")
    return clique_lifting(nodes, named.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), dim, only)


def betti_numbers(cells: DataFrame, max_rank: int, most: int = 20_000) -> DataFrame:
    """(graph_id, rank, betti) of complexes (graph_id, rank, key) from ranks of boundary matrices over two elements, by
    elimination of sparse columns; one complex is one task, so more than `most` cells are an error."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        if len(cells) > most:
            raise ValueError(f"more than {most} cells in a complex")
        by = {r: sorted(tuple(int(v) for v in k) for k in g["key"]) for r, g in cells.groupby("rank")}
        number = {k: i for ks in by.values() for i, k in enumerate(ks)}
        ranks = {}
        for r in range(1, max_rank + 2):
            pivots: dict[int, set[int]] = {}
            for key in by.get(r, []):
                column = {number[key[:i] + key[i + 1 :]] for i in range(len(key))}
                while column and max(column) in pivots:
                    column ^= pivots[max(column)]
                if column:
                    pivots[max(column)] = column
            ranks[r] = len(pivots)
        graph = int(cells["graph_id"].iloc[0])
        return pd.DataFrame([(graph, r, len(by.get(r, [])) - ranks.get(r, 0) - ranks[r + 1]) for r in range(max_rank + 1)], columns=["graph_id", "rank", "betti"])

    return cells.select("graph_id", "rank", "key").groupBy("graph_id").applyInPandas(run, "graph_id long, rank int, betti long")


def radius_balls(points: DataFrame, r: float) -> DataFrame:
    """(he, node): the points within r of each point, itself included."""
    near = radius(points, r).select(F.col("center").alias("he"), "node")
    return near.union(points.select(F.col("node").alias("he"), "node"))


def latent_cliques(nodes: DataFrame, edges: DataFrame, rounds: int = 20, p: float = 0.9, seed: int = 0, dim: int = 2) -> DataFrame:
    """(graph_id, rank, key): cells of the cliques of a latent graph under which the observed one is likely.

    Each graph starts from a cover of its edges by pairs. A sampler then proposes, `rounds` times the number of cliques, to
    merge two that share a node or to split one, and accepts by the ratio of likelihoods: an edge that is covered is
    observed with probability p, a pair that isn't covered never, and each clique costs one unit. All observed edges stay
    covered; covered pairs are the edges of the latent graph, whose cliques are the result.
    """

    def make(own: pd.DataFrame, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        seen = {(min(a, b), max(a, b)) for a, b in zip(src.tolist(), dst.tolist(), strict=True) if a != b}
        cover = [frozenset(e) for e in sorted(seen)]

        def pairs(cliques: list[frozenset[int]]) -> set[tuple[int, int]]:
            return {q for c in cliques for q in combinations(sorted(c), 2)}

        def likelihood(cliques: list[frozenset[int]]) -> float:
            covered = pairs(cliques)
            if not seen <= covered:
                return -np.inf
            return len(seen) * np.log(p) + (len(covered) - len(seen)) * np.log(1 - p) - len(cliques)

        now = likelihood(cover) if cover else 0.0
        for _ in range(rounds * len(cover)):
            i = int(rng.integers(len(cover)))
            if rng.random() < 0.5:
                near = [j for j, c in enumerate(cover) if j != i and c & cover[i]]
                if not near:
                    continue
                j = near[int(rng.integers(len(near)))]
                new = [c for k, c in enumerate(cover) if k not in (i, j)] + [cover[i] | cover[j]]
            elif len(cover[i]) > 2:
                drop = sorted(cover[i])[int(rng.integers(len(cover[i])))]
                rest = cover[i] - {drop}
                new = [c for k, c in enumerate(cover) if k != i] + [rest, *(frozenset({drop, v}) for v in rest if (min(drop, v), max(drop, v)) in seen)]
            else:
                continue
            new = [c for c in dict.fromkeys(new) if not any(c < other for other in new)]
            then = likelihood(new)
            if np.log(max(rng.random(), 1e-300)) < then - now:
                cover, now = new, then
        ids = own["node"].to_numpy()
        latent = pairs(cover)
        keys = {(i,) for i in range(len(ids))} | latent
        near = {i: {b for a, b in latent if a == i} | {a for a, b in latent if b == i} for i in range(len(ids))}
        grown = sorted(latent)
        for _ in range(2, dim + 1):
            grown = [(*k, v) for k in grown for v in sorted(set.intersection(*(near[u] for u in k))) if v > k[-1]]
            keys |= set(grown)
        graph = int(own["graph_id"].iloc[0]) if len(own) else 0
        return pd.DataFrame([(graph, len(k) - 1, [int(ids[i]) for i in k]) for k in sorted(keys)], columns=["graph_id", "rank", "key"])

    return per_graph(nodes, edges, "graph_id long, rank int, key array<long>", make)

