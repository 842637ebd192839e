"""Message passing as joins and sums, with weights that are given: features (cell, x array of doubles), operators
(row, col, val), members (he, node). Nothing is trained here."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .complex import neighborhood, route
from .points import pairs_of_blocks

Weights = list[list[float]]


def vector_sum(x: DataFrame, by: str, width: int, weight: str | None = None) -> DataFrame:
    """(by, x): sums of arrays of one width, element by element, times a weight."""
    term = [F.get("x", F.lit(i)) * (F.col(weight) if weight else F.lit(1.0)) for i in range(width)]
    sums = x.groupBy(by).agg(*(F.sum(t).alias(f"s{i}") for i, t in enumerate(term)))
    return sums.select(by, F.array(*(F.col(f"s{i}") for i in range(width))).alias("x"))


def width_of(x: DataFrame) -> int:
    row = x.select(F.size("x").alias("n")).first()
    return row["n"] if row else 0


def spread(m: DataFrame, x: DataFrame) -> DataFrame:
    """(cell, x): m times x, for the rows of m that have an entry; m is (row, col, val), x (cell, x)."""
    joined = m.join(x.toDF("col", "x"), "col")
    return vector_sum(joined, "row", width_of(x), "val").toDF("cell", "x")


def linear(x: str | Column, weights: Weights, bias: list[float] | None = None) -> Column:
    """The array weights x + bias."""
    x = F.col(x) if isinstance(x, str) else x
    rows = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, map(float, w))), lambda a, b: a * b), F.lit(float(bias[i]) if bias else 0.0), lambda s, v: s + v) for i, w in enumerate(weights)]
    return F.array(*rows)


def relu(x: str | Column) -> Column:
    return F.transform(F.col(x) if isinstance(x, str) else x, lambda v: F.greatest(v, F.lit(0.0)))


def added(*parts: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), parts)


def layer_norm(x: str | Column, eps: float = 1e-5) -> Column:
    """Each array less its mean, over its deviation."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    mean = total / n
    square = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / n
    return F.transform(x, lambda v: (v - mean) / F.sqrt(square + eps))


def graph_norm(x: DataFrame, eps: float = 1e-5) -> DataFrame:
    """x (graph_id, cell, x) less the mean, over the deviation, of each coordinate in its graph."""
    width = width_of(x)
    at = [F.get("x", F.lit(i)) for i in range(width)]
    stats = x.groupBy("graph_id").agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(at)), *(F.var_pop(v).alias(f"v{i}") for i, v in enumerate(at)))
    scaled = F.array(*((v - F.col(f"m{i}")) / F.sqrt(F.col(f"v{i}") + eps) for i, v in enumerate(at)))
    return x.join(stats, "graph_id").select("graph_id", "cell", scaled.alias("x"))


def encoded(x: DataFrame, weights: Weights, bias: list[float] | None = None) -> DataFrame:
    """The cell encoder: graph_norm, a linear layer, relu (dropout does nothing when nothing is trained)."""
    return graph_norm(x).select("graph_id", "cell", relu(linear("x", weights, bias)).alias("x"))


def all_cells_encoded(features: dict[int, DataFrame], weights: dict[int, Weights]) -> dict[int, DataFrame]:
    """Each rank's features by its own encoder; ranks without weights stay."""
    return {r: encoded(x, weights[r]) if r in weights else x for r, x in features.items()}


def flattened(x: DataFrame) -> DataFrame:
    """(graph_id, x): a graph's rows in the order of cells, one after another; a graph must fit a row."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("cell", "x"))), lambda s: s["x"])
    return x.groupBy("graph_id").agg(F.flatten(rows).alias("x"))


def gcn_norm(m: DataFrame) -> DataFrame:
    """m (row, col, val) with entries over the roots of the sums of both ends' columns, as GCN weighs them without loops."""
    d = m.groupBy(F.col("row").alias("at")).agg(F.sum("val").alias("d"))
    both = m.join(d.toDF("row", "dr"), "row").join(d.toDF("col", "dc"), "col")
    return both.where("dr > 0 AND dc > 0").select("row", "col", (F.col("val") / F.sqrt(F.col("dr") * F.col("dc"))).alias("val"))


def scn_normalised(m: DataFrame) -> DataFrame:
    """D^-1/2 m D^-1/2 with D the sums of magnitudes of each row; a row without entries stays 0."""
    d = m.groupBy("row").agg(F.sum(F.abs("val")).alias("d")).where("d <> 0")
    both = m.join(d, "row").join(d.toDF("col", "e"), "col")
    return both.select("row", "col", (F.col("val") / F.sqrt(F.col("d") * F.col("e"))).alias("val"))


def powers(m: DataFrame, x: DataFrame, k: int) -> list[DataFrame]:
    """x, m x, .. m^k x; each is written, as the next reads it."""
    out = [x]
    for _ in range(k):
        step = spread(m, out[-1]).toDF("cell", "y")
        zero = F.transform("x", lambda v: v * 0.0)
        out.append(written(x.join(step, "cell", "left").select("cell", F.coalesce("y", zero).alias("x")), "power"))
    return out


def chebyshev_layer(x: DataFrame, operators: list[DataFrame], weights: list[list[Weights]]) -> DataFrame:
    """(cell, x): the sum over operators and powers from 0 on of their weights times m^k x."""
    parts = None
    for m, ws in zip(operators, weights, strict=True):
        for y, w in zip(powers(m, x, len(ws) - 1), ws, strict=True):
            part = y.select("cell", linear("x", w).alias("x"))
            parts = part if parts is None else parts.union(part)
    return vector_sum(parts, "cell", len(weights[0][0]))


def simplicial_layer(x: dict[int, DataFrame], laplacians: dict[str, DataFrame], incidences: dict[int, DataFrame], weights: dict[int, dict[str, list[Weights]]]) -> dict[int, DataFrame]:
    """One layer of simplicial convolutions: each rank gathers itself by powers of its lower and upper Laplacian
    (`down`, `up`), the rank below through the transposed incidence (`low`), and the rank above through it (`high`); an
    operator that a rank lacks is skipped. Weights: by rank and kind, one matrix a power."""
    out = {}
    for r, own in weights.items():
        parts = []
        for kind, ws in own.items():
            if kind in ("down", "up") and f"{kind}_laplacian_{r}" in laplacians:
                parts.append(chebyshev_layer(x[r], [laplacians[f"{kind}_laplacian_{r}"]], [ws]))
            elif kind == "low" and r in incidences:
                b = incidences[r].select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
                parts.append(spread(b, x[r - 1]).select("cell", linear("x", ws[0]).alias("x")))
            elif kind == "high" and r + 1 in incidences:
                parts.append(spread(incidences[r + 1], x[r + 1]).select("cell", linear("x", ws[0]).alias("x")))
        every = reduce(DataFrame.union, parts)
        out[r] = vector_sum(every, "cell", width_of(every)).select("cell", relu("x").alias("x"))
    return out


def cell_layer(x: DataFrame, up: DataFrame, down: DataFrame, own: Weights, upper: Weights, lower: Weights) -> DataFrame:
    """One layer on the cells of a rank: relu of own weights times x, plus GCN over the upper and over the lower operator."""
    parts = [x.select("cell", linear("x", own).alias("x"))]
    parts += [spread(gcn_norm(m), x.select("cell", linear("x", w).alias("x"))) for m, w in ((up, upper), (down, lower))]
    return vector_sum(reduce(DataFrame.union, parts), "cell", len(own)).select("cell", relu("x").alias("x"))


def neighbourhood_layer(x: dict[int, DataFrame], cells: DataFrame, neighborhoods: dict[str, Weights]) -> dict[int, DataFrame]:
    """One layer with a graph convolution for each neighbourhood by name: cells of its source rank send weights times x
    along it; what a rank gets is summed over neighbourhoods, plus relu. Ranks that get nothing keep x."""
    got: dict[int, list[DataFrame]] = {}
    for name, w in neighborhoods.items():
        source, target = route(name) if "incidence" in name else (int(name.rsplit("-", 1)[1]),) * 2
        m = neighborhood(cells, name).withColumn("val", F.abs("val"))
        # Neighbourhood rows are the cells that receive, its columns those that send.
        if "incidence" in name:
            sends_up = target > source
            m = m if sends_up else m.select("row", "col", "val")
        got.setdefault(target, []).append(spread(m, x[source].select("cell", linear("x", w).alias("x"))))
    out = dict(x)
    for r, parts in got.items():
        every = reduce(DataFrame.union, parts)
        summed = vector_sum(every, "cell", width_of(every)).toDF("cell", "y")
        zero = F.array_repeat(F.lit(0.0), width_of(every))
        out[r] = x[r].join(summed, "cell", "left").select("cell", relu(F.coalesce("y", zero)).alias("x"))
    return out


def hasse_graph(cells: DataFrame, neighborhoods: list[str]) -> tuple[DataFrame, DataFrame]:
    """All ranks in one graph: (cell ids (rank, key, id), edges (src, dst, neighborhood)), where an id begins after those of
    the ranks below, in the order of keys' hashes."""
    from .combinatorial import key_ids

    ranks, ids, start = sorted(r["rank"] for r in cells.select("rank").distinct().collect()), [], 0
    for r in ranks:
        own = written(key_ids(cells, r), "ids")
        ids.append(own.select(F.lit(r).alias("rank"), "key", (F.col("id") + start).alias("id")))
        start += own.count()
    every = written(reduce(DataFrame.union, ids), "hasse")
    edges = []
    for name in neighborhoods:
        m = neighborhood(cells, name)
        named = m.join(every.select(F.col("key").alias("row"), F.col("id").alias("dst")), "row").join(every.select(F.col("key").alias("col"), F.col("id").alias("src")), "col")
        edges.append(named.select("src", "dst", F.lit(name).alias("neighborhood")))
    return every, reduce(DataFrame.union, edges)


def hyperedge_layer(members: DataFrame, x: DataFrame, x0: DataFrame, first: Weights, second: Weights, last: Weights, alpha: float = 0.5) -> DataFrame:
    """One equivariant layer: hyperedges take the mean of first x over their members; a node the mean, over its hyperedges,
    of second (x beside theirs); mixed with x0 by alpha, then last. x and x0 are (cell, x)."""
    m = members.select(F.col("node").alias("cell"), "he")
    sent = m.join(x, "cell").select("he", linear("x", first).alias("x"))
    n = m.groupBy("he").agg(F.count(F.lit(1)).alias("n"))
    edge = vector_sum(sent, "he", len(first)).join(n, "he").select("he", F.transform("x", lambda v: v / F.col("n")).alias("e"))
    back = m.join(edge, "he").join(x, "cell").select("cell", linear(F.concat("x", "e"), second).alias("x"))
    k = m.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    node = vector_sum(back, "cell", len(second)).join(k, "cell").select("cell", F.transform("x", lambda v: v / F.col("n")).alias("y"))
    zero = F.array_repeat(F.lit(0.0), len(second))
    mixed = x0.join(node, "cell", "left").select("cell", F.zip_with(F.coalesce("y", zero), "x", lambda a, b: (1 - alpha) * a + alpha * b).alias("x"))
    return mixed.select("cell", linear("x", last).alias("x"))


def mean_degree_scatter(members: DataFrame, x: DataFrame) -> DataFrame:
    """(cell, x): the sum over a node's hyperedges of their members' mean, times the log of one more than its degree."""
    width = width_of(x)
    m = members.select(F.col("node").alias("cell"), "he")
    edge = vector_sum(m.join(x, "cell"), "he", width).join(m.groupBy("he").agg(F.count(F.lit(1)).alias("n")), "he")
    edge = edge.select("he", F.transform("x", lambda v: v / F.col("n")).alias("x"))
    got = vector_sum(m.join(edge, "he"), "cell", width).join(m.groupBy("cell").agg(F.count(F.lit(1)).alias("d")), "cell")
    return got.select("cell", F.transform("x", lambda v: v * F.log1p(F.col("d"))).alias("x"))


def signal_down(x: dict[int, DataFrame], incidences: dict[int, DataFrame], weights: dict[int, Weights], projections: dict[int, Weights]) -> dict[int, DataFrame]:
    """From the greatest rank down to 1: the rank's cells send weights x over the incidence, normalised by layer; beside
    the lower rank's own x, a projection makes its new one. A cell under nothing gets zeros."""
    out = dict(x)
    for r in sorted(incidences, reverse=True):
        sent = spread(incidences[r], out[r].select("cell", linear("x", weights[r]).alias("x"))).toDF("cell", "y")
        zero = F.array_repeat(F.lit(0.0), len(weights[r]))
        both = out[r - 1].join(sent, "cell", "left").select("cell", F.concat(layer_norm(F.coalesce("y", zero)), "x").alias("x"))
        out[r - 1] = both.select("cell", linear("x", projections[r]).alias("x"))
    return out


def residual(out: DataFrame, x: DataFrame) -> DataFrame:
    """layer_norm of out + x, cell by cell."""
    return out.join(x.toDF("cell", "y"), "cell").select("cell", layer_norm(added(F.col("x"), F.col("y"))).alias("x"))


def mlp(x: str | Column, layers: list[tuple[Weights, list[float]]]) -> Column:
    """Linear layers with relu between them."""
    y = F.col(x) if isinstance(x, str) else x
    for i, (w, b) in enumerate(layers):
        y = linear(y, w, b)
        y = relu(y) if i < len(layers) - 1 else y
    return y


def read_out(x: DataFrame, weights: Weights, bias: list[float] | None = None, how: str | None = "sum") -> DataFrame:
    """(graph_id, x) logits of pooled cells (graph_id, cell, x) by sum, mean or max; how None: (cell, x), a row a cell."""
    if how is None:
        return x.select("cell", linear("x", weights, bias).alias("x"))
    width, pool = width_of(x), {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    pooled = x.groupBy("graph_id").agg(*(pool(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)))
    return pooled.select("graph_id", linear(F.array(*(F.col(f"s{i}") for i in range(width))), weights, bias).alias("x"))


def forward(x: DataFrame, encoder: Weights, backbone: Callable[[DataFrame], DataFrame], head: Weights, how: str = "sum") -> DataFrame:
    """Encoder, backbone over (cell, x), and read-out of features (graph_id, cell, x)."""
    seen = encoded(x, encoder)
    out = backbone(seen.select("cell", "x"))
    return read_out(seen.select("graph_id", "cell").join(out, "cell"), head, how=how)


def cosine_similarities(x: DataFrame, above: float | None = None) -> DataFrame:
    """(row, col, similarity) of all pairs of different rows of each group (graph_id, cell, x), or of those whose similarity
    is over `above`."""

    def run(a, b):
        (n, v), (m, w) = a, b
        with np.errstate(invalid="ignore"):
            v, w = (y / np.sqrt(np.square(y).sum(1))[:, None] for y in (v, w))
        keep = n[:, None] != m[None, :]
        if above is not None:
            keep &= v @ w.T > above - 1e-9
        i, j = np.nonzero(keep)
        exact = np.concatenate([(v[i[s : s + 65536]] * w[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        fine = slice(None) if above is None else exact > above
        return n[i[fine]], m[j[fine]], exact[fine]

    return pairs_of_blocks(x, run, "row long, col long, similarity double")


def latent_graph(x: DataFrame, k: int, temperature: float = 1.0, seed: int | None = None) -> DataFrame:
    """(row, col, logp): for each row of a group (graph_id, cell, x) the k rows of greatest -temperature * squared
    distance, with a Gumbel draw by hash where a seed is given; logp is that value without the draw. Without a draw only
    the rows as near as the k nearest of a block leave it."""

    def run(a, b):
        (n, v), (m, w) = a, b
        square = np.square(v).sum(1)[:, None] + np.square(w).sum(1)[None, :] - 2 * v @ w.T
        keep = np.ones(square.shape, bool)
        if seed is None and k < len(m):
            sign = 1 if temperature >= 0 else -1
            slack = 1e-9 * (1 + np.square(v).sum(1) + np.square(w).sum(1).max())
            keep = square * sign <= (np.partition(square * sign, k - 1, axis=1)[:, k - 1] + slack)[:, None]
        i, j = np.nonzero(keep)
        exact = np.concatenate([np.square(v[i[s : s + 65536]] - w[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        return n[i], m[j], -temperature * exact

    pairs = pairs_of_blocks(x, run, "row long, col long, logp double")
    draw = F.lit(0.0)
    if seed is not None:
        u = (F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        draw = -F.log(-F.log(u))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc(F.col("logp") + draw), "col"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def hyperbolic_distances(x: DataFrame) -> DataFrame:
    """(row, col, d) of all pairs of a group in the Poincare ball; points must lie inside it."""
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    own = x.select("graph_id", "cell", "x", square.alias("s"))
    a, b = own.toDF("graph_id", "row", "x", "sr"), own.toDF("graph_id", "col", "y", "sc")
    gap = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, "graph_id").select("row", "col", F.acosh(1 + 2 * gap / ((1 - F.col("sr")) * (1 - F.col("sc")))).alias("d"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, left, right) of directed edges numbered by `id`: each edge with the number of its reverse; an edge
    without one is an error."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("id").alias("right"))
    joined = edges.join(back, ["src", "dst"], "left")
    checked = F.when(F.col("right").isNotNull(), F.col("right")).otherwise(F.raise_error(F.lit("an edge without its reverse")))
    return joined.select("src", "dst", F.col("id").alias("left"), checked.alias("right"))


def orthogonal(parameters: np.ndarray, d: int, how: str = "cayley") -> np.ndarray:
    """A d x d rotation from d (d - 1) / 2 numbers: by Cayley's map, or the exponential, of a skew matrix."""
    a = np.zeros((d, d))
    a[np.tril_indices(d, -1)] = parameters
    a = a - a.T
    if how == "cayley":
        return np.linalg.solve(np.eye(d) + a, np.eye(d) - a)
    values, vectors = np.linalg.eigh(1j * a)
    return np.real((vectors * np.exp(-1j * values)) @ vectors.conj().T)


def sheaf_laplacian(edges: DataFrame, maps: DataFrame, kind: str = "diag", d: int = 2, normalised: bool = True) -> DataFrame:
    """(row, col, block): the blocks, d * d numbers row by row, of the sheaf Laplacian of directed edges (src, dst, in both
    directions) and restriction maps (src, dst, p), p being the numbers of src's map: d for `diag`, d (d - 1) / 2 for
    `bundle`, d * d for `general`. A node's block is the sum over its edges of F'F; between nodes it is -F_u' F_v. With
    normalised, both sides are multiplied by the inverse root of the nodes' own blocks plus 1."""

    def matrix(p: np.ndarray) -> np.ndarray:
        p = np.asarray(p, float)
        return np.diag(p) if kind == "diag" else orthogonal(p, d) if kind == "bundle" else p.reshape(d, d)

    both = edges.join(maps, ["src", "dst"]).join(maps.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("p").alias("q")), ["src", "dst"])

    def blocks(batches):
        for batch in batches:
            rows = []
            for u, v, p, q in zip(batch["src"], batch["dst"], batch["p"], batch["q"], strict=True):
                f, g = matrix(p), matrix(q)
                rows += [(u, u, (f.T @ f).ravel().tolist()), (u, v, (-f.T @ g).ravel().tolist())]
            yield pd.DataFrame(rows, columns=["row", "col", "x"])

    made = both.select("src", "dst", "p", "q").mapInPandas(blocks, "row long, col long, x array<double>").withColumn("at", F.struct("row", "col"))
    summed = vector_sum(made, "at", d * d).select("at.row", "at.col", F.col("x").alias("block"))
    if not normalised:
        return summed
    summed = written(summed, "sheaf")
    own = summed.where("row = col").select(F.col("row").alias("node"), F.col("block").alias("own"))
    joined = summed.join(own.toDF("row", "left"), "row").join(own.toDF("col", "right"), "col")

    def root(block: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(np.asarray(block, float).reshape(d, d) + np.eye(d))
        return (vectors / np.sqrt(values)) @ vectors.T

    def scale(batches):
        for batch in batches:
            out = [(root(left) @ np.asarray(b, float).reshape(d, d) @ root(right)).ravel().tolist() for b, left, right in zip(batch["block"], batch["left"], batch["right"], strict=True)]
            yield pd.DataFrame({"row": batch["row"], "col": batch["col"], "block": out})

    return joined.select("row", "col", "block", "left", "right").mapInPandas(scale, "row long, col long, block array<double>")


def sheaf_step(laplacian: DataFrame, x: DataFrame, d: int) -> DataFrame:
    """(cell, x): x less the sheaf Laplacian's product with it; x has d numbers a node."""
    joined = laplacian.join(x.toDF("col", "x"), "col")
    rows = [F.aggregate(F.zip_with(F.slice("block", i * d + 1, d), "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for i in range(d)]
    moved = vector_sum(joined.select("row", F.array(*rows).alias("x")), "row", d).toDF("cell", "y")
    return x.join(moved, "cell", "left").select("cell", F.zip_with("x", F.coalesce("y", F.array_repeat(F.lit(0.0), d)), lambda a, b: a - b).alias("x"))
