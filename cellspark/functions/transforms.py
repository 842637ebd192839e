"""The operators as named transforms of relations.

Relations: nodes (node, x, y), edges (src, dst), cells (rank, key), members (he, node), points (node, x), each where the
data has it, and under other names what transforms add. x is an array of numbers, where an operator takes a number its
first. A lifting adds cells or members, then features x_0, x_1, .. (cell, x) by its feature lifting.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import combinatorial as co
from ..operators import complex as cx
from ..operators import evaluation as ev
from ..operators import graph as gr
from ..operators import hypergraph as hy
from ..operators import lifting as li
from ..operators import messages as ms
from ..operators import points as pt
from ..operators import simplicial as si
from ..operators import spectral as sp
from ..plans.storage import written
from .registry import Relations, register


def arrays(nodes: DataFrame) -> DataFrame:
    """nodes with x as an array of doubles."""
    kind = dict(nodes.dtypes).get("x", "")
    return nodes if kind.startswith("array") or not kind else nodes.withColumn("x", F.array(F.col("x").cast("double")))


def undirected_edges(r: Relations) -> DataFrame:
    return gr.undirected(r["edges"])


# ---- features of cells


def projected(r: Relations, dim: int) -> dict[str, DataFrame]:
    """x_1 .. x_dim as sums of the features of each cell's boundary, where they are not there yet."""
    x = r["x_0"]
    out: dict[str, DataFrame] = {}
    for rank in range(1, dim + 1):
        b = cx.incidence(r["cells"], rank)
        made = ms.spread(cx.transposed(b).withColumn("val", F.abs("val")), x)
        out[f"x_{rank}"] = x = r.get(f"x_{rank}", made)
    return out


def concatenated(r: Relations, dim: int) -> dict[str, DataFrame]:
    x, out = r["x_0"], {}
    for rank in range(1, dim + 1):
        out[f"x_{rank}"] = x = r.get(f"x_{rank}", cx.concatenation(x, cx.incidence(r["cells"], rank)))
    return out


def vertex_sets(r: Relations, dim: int) -> dict[str, DataFrame]:
    return {f"x_{rank}": cx.set_lifting(r["cells"], rank) for rank in range(1, dim + 1)}


FEATURES: dict[str | None, Callable[[Relations, int], dict[str, DataFrame]]] = {
    "ProjectionSum": projected,
    "Concatenation": concatenated,
    "Set": vertex_sets,
    "Identity": lambda r, dim: {},
    None: lambda r, dim: {},
}


def finished(r: Relations, cells: DataFrame, dim: int, feature_lifting: str | None = "ProjectionSum", preserve_edge_attr: bool = False, strict: bool = True, neighborhoods: list[str] | None = None, signed: bool = False) -> Relations:
    """The relations with a lifted complex: its cells, written once as much reads them, x_0 from the nodes, x_1 from edge
    features if asked (see edge_features), further features by the feature lifting, and the operators of every rank."""
    if feature_lifting not in FEATURES:
        raise ValueError(f"no such feature lifting: {feature_lifting}")
    cells = written(cells, "cells")
    out = {**r, "cells": cells}
    if "nodes" in r and "x" in r["nodes"].columns:
        out["x_0"] = arrays(r["nodes"]).select(F.array("node").alias("cell"), "x")
    if preserve_edge_attr and "edges" in r and "x" in r["edges"].columns:
        own = si.edge_features(cells, r["edges"], r["edges"], strict)
        if own is not None:
            out["x_1"] = own.toDF("cell", "x")
    if "x_0" in out:
        out |= FEATURES[feature_lifting](out, dim)
    return out | si.connectivity(cells, dim, signed, neighborhoods)


def lifted_members(r: Relations, members: DataFrame, feature_lifting: str | None = "ProjectionSum") -> Relations:
    """The relations with hyperedges (he, node), and x_hyperedges, sums of their nodes' features."""
    members = written(members.select("he", "node"), "members")
    out = {**r, "members": members}
    if feature_lifting == "ProjectionSum" and "nodes" in r and "x" in r["nodes"].columns:
        x = arrays(r["nodes"]).select("node", "x")
        out["x_hyperedges"] = ms.vector_sum(members.join(x, "node"), "he", ms.width_of(x)).toDF("cell", "x")
    return out


def simplicial(make: Callable[..., DataFrame]) -> Callable[..., Relations]:
    def run(r: Relations, complex_dim: int = 2, feature_lifting: str | None = "ProjectionSum", preserve_edge_attr: bool = False, neighborhoods: list[str] | None = None, signed: bool = False, **parameters: Any) -> Relations:
        cells = make(r["nodes"], undirected_edges(r), complex_dim, **parameters)
        return finished(r, cells, complex_dim, feature_lifting, preserve_edge_attr, True, neighborhoods, signed)

    return run


for _name, _make in {
    "SimplicialCliqueLifting": cx.clique_lifting,
    "SimplicialKHopLifting": lambda n, e, dim, max_k_simplices=25: si.khop_complex(n, e, dim, max_k_simplices),
    "SimplicialGraphInducedLifting": si.induced_complex,
    "SimplicialEccentricityLifting": si.eccentricity_complex,
    "SimplicialVietorisRipsLifting": lambda n, e, dim, distance_threshold=1, max_simplices=5: si.vietoris_rips(n, e, dim, int(distance_threshold), max_simplices),
    "NeighborhoodComplexLifting": lambda n, e, dim, max_simplices=10: si.neighborhood_cells(n, e, dim, max_simplices),
    "SimplicialDnDLifting": lambda n, e, dim, max_simplices=10, seed=0: si.dice_complex(n, e, dim, max_simplices, seed),
    "LatentCliqueLifting": lambda n, e, dim, it=20, edge_prob_mean=0.9, seed=0: li.latent_cliques(sp.one_graph(n), sp.one_graph(e), it, edge_prob_mean, seed, dim).select("rank", "key"),
}.items():
    register(_name)(simplicial(_make))


@register("SimplicialCliquesLEQLifting")
def maximal_cliques(r: Relations, complex_dim: int = 2, **parameters: Any) -> Relations:
    """Triangles in no tetrahedron, with the graph."""
    cells = cx.clique_lifting(r["nodes"], undirected_edges(r), 3)
    tops = cx.maximal_triangles(cells)
    return finished(r, si.complex_of(r["nodes"], undirected_edges(r), [tops], complex_dim), complex_dim, **parameters)


@register("SimplicialLineLifting")
def line(r: Relations, complex_dim: int = 2, max_simplices: int = 25, feature_lifting: str | None = "ProjectionSum") -> Relations:
    nodes = r["nodes"] if not dict(r["nodes"].dtypes).get("x", "").startswith("array") else r["nodes"].withColumn("x", F.get("x", F.lit(0)))
    ids, cells = si.line_complex(nodes, undirected_edges(r), complex_dim, max_simplices)
    return finished({**r, "nodes": ids.withColumnRenamed("id", "node"), "line_edges": ids}, cells, complex_dim, feature_lifting)


@register("CellCycleLifting")
def cycles(r: Relations, max_cell_length: int | None = None, feature_lifting: str | None = "ProjectionSum") -> Relations:
    """Nodes, edges and fundamental cycles as 2-cells (rank, key); a cycle's boundary are the edges along it."""
    edges = undirected_edges(r)
    found = sp.cycle_basis(sp.one_graph(r["nodes"]), sp.one_graph(edges), max_cell_length).select("key")
    cells = r["nodes"].select(F.lit(0).alias("rank"), F.array("node").alias("key")).union(edges.select(F.lit(1), F.array("src", "dst"))).union(found.select(F.lit(2), "key"))
    return {**r, "cells": written(cells, "cells")}


@register("DiscreteConfigurationComplexLifting")
def agents(r: Relations, k: int = 2, feature_aggregation: str = "mean") -> Relations:
    """Only the new cells and their features, and y: the graph's own relations go."""
    cells = written(co.configurations(r["nodes"], undirected_edges(r), k), "cells")
    out = {"cells": cells}
    if "x" in r["nodes"].columns:
        x = arrays(r["nodes"]).select("node", F.get("x", F.lit(0)).alias("x"))
        out["x_0"] = co.configuration_features(cells, x, feature_aggregation)
    return out | ({"graphs": r["graphs"]} if "graphs" in r else {})


@register("HypergraphKHopLifting")
def khop_members(r: Relations, k_value: int = 1, feature_lifting: str | None = "ProjectionSum") -> Relations:
    return lifted_members(r, hy.khop_hyperedges(gr.khop(r["nodes"], r["edges"], k_value)), feature_lifting)


@register("HypergraphKNNLifting")
def knn_members(r: Relations, k_value: int = 1, feature_lifting: str | None = "ProjectionSum") -> Relations:
    return lifted_members(r, li.knn_hyperedges(arrays(r["nodes"]), k_value), feature_lifting)


@register("ModularityMaximizationLifting")
def community_members(r: Relations, num_communities: int = 2, k_neighbors: int = 3, feature_lifting: str | None = "ProjectionSum") -> Relations:
    return lifted_members(r, li.modularity_hyperedges(sp.one_graph(arrays(r["nodes"])), sp.one_graph(r["edges"]), num_communities, k_neighbors), feature_lifting)


@register("HypergraphKernelLifting")
def kernel(r: Relations, graph_kernel: str = "heat", feat_kernel: str = "identity", C: str = "prod", fraction: float = 0.5, feature_lifting: str | None = "ProjectionSum") -> Relations:
    found = li.kernel_members(sp.one_graph(arrays(r["nodes"])), sp.one_graph(undirected_edges(r)), graph_kernel, feat_kernel, C, fraction)
    ids = found.select(F.xxhash64("key").alias("he"), F.explode("key").alias("node"))
    return lifted_members(r, ids, feature_lifting)


@register("HypergraphFormanRicciCurvatureLifting")
def curvature_members(r: Relations, network_type: str = "unweighted", threshold_type: str = "quantile", threshold_direction: str = "above", threshold: float = 0.1, feature_lifting: str | None = "ProjectionSum") -> Relations:
    edges = r["edges"] if network_type == "weighted" else undirected_edges(r)
    return lifted_members(r, li.forman_hyperedges(r["nodes"], edges, threshold, threshold_type, threshold_direction, network_type == "weighted"), feature_lifting)


@register("MapperLifting")
def mapper(r: Relations, filter_attr: str = "laplacian", resolution: int = 10, gain: float = 0.3, filter_func: Callable[[Relations], DataFrame] | None = None, feature_lifting: str | None = "ProjectionSum") -> Relations:
    """Filters: feature_sum, position_sum (relation points), feature_pca, position_pca, svd, laplacian, or a function that
    gives (node, value)."""
    nodes = arrays(r["nodes"])
    filters = {
        "feature_sum": lambda: li.feature_sum(nodes),
        "position_sum": lambda: li.feature_sum(r["points"]),
        "feature_pca": lambda: li.principal_values(nodes, True),
        "position_pca": lambda: li.principal_values(r["points"], True),
        "svd": lambda: li.principal_values(nodes),
        "laplacian": lambda: sp.lap_pe(sp.one_graph(nodes), sp.one_graph(undirected_edges(r)), 2).select("node", F.get("x", F.lit(0)).alias("value")),
    }
    if filter_func is None and filter_attr not in filters:
        raise ValueError(f"no such filter: {filter_attr}")
    values = filter_func(r) if filter_func else filters[filter_attr]()
    found = li.mapper_hyperedges(r["edges"], values, resolution, gain)
    return lifted_members(r, found.select(F.xxhash64("kind", "a", "b").alias("he"), "node").distinct(), feature_lifting)


@register("ExpanderGraphLifting")
def expander(r: Relations, node_degree: int = 2, seed: int = 0, feature_lifting: str | None = "ProjectionSum") -> Relations:
    return lifted_members(r, li.expander_hyperedges(r["nodes"], node_degree, seed), feature_lifting)


@register("GraphTriangleInducedCC")
def triangle_cells(r: Relations) -> Relations:
    cells = written(co.triangle_induced(r["nodes"], undirected_edges(r)), "cells")
    return {**r, "cells": cells} | co.combinatorial_connectivity(cells, 3)


@register("UniversalStrictLifting")
def strict_cells(r: Relations, complex_dim: int = 3) -> Relations:
    cells = written(co.universal_strict(r["members"]).where(F.col("rank") <= complex_dim), "cells")
    return {**r, "cells": cells} | co.combinatorial_connectivity(cells, complex_dim)


@register("CofaceCCLifting")
def coface(r: Relations, keep_features: bool = False) -> Relations:
    """The complex and a 3-cell around each triangle; one of fewer than four nodes is left out if features are kept."""
    tops = cx.coface_lifting(r["cells"]).where(F.size("key") >= (4 if keep_features else 1))
    cells = written(r["cells"].where("rank <= 2").select("rank", "key").union(tops.select(F.lit(3), "key")), "cells")
    return {**r, "cells": cells} | co.combinatorial_connectivity(cells, 3)


@register("VoronoiLifting")
def voronoi(r: Relations, support_ratio: float = 0.1) -> Relations:
    return lifted_members(r, pt.voronoi(arrays(r["points"]), support_ratio))


@register("PointNetLifting")
def pointnet(r: Relations, sampling_ratio: float = 0.5, cluster_radius: float = 1.0) -> Relations:
    return lifted_members(r, li.pointnet_hyperedges(arrays(r["points"]), sampling_ratio, cluster_radius))


@register("MoGMSTLifting")
def mixtures(r: Relations, min_components: int | None = None, max_components: int | None = None, random_state: int = 0) -> Relations:
    return lifted_members(r, li.mixture_hyperedges(arrays(r["points"]), min_components, max_components, random_state))


@register("AlphaComplexLifting")
def alpha(r: Relations, alpha: float = 1.0, complex_dim: int = 2) -> Relations:
    cells = li.alpha_complex(sp.one_graph(arrays(r["points"])), alpha, complex_dim).select("rank", "key")
    return finished({**r, "nodes": arrays(r["points"])}, cells, complex_dim)


@register("RandomFlagComplexLifting")
def random_flag(r: Relations, steps: int = 1, p: float | None = None, alpha: float | None = None, complex_dim: int = 2, seed: int = 0) -> Relations:
    nodes = arrays(r["points"])
    return finished({**r, "nodes": nodes}, li.random_flag(nodes, steps, p, alpha, complex_dim, seed), complex_dim)


# ---- data manipulations


@register("IdentityTransform")
def unchanged(r: Relations) -> Relations:
    return r


@register("NodeFeaturesToFloat")
def to_float(r: Relations) -> Relations:
    return {**r, "nodes": r["nodes"].withColumn("x", F.col("x").cast("array<float>" if dict(r["nodes"].dtypes)["x"].startswith("array") else "float"))}


@register("EqualGausFeatures")
def equal_features(r: Relations, mean: float = 0.0, std: float = 1.0, num_features: int = 1, seed: int = 0) -> Relations:
    """The same random vector for all nodes."""
    import numpy as np

    x = np.random.default_rng(seed).normal(mean, std, num_features).tolist()
    return {**r, "nodes": r["nodes"].withColumn("x", F.array(*map(F.lit, x)))}


@register("NodeDegrees")
def node_degrees(r: Relations, selected_fields: tuple[str, ...] = ("edges",)) -> Relations:
    """node_degrees from edges as they are given, and `<r>_cell_degrees` from incidences: the sums of magnitudes of the
    rows of an operator whose name holds a selected field."""
    out = dict(r)
    for name, m in r.items():
        if not any(s in name for s in selected_fields) or name == "incidence_0":
            continue
        if name == "edges":
            out["node_degrees"] = gr.degrees(r["nodes"], m)
        elif {"row", "val"} <= set(m.columns):
            field = f"{int(name.rsplit('_', 1)[1]) - 1}_cell_degrees" if name.startswith("incidence_") else "node_degrees"
            out[field] = m.groupBy(F.col("row").alias("key")).agg(F.sum(F.abs("val")).alias("degree"))
    return out


@register("OneHotDegreeFeatures")
def one_hot(r: Relations, max_degree: int, cat: bool = False) -> Relations:
    hot = gr.one_hot_degrees(r.get("node_degrees", gr.degrees(r["nodes"], r["edges"])), max_degree).withColumnRenamed("x", "hot")
    joined = arrays(r["nodes"]).join(hot, "node")
    return {**r, "nodes": joined.withColumn("x", F.concat("x", "hot") if cat else F.col("hot")).drop("hot")}


@register("KeepOnlyConnectedComponent")
def largest(r: Relations, num_components: int = 1) -> Relations:
    """Strongly connected components of directed edges; nodes are renumbered."""
    kept = written(gr.largest_components(gr.strong_components(r["nodes"], r["edges"]), num_components), "kept")
    ids = kept.select("node", "id")
    nodes = r["nodes"].join(ids, "node").drop("node").withColumnRenamed("id", "node")
    edges = r["edges"].join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return {**r, "nodes": nodes, "edges": edges}


@register("InfereKNNConnectivity")
def knn_edges(r: Relations, k: int = 5, cosine: bool = False, loop: bool = False) -> Relations:
    """Edges from each of the k nearest to their centre; cosine distances are those of unit vectors."""
    points = arrays(r.get("points", r.get("nodes")))
    if cosine:
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        points = points.withColumn("x", F.transform("x", lambda v: v / F.greatest(norm, F.lit(1e-12))))
    return {**r, "edges": pt.knn(points, k, loop).select(F.col("node").alias("src"), F.col("center").alias("dst"))}


@register("InfereRadiusConnectivity")
def radius_edges(relations: Relations, r: float = 1.0, max_num_neighbors: int | None = 32) -> Relations:
    near = pt.radius(arrays(relations.get("points", relations.get("nodes"))), r, max_num_neighbors)
    return {**relations, "edges": near.select(F.col("node").alias("src"), F.col("center").alias("dst"))}


@register("LapPE")
def lap_pe(r: Relations, max_pe_dim: int, include_eigenvalues: bool = False, include_first: bool = False, concat_to_x: bool = True) -> Relations:
    made = sp.lap_pe(sp.one_graph(r["nodes"]), sp.one_graph(r["edges"]), max_pe_dim, include_first, include_eigenvalues)
    return with_encoding(r, "LapPE", made.select("node", F.col("x").alias("pe")), concat_to_x)


@register("RWSE")
def rwse(r: Relations, max_pe_dim: int, concat_to_x: bool = True) -> Relations:
    made = gr.rwse(r["nodes"], r["edges"], max_pe_dim)
    pe = F.transform(F.array_sort(F.collect_list(F.struct("step", "p"))), lambda s: s["p"]).alias("pe")
    return with_encoding(r, "RWSE", made.groupBy("node").agg(pe), concat_to_x)


def with_encoding(r: Relations, name: str, made: DataFrame, concat: bool) -> Relations:
    if not concat:
        return {**r, name: made}
    joined = arrays(r["nodes"]).join(made, "node")
    x = F.concat("x", "pe") if "x" in r["nodes"].columns else F.col("pe")
    return {**r, "nodes": joined.withColumn("x", x).drop("pe")}


@register("CombinedPSEs")
def encodings(r: Relations, encodings: list[str], parameters: dict[str, dict] | None = None) -> Relations:
    """Encodings in the order of the list; ValueError for an unknown one."""
    known = {"LapPE": lap_pe, "RWSE": rwse}
    for name in encodings:
        if name not in known:
            raise ValueError(f"no such encoding: {name}")
        r = known[name](r, **(parameters or {}).get(name, {}))
    return r


@register("CalculateSimplicialCurvature")
def curvature(r: Relations) -> Relations:
    return {**r, **{f"{rank}_cell_curvature": k for rank, k in si.simplicial_curvature(r["cells"]).items()}}


@register("GroupCombinatorialHomophily")
def group_homophily(r: Relations, top_k: int = 3) -> Relations:
    d, dt, b = hy.group_homophily(r["members"], r["nodes"].select("node", "y"), top_k)
    return {**r, "homophily_D": d, "homophily_Dt": dt, "homophily_B": b}


@register("MessagePassingHomophily")
def message_homophily(r: Relations, num_steps: int = 3) -> Relations:
    labels = r["nodes"].select("node", "y")
    shares = hy.message_homophily(r["members"], labels, num_steps)
    return {**r, "message_homophily": shares, "class_homophily": ev.class_homophily(shares, labels, r["members"])}


@register("RedefineSimplicialNeighbourhoods")
def redefine(r: Relations, complex_dim: int = 2, neighborhoods: list[str] | None = None, signed: bool = False) -> Relations:
    """Keeps nodes, edges, features and labels only, with the complex and its operators made anew from the edges."""
    adjacency = r["edges"].select(F.col("src").alias("row"), F.col("dst").alias("col"))
    cells, operators = si.redefined(r["nodes"], adjacency, complex_dim, neighborhoods, signed)
    kept = {k: v for k, v in r.items() if k in ("nodes", "edges", "graphs", "x_0", "x_1", "x_2")}
    return {**kept, "cells": cells} | operators


for _name, _feature in (("ProjectionSum", projected), ("Concatenation", concatenated), ("Set", vertex_sets)):
    register(_name)(lambda r, complex_dim=2, f=_feature: {**r, **f(r, complex_dim)})
