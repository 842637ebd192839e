"""Liftings with known answers on the small structures."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import combinatorial as co
from cellspark.operators import complex as cx
from cellspark.operators import graph as gr
from cellspark.operators import lifting as li
from cellspark.operators import simplicial as si
from cellspark.sources import fixtures as fx

NEAR = {i: {i} | {b for a, b in fx.EDGES if a == i} | {a for a, b in fx.EDGES if b == i} for i in range(8)}


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges = fx.manual_graph(spark)
    return nodes.cache(), edges.cache()


def keys(cells, rank):
    return sorted(tuple(r["key"]) for r in cells.where(F.col("rank") == rank).collect())


def members(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["he"], set()).add(r["node"])
    return out


def test_khop_and_its_cap(graph):
    want = sorted({c for near in NEAR.values() for c in combinations(sorted(near), 3)})
    assert keys(si.khop_complex(*graph, 2), 2) == want
    capped = sorted({c for near in NEAR.values() for c in list(combinations(sorted(near), 3))[:4]})
    assert keys(si.khop_complex(*graph, 2, 3), 2) == capped


def test_connected_sets(graph):
    def connected(nodes):
        seen, queue = {nodes[0]}, [nodes[0]]
        for v in queue:
            for w in NEAR[v] & set(nodes) - seen:
                seen.add(w)
                queue.append(w)
        return len(seen) == len(nodes)

    for size in (3, 4):
        got = sorted(tuple(r["key"]) for r in si.connected_subsets(graph[1], size).collect())
        assert got == [c for c in combinations(range(8), size) if connected(c)]
    assert set(keys(si.induced_complex(*graph, 2), 1)) > {tuple(sorted(e)) for e in fx.EDGES}  # faces of triples too


def test_distances_and_what_needs_them(graph):
    d = {(r["center"], r["node"]): r["d"] for r in si.distances(*graph).collect()}
    assert len(d) == 64 and all((d[a, b] == 1) == (b in NEAR[a] and a != b) for a, b in d)
    assert {r["node"]: r["eccentricity"] for r in si.eccentricities(*graph).collect()} == {a: max(d[a, b] for b in range(8)) for a in range(8)}
    want = [c for c in combinations(range(8), 3) if all(d[p] <= 2 for p in combinations(c, 2))]
    assert keys(si.vietoris_rips(*graph, 2, 2), 2) == want
    assert len(keys(si.eccentricity_complex(*graph, 3), 2)) == 56
    with pytest.raises(Exception, match="not connected"):
        si.eccentricities(graph[0].union(graph[0].selectExpr("99 AS node", "x", "y")), graph[1]).collect()
    with pytest.raises(ValueError, match="more than 3 nodes"):
        si.eccentricity_complex(*graph, 2, 3)


def test_line_complex(graph):
    ids, cells = si.line_complex(*graph, 2)
    ids = {r["id"]: r for r in ids.collect()}
    assert len(ids) == 13 and ids[0]["x"] == (fx.X[0] + fx.X[1]) / 2
    ends = {i: {r["src"], r["dst"]} for i, r in ids.items()}
    for rank in (1, 2):
        assert keys(cells, rank) == [c for c in combinations(range(13), rank + 1) if all(ends[a] & ends[b] for a, b in combinations(c, 2))]


def test_dice_is_deterministic_and_closed(graph):
    a, b = (si.dice_complex(*graph, 2, seed=3) for _ in range(2))
    assert keys(a, 2) == keys(b, 2) and keys(a, 1)
    assert {p for k in keys(a, 2) for p in combinations(k, 2)} <= set(keys(a, 1))


def test_curvature_of_simplices(graph):
    cells = cx.clique_lifting(*graph, 3).cache()
    got = {rank: {tuple(r["key"]): r["curvature"] for r in k.collect()} for rank, k in si.simplicial_curvature(cells).items()}
    triangles, tets = keys(cells, 2), keys(cells, 3)
    for a, b in keys(cells, 1):
        assert got[1][a, b] == 4 - (len(NEAR[a]) - 1) - (len(NEAR[b]) - 1) + 3 * sum({a, b} <= set(t) for t in triangles)
    assert all(got[0][(v,)] == sum(k for e, k in got[1].items() if v in e) for v in range(8))
    for t in triangles:
        others = [u for u in triangles if u != t]
        off = sum((len(set(t) & set(u)) == 2) - sum(set(t) | set(u) <= set(k) for k in tets) for u in others)
        assert got[2][t] == 3 + sum(set(t) <= set(k) for k in tets) - off


def test_connectivity_has_every_operator(graph):
    cells = cx.clique_lifting(*graph, 2)
    got = si.connectivity(cells, 2)
    names = {f"{k}_{r}" for r in range(3) for k in ("incidence", "down_laplacian", "up_laplacian", "adjacency", "coadjacency", "hodge_laplacian")}
    assert set(got) == names and got["down_laplacian_0"].count() == got["up_laplacian_2"].count() == 0
    assert si.zero_connectivity(got["adjacency_0"]).count() == 0 and si.cell_counts(cells, 3) == [8, 13, 6, 0]
    assert set(si.connectivity(cells, 2, neighborhoods=["2-up_adjacency-0"])) == {"incidence_0", "incidence_1", "incidence_2", "2-up_adjacency-0"}


def test_edge_features(graph):
    nodes, edges = graph
    x = edges.withColumn("x", F.col("src") + F.col("dst"))
    assert si.edge_features(cx.clique_lifting(nodes, edges, 2), edges, x).count() == 13
    more = si.khop_complex(nodes, edges, 2)  # which adds edges
    assert si.edge_features(more, edges, x, strict=False) is None
    with pytest.raises(ValueError, match="1-cells for 13 edges"):
        si.edge_features(more, edges, x)


def test_universal_strict(spark):
    cells = co.universal_strict(fx.manual_hypergraph(spark))
    assert keys(cells, 3) == [(0, 1, 2, 3)]
    assert keys(cells, 2) == [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6, 7)]
    assert len(keys(cells, 1)) == 11 and len(keys(cells, 0)) == 8
    got = co.combinatorial_connectivity(cells, 3)
    assert got["incidence_3"].count() == 4 and got["adjacency_2"].count() == 12  # triples under one cell


def test_triangle_induced(spark):
    cells = co.triangle_induced(*fx.second_graph(spark))
    assert keys(cells, 2) == [(3, 4, 5, 6, 7, 10, 11), (3, 4, 6, 9)]
    assert keys(cells, 3) == [(3, 4, 5, 6, 7, 9, 10, 11)]


def test_configurations(graph):
    nodes, edges = graph
    cells = co.configurations(nodes, edges, 2).cache()
    assert {r["rank"]: r["count"] for r in cells.groupBy("rank").count().collect()} == {0: 56, 1: 156, 2: 86}
    x = nodes.select("node", "x")
    got = {tuple(r["key"]): r["x"] for r in co.configuration_features(cells, x, "mean").collect()}
    assert got["0", "7"] == (fx.X[0] + fx.X[7]) / 2 and len(got) == 56
    assert {tuple(r["key"]): r["x"] for r in co.configuration_features(cells, x, "concat").collect()}["7", "0"] == [5000.0, 1.0]
    with pytest.raises(ValueError, match="two agents"):
        co.configurations(nodes, edges, 1)


def test_forman_hyperedges(graph):
    def sizes(*args):
        return sorted(map(tuple, members(li.forman_hyperedges(*graph, *args)).values()), key=lambda s: (-len(s), s))

    assert sizes(0.6, "quantile", "above") == [(0, 1, 2, 3, 4, 5, 7), (6,)]
    assert len(sizes(-200, "absolute", "above")) == 8 and len(sizes(-1, "absolute", "above")) == 1
    assert sizes(-1, "absolute", "below")[0] == (3, 5, 6)
    with pytest.raises(ValueError, match="no such threshold"):
        li.forman_hyperedges(*graph, 0.1, "relative")


def test_quantile(spark):
    values = np.random.default_rng(1).normal(size=501).round(1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.1, 0.5, 0.613, 1.0):
        assert math.isclose(li.quantile(df, "v", q), np.quantile(values, q), abs_tol=1e-12)


def test_mapper(graph):
    nodes, edges = graph
    values = nodes.select("node", F.col("x").alias("value"))
    got = li.mapper_hyperedges(gr.symmetric(edges), values, 10, 0.3).collect()
    assert len({(r["a"], r["b"]) for r in got if r["kind"] == "edge"}) == 26
    cover = {(r["node"], r["i"]) for r in li.mapper_cover(values).collect()}
    width = (max(fx.X) - min(fx.X) + 2e-3) / (10 - 9 * 0.3)
    want = {(n, i) for n, x in enumerate(fx.X) for i in range(10) if 0 <= x - (min(fx.X) - 1e-3 + i * width * 0.7) <= width}
    assert cover == want
    with pytest.raises(ValueError, match="gain"):
        li.mapper_cover(values, 10, 0.6)


def test_k_means():
    x = np.array([(1, 1), (1, 2), (2, 1), (2, 2), (9, 9), (9, 10), (10, 9), (10, 10)], float)
    own = li.k_means(x, 2)
    assert len(set(own[:4])) == len(set(own[4:])) == 1 and own[0] != own[4]


def test_communities_and_their_hyperedges(graph):
    nodes, edges = graph
    many = fx.with_graph_id(nodes.select("node", F.array("x").alias("x"))), fx.with_graph_id(gr.symmetric(edges))
    own = {r["node"]: r["community"] for r in li.communities(*many, 2).collect()}
    got = members(li.modularity_hyperedges(*many, 2, 2))
    assert len(own) == 8 and all(j in got[j] and all(own[i] == own[j] for i in got[j]) for j in got)


def test_expander(spark):
    nodes = spark.range(40).withColumnRenamed("id", "node")
    got = members(li.expander_hyperedges(nodes, 4, seed=2))
    assert len(got) == 80 and all(len(v) == 2 for v in got.values()) and len({frozenset(v) for v in got.values()}) == 80
    assert all(sum(i in v for v in got.values()) == 4 for i in range(40))
    with pytest.raises(ValueError, match="even"):
        li.expander_hyperedges(nodes, 3)


def test_point_clouds(spark):
    cloud = fx.manual_cloud(spark)
    assert sorted(len(v) for v in members(li.pointnet_hyperedges(cloud, 0.26, 2.0)).values()) == [1, 3, 4, 4]
    lone = members(li.pointnet_hyperedges(cloud, 0.05, 0.5))
    assert sorted(i for v in lone.values() for i in v) == list(range(12)) and len(lone) == 12
    got = members(li.mixture_hyperedges(cloud, 2, 3))
    k = len(got) // 2
    assert sorted(i for he, v in got.items() if he < k for i in v) == list(range(12))


def test_alpha_complex(spark):
    got = li.alpha_complex(fx.with_graph_id(fx.manual_points(spark)), 25.0, 3)
    assert keys(got, 1) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (4, 5), (4, 6), (5, 6)]
    assert keys(got, 2) == [(0, 1, 2), (1, 2, 3), (4, 5, 6)] and keys(got, 3) == []
    assert len(keys(got, 0)) == 7


def test_betti_numbers(spark):
    hollow = [[0], [1], [2], [3], [0, 1], [1, 2], [0, 2]]
    sphere = [list(c) for r in (1, 2, 3) for c in combinations(range(4), r)]
    rows = [(g, len(k) - 1, k) for g, ks in ((0, hollow), (1, sphere)) for k in ks]
    got = {(r["graph_id"], r["rank"]): r["betti"] for r in li.betti_numbers(spark.createDataFrame(rows, "graph_id long, rank int, key array<long>"), 2).collect()}
    assert got == {(0, 0): 2, (0, 1): 1, (0, 2): 0, (1, 0): 1, (1, 1): 0, (1, 2): 1}


def test_random_flag(spark):
    nodes = spark.range(30).withColumnRenamed("id", "node")
    everything, nothing = li.random_flag(nodes, p=1.0, dim=2), li.random_flag(nodes, p=0.0, dim=2)
    assert si.cell_counts(everything, 2) == [30, 435, 4060] and si.cell_counts(nothing, 2) == [30, 0, 0]
    some = si.cell_counts(li.random_flag(nodes, steps=2, p=0.2, dim=1), 1)
    assert 435 * 0.36 * 0.6 < some[1] < 435 * 0.36 * 1.4
    with pytest.raises(ValueError, match="either"):
        li.random_flag(nodes)


def test_latent_cliques_cover_the_graph(graph):
    nodes, edges = graph
    got = li.latent_cliques(fx.with_graph_id(nodes), fx.with_graph_id(edges), 5, 0.9, 1)
    assert {tuple(sorted(e)) for e in fx.EDGES} <= set(keys(got, 1)) and len(keys(got, 0)) == 8


def test_kernels(graph):
    nodes, edges = graph
    many = fx.with_graph_id(nodes.select("node", F.array("x").alias("x"))), fx.with_graph_id(edges)
    src, dst = np.array(fx.EDGES).T
    assert np.allclose(li.graph_kernel("identity", 8, src, dst), 1)
    assert np.allclose(np.linalg.inv(li.graph_kernel("matern", 8, src, dst)), 2 * np.eye(8) + li.laplacian(8, src, dst))
    assert li.kernel_members(*many, "identity", "identity").count() == 1  # all ones: one hyperedge of all
    with pytest.raises(ValueError, match="combination"):
        li.kernel_members(*many, combine="difference")
