"""Cliques over ranges of ids, held against brute force where ids fall into many ranges."""

import random
from itertools import combinations

import pytest

from cellspark.operators import complex as cx
from cellspark.operators import graph as gr
from cellspark.operators import ranges as ra
from cellspark.operators import simplicial as si


@pytest.fixture(params=[3, 7, 1000])
def graph(request, monkeypatch, spark):
    """Dense in parts, with loops, repeated and turned edges, nodes without edges, and an edge's end that is no node."""
    monkeypatch.setattr(ra, "NODES", request.param)
    rng = random.Random(5)
    ids = rng.sample(range(-60, 60), 30)
    pairs = {tuple(sorted(p)) for p in combinations(ids[:26], 2) if rng.random() < 0.35} | {(ids[0], 500)}
    rows = [*pairs, (ids[0], ids[0]), next(iter(pairs)), (None, ids[1])] + [(b, a) for a, b in list(pairs)[:5]]
    edges = spark.createDataFrame(rows, "src long, dst long").repartition(3)
    nodes = spark.createDataFrame([(i, float(i) / 4 if i != ids[2] else None) for i in ids], "node long, x double")
    return nodes, edges, {(min(p), max(p)) for p in pairs}


def cliques(pairs, size):
    ids = sorted({v for p in pairs for v in p})
    found = [(v,) for v in ids]
    for _ in range(size - 1):
        found = [(*k, v) for k in found for v in ids if v > k[-1] and all((u, v) in pairs for u in k)]
    return sorted(found)


def keys(df):
    return sorted(tuple(r[0]) for r in df.select(df.columns[0]).collect())


def test_cliques_and_maximal_triangles(graph):
    nodes, edges, pairs = graph
    ids, three, four = nodes.select("node"), cliques(pairs, 3), cliques(pairs, 4)
    assert three and four
    assert keys(ra.cliques(edges, ids, 3)) == three
    assert keys(ra.cliques(edges, ids, 4)) == four
    assert keys(ra.maximal_triangles(edges, ids)) == sorted(set(three) - {t for k in four for t in combinations(k, 3)})
    assert sorted(tuple(r) for r in gr.triangles(edges).collect()) == three


def test_values_and_clustering(graph):
    nodes, edges, pairs = graph
    x = {r["node"]: r["x"] for r in nodes.collect()}
    three = cliques(pairs, 3)
    sums = {t: None if any(x[v] is None for v in t) else 2 * sum(x[v] for v in t) for t in three if all(v in x for v in t)}
    assert {tuple(r["cell"]): r["x"] for r in ra.triangle_sums(nodes, edges).collect()} == sums
    ends = {p: (x[p[0]], x[p[1]]) for p in pairs if p[0] in x and p[1] in x}
    assert {tuple(r["cell"]): (r["first"], r["second"]) for r in ra.edge_values(nodes, edges).collect()} == ends
    degree = {v: sum(v in p for p in pairs) for v in x}
    want = {v: 2 * sum(v in t for t in three) / (k * (k - 1)) if k > 1 else 0.0 for v, k in degree.items()}
    assert {r["node"]: r["coefficient"] for r in gr.clustering(nodes, edges).collect()} == pytest.approx(want)


def test_curvature_is_that_of_the_cells(graph, spark):
    nodes, edges, pairs = graph
    clean = spark.createDataFrame(sorted(pairs), "src long, dst long")
    every = nodes.select("node").union(spark.createDataFrame([(500,)], "node long"))
    want = si.simplicial_curvature(cx.clique_lifting(every, clean, 3))
    got = si.clique_curvature(every, edges)
    for rank in (0, 1, 2):
        both = [{tuple(r["key"]): r["curvature"] for r in c[rank].collect()} for c in (got, want)]
        assert both[0] and both[0] == both[1]


def test_paths_are_no_rows(graph):
    """Triangles come without a join, so that no path of two edges is shuffled."""
    nodes, edges, _ = graph
    plan = ra.cliques(edges, nodes.select("node"), 3)._jdf.queryExecution().optimizedPlan().toString()
    lifted = cx.clique_lifting(nodes, edges, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Join" not in lifted
