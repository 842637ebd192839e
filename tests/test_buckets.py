"""Triangles by classes of buckets, held against brute force where nodes fall into many, and what is sent for them."""

import random
from itertools import combinations

import numpy as np
import pytest

from cellspark.operators import buckets as bu
from cellspark.operators import complex as cx
from cellspark.operators import graph as gr
from cellspark.operators import ranges as ra
from cellspark.operators import simplicial as si


@pytest.fixture
def graph(monkeypatch, spark):
    """Neighbours anywhere, a hub, and ids that are far apart; five classes."""
    monkeypatch.setattr(ra, "NODES", 4)
    monkeypatch.setattr(bu, "HELD", 70)
    monkeypatch.setattr(bu, "PATHS", 10)
    rng = random.Random(3)
    ids = [rng.randrange(-(2**40), 2**40) for _ in range(18)] + list(range(0, 640, 64))
    pairs = {tuple(sorted(p)) for p in combinations(ids, 2) if rng.random() < 0.4 or ids[0] in p}
    edges = spark.createDataFrame([*pairs, *list(pairs)[:9]], "src long, dst long").repartition(2)
    nodes = spark.createDataFrame([(i, float(i % 7)) for i in ids], "node long, x double")
    return nodes, edges, pairs


def cliques(pairs, size):
    ids = sorted({v for p in pairs for v in p})
    return sorted(k for k in combinations(ids, size) if all(p in pairs for p in combinations(k, 2)))


def keys(df):
    return sorted(tuple(r[0]) for r in df.collect())


def test_an_edge_is_sent_as_often_as_there_are_classes(graph):
    """not to each two buckets where a node of it may have a neighbour."""
    nodes, edges, pairs = graph
    made = ra.graph_of(edges, nodes.select("node"))
    blocks = made.blocks.collect()
    assert made.n == 7 and made.classes == int(np.ceil((9 * len(pairs) / 70) ** 0.5)) > 3
    assert sum(b["size"] for b in blocks) == len(pairs)
    sent = made.worked(lambda part: iter([[bu.pa.array([len(part.lo)])]]), "edges long").collect()
    assert sum(s["edges"] for s in sent) == made.classes * len(pairs)


def test_ids_come_back(graph):
    ids = np.array([-(2**62), -1, 0, 1, 63, 64, 2**40, 2**62])
    for n in (1, 7, 128):
        bucket, at = bu.places(ids, n)
        assert [int(bu.named(b, a, n)) for b, a in zip(bucket, at)] == ids.tolist()
        assert set(bu.places(np.arange(0, 6400, 64), 16)[0].tolist()) == set(range(16))


def test_clustering(graph):
    """F7."""
    nodes, edges, pairs = graph
    three = cliques(pairs, 3)
    degree = {v: sum(v in p for p in pairs) for (v,) in nodes.select("node").collect()}
    want = {v: 2 * sum(v in t for t in three) / (k * (k - 1)) if k > 1 else 0.0 for v, k in degree.items()}
    assert {r["node"]: r["coefficient"] for r in gr.clustering(nodes, edges).collect()} == pytest.approx(want)


def test_curvature(graph):
    """F3, F5."""
    nodes, edges, pairs = graph
    three, ids = cliques(pairs, 3), [v for (v,) in nodes.select("node").collect()]
    degree = {v: sum(v in p for p in pairs) for v in ids}
    one = {p: 4.0 - degree[p[0]] - degree[p[1]] + 3 * sum(set(p) < set(t) for t in three) for p in pairs}
    got = si.clique_curvature(nodes, edges, [0, 1])
    assert {tuple(r["key"]): r["curvature"] for r in got[1].collect()} == one
    assert {tuple(r["key"]): r["curvature"] for r in got[0].collect()} == {(v,): float(sum(c for p, c in one.items() if v in p)) for v in ids}


def test_sums_over_triangles(graph):
    """F1, F8."""
    nodes, edges, pairs = graph
    x = {r["node"]: r["x"] for r in nodes.collect()}
    want = {t: 2 * sum(x[v] for v in t) for t in cliques(pairs, 3)}
    assert {tuple(r["cell"]): r["x"] for r in ra.triangle_sums(nodes, edges).collect()} == want
    assert keys(ra.cliques(edges, nodes.select("node"), 3)) == sorted(want)


def test_fours_and_maximal_triangles(graph):
    """F2, F4."""
    nodes, edges, pairs = graph
    ids, four = nodes.select("node"), cliques(pairs, 4)
    inside = {t for k in four for t in combinations(k, 3)}
    assert keys(ra.cliques(edges, ids, 4)) == four
    assert keys(ra.maximal_triangles(edges, ids)) == sorted(set(cliques(pairs, 3)) - inside)


def test_one_rank_of_cells(graph, monkeypatch):
    """edges alone are made without a packed graph; no rank is lost."""
    nodes, edges, pairs = graph
    whole = cx.clique_lifting(nodes, edges.distinct(), 2)
    want = [keys(whole.where(f"rank = {r}").select("key")) for r in range(3)]
    assert keys(cx.clique_lifting(nodes, edges.distinct(), 2, 2).select("key")) == want[2] == cliques(pairs, 3)
    monkeypatch.setattr(cx, "graph_of", None)
    assert keys(cx.clique_lifting(nodes, edges.distinct(), 2, 1).select("key")) == want[1] == sorted(pairs)


@pytest.fixture
def apart(monkeypatch, spark):
    """Parts of near ids, of 6 nodes each, without edges between them."""
    monkeypatch.setattr(ra, "NODES", 6)
    monkeypatch.setattr(bu, "HELD", 12)
    pairs = {(6 * i + a, 6 * i + b) for i in range(8) for a, b in combinations(range(6), 2) if (a + b + i) % 7}
    return spark.createDataFrame([(i, float(i % 5)) for i in range(48)], "node long, x double"), spark.createDataFrame(sorted(pairs), "src long, dst long"), pairs


def test_edges_between_near_ids_are_sent_once(apart):
    """where no three classes have edges between every two, no task of theirs gets any."""
    nodes, edges, pairs = apart
    made = ra.graph_of(edges, nodes.select("node"))
    sent = made.worked(lambda part: iter([[bu.pa.array([len(part.lo)])]]), "edges long").collect()
    assert made.classes > 3 and sum(s["edges"] for s in sent) == len(pairs)
    assert keys(ra.cliques(made, nodes.select("node"), 3)) == cliques(pairs, 3)


def test_few_ids_with_most_edges(monkeypatch, spark):
    """ranges of ids would bring a task too many edges, so buckets are those of a hash."""
    monkeypatch.setattr(ra, "NODES", 8)
    monkeypatch.setattr(bu, "HELD", 90)
    pairs = {(a, b) for a, b in combinations(range(64), 2) if a < 8 or b == a + 1}
    edges, ids = spark.createDataFrame(sorted(pairs), "src long, dst long"), spark.range(64).toDF("node")
    made = ra.graph_of(edges, ids)
    assert made.buckets.starts is None
    assert keys(ra.cliques(made, ids, 3)) == cliques(pairs, 3)


def test_curvature_of_triangles(graph, monkeypatch):
    """rank 2 goes by the blocks too, not to each set of three ranges."""
    nodes, edges, pairs = graph
    monkeypatch.setattr(ra, "gathered", None)
    three, four = cliques(pairs, 3), cliques(pairs, 4)
    on = {p: sum(set(p) < set(t) for t in three) for p in pairs}
    want = {t: 3.0 + 4 * sum(set(t) < set(k) for k in four) - sum(on[p] - 1 for p in combinations(t, 2)) for t in three}
    assert {tuple(r["key"]): r["curvature"] for r in si.clique_curvature(nodes, edges, [2])[2].collect()} == want


def test_triangles_of_near_ids_are_sent_once(apart, monkeypatch):
    """their nodes are of one bucket, so one task makes the links of all three."""
    nodes, edges, pairs = apart
    ids, three, four = nodes.select("node"), cliques(pairs, 3), cliques(pairs, 4)
    monkeypatch.setattr(ra, "gathered", None)
    made = ra.graph_of(edges, ids)
    assert made.near and three and four
    on = {p: sum(set(p) < set(t) for t in three) for p in pairs}
    want = {t: 3.0 + 4 * sum(set(t) < set(k) for k in four) - sum(on[p] - 1 for p in combinations(t, 2)) for t in three}
    assert {tuple(r["key"]): r["curvature"] for r in ra.curvature(made, ids, 2).collect()} == want
    assert keys(ra.cliques(made, ids, 4)) == four
    assert keys(ra.maximal_triangles(made, ids)) == sorted(set(three) - {t for k in four for t in combinations(k, 3)})
