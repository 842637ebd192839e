"""Named transforms over relations, resolvers, loaders, message passing and the evaluator."""

import json
import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.functions import registry, resolvers, transforms
from cellspark.operators import complex as cx
from cellspark.operators import evaluation as ev
from cellspark.operators import graph as gr
from cellspark.operators import messages as ms
from cellspark.sources import fixtures as fx
from cellspark.sources import loaders

SIMPLICIAL = ["SimplicialCliqueLifting", "SimplicialKHopLifting", "SimplicialGraphInducedLifting", "SimplicialVietorisRipsLifting", "NeighborhoodComplexLifting", "SimplicialDnDLifting", "SimplicialLineLifting", "SimplicialCliquesLEQLifting", "LatentCliqueLifting"]
HYPER = [("HypergraphKHopLifting", {}), ("HypergraphKNNLifting", {"k_value": 2}), ("HypergraphFormanRicciCurvatureLifting", {"threshold": 0.6}), ("MapperLifting", {"filter_attr": "feature_sum"}), ("ExpanderGraphLifting", {"node_degree": 2}), ("ModularityMaximizationLifting", {}), ("HypergraphKernelLifting", {})]


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges = fx.manual_graph(spark)
    return {"nodes": nodes.cache(), "edges": edges.cache()}


def test_liftings_by_name(graph):
    for name in SIMPLICIAL:
        got = registry.chain({"transform_name": name, "complex_dim": 2})(graph)
        assert got["cells"].where("rank = 0").count() >= 8 and {"incidence_1", "adjacency_0", "x_0", "x_1", "x_2"} <= set(got), name


def test_clique_lifting_carries_features(graph):
    got = registry.chain({"transform_name": "SimplicialCliqueLifting", "complex_dim": 3, "neighborhoods": ["up_adjacency-1"]})(graph)
    x2 = {tuple(r["cell"]): r["x"][0] for r in got["x_2"].collect()}
    assert x2 == {t: 2 * sum(fx.X[i] for i in t) for t in x2} and len(x2) == 6
    assert "up_adjacency-1" in got and "hodge_laplacian_1" not in got
    edges = graph["edges"].withColumn("x", F.array(F.lit(1.0)))
    own = registry.chain({"transform_name": "SimplicialCliqueLifting", "complex_dim": 1, "preserve_edge_attr": True})({**graph, "edges": edges})
    assert {tuple(r["x"]) for r in own["x_1"].collect()} == {(1.0,)}
    with pytest.raises(ValueError, match="no such feature lifting"):
        registry.chain({"transform_name": "SimplicialCliqueLifting", "feature_lifting": "Average"})(graph)


def test_hypergraphs_by_name(graph):
    for name, parameters in HYPER:
        got = registry.chain({"transform_name": name, **parameters})(graph)
        assert got["members"].columns == ["he", "node"] and got["x_hyperedges"].count() == got["members"].select("he").distinct().count(), name


def test_other_domains_by_name(spark, graph):
    run = lambda name, r, **p: registry.chain({"transform_name": name, **p})(r)
    cloud = {"points": fx.manual_cloud(spark)}
    assert run("VoronoiLifting", cloud, support_ratio=0.26)["members"].count() == 12
    assert run("PointNetLifting", cloud, sampling_ratio=0.26, cluster_radius=2.0)["members"].count() == 12
    assert run("AlphaComplexLifting", {"points": fx.manual_points(spark)}, alpha=25.0)["cells"].where("rank = 2").count() == 3
    assert run("UniversalStrictLifting", {"members": fx.manual_hypergraph(spark)})["cells"].where("rank = 3").count() == 1
    assert run("CofaceCCLifting", {"cells": fx.manual_complex(spark)})["cells"].where("rank = 3").count() == 3
    assert run("CellCycleLifting", graph)["cells"].where("rank = 2").count() == 6
    assert set(run("DiscreteConfigurationComplexLifting", graph)) == {"cells", "x_0"}
    assert run("GraphTriangleInducedCC", graph)["cells"].where("rank = 3").count() == 1


def test_manipulations_by_name(spark, graph):
    run = lambda name, relations=graph, **p: registry.chain({"transform_name": name, **p})(relations)
    assert len({tuple(r["x"]) for r in run("EqualGausFeatures", num_features=3)["nodes"].collect()}) == 1
    assert dict(run("NodeFeaturesToFloat")["nodes"].dtypes)["x"] == "float"
    assert run("OneHotDegreeFeatures", max_degree=6, cat=True)["nodes"].select(F.size("x")).distinct().collect()[0][0] == 8
    assert run("KeepOnlyConnectedComponent", {**graph, "edges": gr.symmetric(graph["edges"])})["nodes"].count() == 8
    assert run("InfereKNNConnectivity", k=2)["edges"].count() == 16
    assert run("InfereRadiusConnectivity", r=10.0)["edges"].count() == 6
    pse = run("CombinedPSEs", {**graph, "edges": gr.symmetric(graph["edges"])}, encodings=["LapPE", "RWSE"], parameters={"LapPE": {"max_pe_dim": 3}, "RWSE": {"max_pe_dim": 2}})
    assert pse["nodes"].select(F.size("x")).distinct().collect()[0][0] == 6
    with pytest.raises(ValueError, match="no such encoding"):
        run("CombinedPSEs", encodings=["Other"])
    lifted = run("SimplicialCliqueLifting", complex_dim=3)
    assert {"0_cell_curvature", "1_cell_curvature", "2_cell_curvature"} <= set(run("CalculateSimplicialCurvature", lifted))
    degrees = run("NodeDegrees", lifted, selected_fields=["edges", "incidence"])
    assert {"node_degrees", "0_cell_degrees", "1_cell_degrees"} <= set(degrees)
    assert {r["key"][0]: r["degree"] for r in degrees["0_cell_degrees"].collect()}[2] == 6
    again = run("RedefineSimplicialNeighbourhoods", lifted, complex_dim=2, neighborhoods=["up_adjacency-0"])
    assert again["up_adjacency-0"].count() == 26 and "2_cell_curvature" not in again
    hyper = {"members": fx.manual_hypergraph(spark), "nodes": graph["nodes"]}
    assert {"homophily_D", "homophily_Dt", "homophily_B"} <= set(run("GroupCombinatorialHomophily", hyper))
    assert run("MessagePassingHomophily", hyper, num_steps=2)["class_homophily"].count() == 4


def test_kept_results_know_their_data(spark, tmp_path):
    registry.register("Odd")(lambda relations: {"n": relations["n"].where("id % 2 = 1")})
    for n in (5, 9):
        got = registry.cached(spark, str(tmp_path), {"n": spark.range(n)}, {"transform_name": "Odd"})
        assert got["n"].count() == n // 2
    assert registry.make_hash({"a": 1}) == registry.make_hash({"a": 1}) < 2**32


def test_resolvers():
    assert resolvers.required_lifting("graph", "graph/gcn") == "no_lifting"
    assert resolvers.default_transform("graph/Cora", "cell/can") == "liftings/graph2cell_default"
    assert resolvers.default_transform("graph/Cora", "graph/gcn", {"Cora"}, {"gcn"}) == "dataset_model_defaults/Cora_gcn"
    assert resolvers.monitored("regression", "mse") == ("val/mse", "min") and resolvers.default_metrics("classification")[0] == "accuracy"
    lifting = {"graph2cell_lifting": {"complex_dim": 3, "feature_lifting": "Concatenation"}}
    assert resolvers.in_channels(4, lifting) == [4, 8, 24] and resolvers.in_channels(4, None) == [4]
    pse = {"CombinedPSEs": {"encodings": ["LapPE", "RWSE"], "parameters": {"LapPE": {"max_pe_dim": 2, "include_eigenvalues": True}, "RWSE": {"max_pe_dim": 3}}}}
    assert resolvers.added_features(pse) == 7 and resolvers.in_channels([4, 2], {**pse, "graph2simplicial": {"complex_dim": 3, "preserve_edge_attr": True}}) == [11, 2, 2]
    assert resolvers.neighbourhood_dimensions(["up_adjacency-0", "2-down_incidence-2"]) == 3
    with pytest.raises(ValueError, match="no such task"):
        resolvers.monitored("clustering", "x")


def test_loaders(spark, tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        (path.write_bytes if isinstance(content, bytes) else path.write_text)(content)

    put("M_A.txt", "1, 2\n2, 1\n3, 4\n")
    put("M_graph_indicator.txt", "1\n1\n2\n2\n")
    put("M_graph_labels.txt", "-1\n1\n")
    put("M_node_labels.txt", "0\n2\n1\n0\n")
    got, folder = loaders.Dataset("tu", str(tmp_path), {"name": "M"}).load(spark)
    assert folder == str(tmp_path) and {(r["graph_id"], r["y"]) for r in got["graphs"].collect()} == {(0, 0), (1, 1)}
    assert {r["node"]: r["x"] for r in got["nodes"].collect()}[2] == [0.0, 0.0, 1.0] and got["edges"].count() == 3
    put("cora.content", "a 1 0 X\nb 0 1 Y\nc 1 1 X\n")
    put("cora.cites", "a b\nb c\nz a\n")
    got = loaders.LOADERS["citation_text"](spark, str(tmp_path))
    assert got["nodes"].count() == 3 and got["edges"].count() == 4 and {r["y"] for r in got["nodes"].collect()} == {0, 1}
    np.savez(tmp_path / "mine.npz", node_features=np.eye(3), node_labels=np.array([0, 1, 1]), edges=np.array([[0, 1], [1, 2]]))
    got = loaders.LOADERS["heterophilous"](spark, str(tmp_path), "mine")
    assert got["edges"].count() == 4 and {r["node"]: r["y"] for r in got["nodes"].collect()} == {0: 0, 1: 1, 2: 1}
    put("hypergraph.pickle", pickle.dumps({"p": [0, 1], "q": [1]}))
    put("features.pickle", pickle.dumps(np.ones((3, 2))))
    put("labels.pickle", pickle.dumps([0, 1, 1]))
    got = loaders.LOADERS["citation_hypergraph"](spark, str(tmp_path))
    assert sorted((r["he"], r["node"]) for r in got["members"].collect()) == [(0, 0), (0, 1), (1, 1), (4, 2)]
    put("hypergraph.pickle", pickle.dumps(print))
    with pytest.raises(Exception, match="not plain data"):
        loaders.LOADERS["citation_hypergraph"](spark, str(tmp_path))["members"].count()
    put("raw/cone/train/1.off", "OFF\n2 0 0\n0 0 1\n1 2 3\n")
    put("raw/ball/test/2.off", "OFF\n1 0 0\n5 5 5\n")
    got = loaders.LOADERS["geometric_shapes"](spark, str(tmp_path))
    assert sorted((r["y"], r["split"]) for r in got["graphs"].collect()) == [(0, "test"), (1, "train")] and got["clouds"].count() == 3
    put("2_manifolds.json", json.dumps([{"name": "S", "triangulation": [[1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]]}]))
    got = loaders.LOADERS["mantra"](spark, str(tmp_path))
    assert got["graphs"].first()["y"] == 0 and got["features"].count() == 14
    for name, text in {"num-node-list": "2\n1\n", "num-edge-list": "1\n0\n", "node-feat": "1,2\n3,4\n5,6\n", "edge": "0,1\n", "graph-label": "1\n0\n", "split/train": "0\n", "split/valid": "1\n", "split/test": "\n"}.items():
        put(f"ogb/{name}.csv", text)
    got = loaders.LOADERS["ogbg"](spark, str(tmp_path / "ogb"))
    assert {r["graph_id"]: (r["y"], r["split"]) for r in got["graphs"].collect()} == {0: (1.0, "train"), 1: (0.0, "valid")}
    assert sorted((r["src"], r["dst"]) for r in got["edges"].collect()) == [(0, 1), (1, 0)]
    with pytest.raises(ValueError, match="no such dataset"):
        loaders.Dataset("nothing", "").load(spark)


@pytest.fixture(scope="module")
def lifted(graph):
    cells = cx.clique_lifting(graph["nodes"], graph["edges"], 3).cache()
    x = {r: cells.where(F.col("rank") == r).select(F.col("key").alias("cell"), F.array(F.aggregate("key", F.lit(0).cast("long"), lambda s, v: s + v).cast("double"), F.lit(1.0)).alias("x")).cache() for r in range(4)}
    return cells, x


def dense(m, rows, cols):
    out = np.zeros((len(rows), len(cols)))
    for r in m.collect():
        out[rows.index(tuple(r["row"])), cols.index(tuple(r["col"]))] = r["val"]
    return out


def table(x):
    got = {tuple(r["cell"]): r["x"] for r in x.collect()}
    return sorted(got), np.array([got[k] for k in sorted(got)])


def test_layers_match_matrices(lifted):
    cells, x = lifted
    keys, m = {}, {}
    for r in x:
        keys[r], m[r] = table(x[r])
    up, down = cx.off_diagonal(cx.up_laplacian(cells, 1)), cx.off_diagonal(cx.down_laplacian(cells, 1))
    w = np.array([[0.5, -1.0], [2.0, 0.25]])
    a = dense(up, keys[1], keys[1])
    root = np.diag([1 / math.sqrt(v) if v else 0.0 for v in a.sum(1)])
    b = dense(down, keys[1], keys[1])
    low = np.diag([1 / math.sqrt(v) if v else 0.0 for v in b.sum(1)])
    want = np.maximum(m[1] @ w.T + root @ a @ root @ m[1] @ w.T + low @ b @ low @ m[1], 0)
    assert np.allclose(table(ms.cell_layer(x[1], up, down, w.tolist(), w.tolist(), np.eye(2).tolist()))[1], want)
    laplacian = dense(cx.down_laplacian(cells, 1), keys[1], keys[1])
    want = m[1] @ w.T + laplacian @ m[1] @ w.T + laplacian @ laplacian @ m[1]
    got = ms.chebyshev_layer(x[1], [cx.down_laplacian(cells, 1)], [[w.tolist(), w.tolist(), np.eye(2).tolist()]])
    assert np.allclose(table(got)[1], want)
    b1, b2 = dense(cx.incidence(cells, 1), keys[0], keys[1]), dense(cx.incidence(cells, 2), keys[1], keys[2])
    got = ms.neighbourhood_layer(x, cells, {"up_incidence-0": np.eye(2).tolist(), "down_incidence-2": w.tolist()})
    assert np.allclose(table(got[1])[1], np.maximum(b1.T @ m[0] + b2 @ m[2] @ w.T, 0))
    assert got[0] is x[0] and got[3] is x[3]
    down_one = ms.signal_down(x, {1: cx.incidence(cells, 1)}, {1: w.tolist()}, {1: [[1.0, 0, 0, 0], [0, 0, 0, 1.0]]})
    sent = b1 @ m[1] @ w.T
    normal = (sent - sent.mean(1, keepdims=True)) / np.sqrt(sent.var(1, keepdims=True) + 1e-5)
    assert np.allclose(table(down_one[0])[1], np.stack([normal[:, 0], m[0][:, 1]], 1))
    out = ms.simplicial_layer(x, {}, {1: cx.incidence(cells, 1), 2: cx.incidence(cells, 2)}, {1: {"low": [np.eye(2).tolist()], "high": [w.tolist()]}})
    assert np.allclose(table(out[1])[1], np.maximum(b1.T @ m[0] + b2 @ m[2] @ w.T, 0))
    ids, links = ms.hasse_graph(cells, ["up_adjacency-0", "down_incidence-1"])
    assert sorted(r["id"] for r in ids.collect()) == list(range(28)) and links.count() == 52


def test_sheaf_laplacians(spark, graph):
    both = gr.symmetric(graph["edges"]).cache()
    for kind, n in (("diag", 2), ("bundle", 1), ("general", 4)):
        maps = both.withColumn("p", F.array(*(F.sin(F.col("src") * 3 + F.col("dst") + i) + 1.5 for i in range(n))))
        big = np.zeros((16, 16))
        for r in ms.sheaf_laplacian(both, maps, kind, 2, False).collect():
            big[2 * r["row"] : 2 * r["row"] + 2, 2 * r["col"] : 2 * r["col"] + 2] = np.reshape(r["block"], (2, 2))
        assert np.allclose(big, big.T) and np.linalg.eigvalsh(big).min() > -1e-9, kind
    for how in ("cayley", "exp"):
        q = ms.orthogonal(np.array([0.3, -0.7, 1.1]), 3, how)
        assert np.allclose(q @ q.T, np.eye(3))
    constant = both.withColumn("p", F.array(F.lit(1.0), F.lit(1.0)))
    x = graph["nodes"].select(F.col("node").alias("cell"), F.array(F.lit(2.0), F.lit(3.0)).alias("x"))
    assert {tuple(r["x"]) for r in ms.sheaf_step(ms.sheaf_laplacian(both, constant, "diag", 2, False), x, 2).collect()} == {(2.0, 3.0)}
    with pytest.raises(Exception, match="without its reverse"):
        ms.reverse_edges(graph["edges"].withColumn("id", F.monotonically_increasing_id())).collect()


def test_encoders_and_read_outs(spark):
    x = spark.createDataFrame([(0, 1, [1.0, 2.0]), (0, 2, [3.0, 6.0]), (1, 3, [5.0, 5.0])], "graph_id long, cell long, x array<double>")
    eye = [[1.0, 0.0], [0.0, 1.0]]
    got = {r["cell"]: r["x"] for r in ms.encoded(x, eye).collect()}
    assert got[1] == [0.0, 0.0] and got[2] == pytest.approx([1.0, 1.0], abs=1e-4) and got[3] == [0.0, 0.0]
    assert {r["graph_id"]: r["x"] for r in ms.flattened(x).collect()} == {0: [1.0, 2.0, 3.0, 6.0], 1: [5.0, 5.0]}
    assert {r["graph_id"]: r["x"] for r in ms.read_out(x, eye, [1.0, 0.0], "mean").collect()} == {0: [3.0, 4.0], 1: [6.0, 5.0]}
    assert ms.forward(x, eye, lambda z: z, eye).count() == 2 and ms.read_out(x, eye, how=None).count() == 3
    assert {r["row"]: r["col"] for r in ms.latent_graph(x.withColumn("graph_id", F.lit(0)), 2).where("row <> col").collect()} == {1: 2, 2: 3, 3: 2}
    ball = spark.createDataFrame([(0, 1, [0.0, 0.0]), (0, 2, [0.5, 0.0])], "graph_id long, cell long, x array<double>")
    assert ms.hyperbolic_distances(ball).where("row < col").first()["d"] == pytest.approx(2 * math.atanh(0.5))
    assert set(ms.all_cells_encoded({0: x, 1: x}, {0: eye})) == {0, 1}


def test_evaluator(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)]
    batch = lambda r: spark.createDataFrame(r, "y long, pred long")
    one, two = ev.Evaluator("classification", 3), ev.Evaluator("classification", 3)
    one.update(batch(rows))
    two.update(batch(rows[:2]))
    two.update(batch(rows[2:]))
    whole = ev.classification_metrics(batch(rows)).first().asDict()
    assert one.compute() == two.compute() and all(one.compute()[k] == pytest.approx(v) for k, v in whole.items())
    regression = ev.Evaluator("regression")
    regression.update(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, pred double"))
    assert regression.compute() == pytest.approx({"mae": 0.5, "mse": 0.5, "rmse": 0.5**0.5, "r2": 0.5})
    many = ev.Evaluator("multilabel")
    many.update(spark.createDataFrame([([1, 0], [1, 1]), ([0, None], [0, 1])], "y array<int>, pred array<int>"))
    assert many.compute()["accuracy"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        ev.Evaluator("classification", 1)


def test_splits(spark):
    made = ev.seeded_splits(10, 0.5)
    order = np.random.RandomState(42).permutation(10).tolist()
    assert len(made) == 10 and made[0] == {"train": order[:5], "valid": order[5:7], "test": order[7:]}
    graphs = spark.range(3).withColumnRenamed("id", "graph_id")
    splits = ev.fixed_split({"train": graphs.where("graph_id < 2"), "test": graphs.where("graph_id = 2")})
    assert {(r["graph_id"], r["split"]) for r in ev.split_graphs(graphs, splits).collect()} == {(0, "train"), (1, "train"), (2, "test")}
    with pytest.raises(Exception, match="without a split"):
        ev.split_graphs(graphs, splits.where("graph_id > 0")).collect()
    masks = spark.createDataFrame([(0, True, False, False), (1, False, False, True)], "graph_id long, train boolean, valid boolean, test boolean")
    assert {r["graph_id"]: r["split"] for r in ev.saved_splits(graphs, "graph_id", masks).collect()} == {0: "train", 1: "test", 2: None}
    batches = ev.shuffled_batches(spark.range(10).withColumnRenamed("id", "graph_id"), 4, 1)
    assert sorted(r["count"] for r in batches.groupBy("batch").count().collect()) == [2, 4, 4]
    times = spark.createDataFrame([("train", i, float(i)) for i in range(14)] + [("test", 0, 2.0)], "stage string, i int, seconds double")
    assert {r["stage"]: (r["n"], r["mean"]) for r in ev.timings(times).collect()} == {"train": (4, 11.5), "test": (1, 2.0)}
    history = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 1.0)], "epoch int, loss double")
    assert ev.best_epoch(history, "loss").first()["epoch"] == 1 and ev.best_epoch(history, "loss", "max").first()["epoch"] == 0
