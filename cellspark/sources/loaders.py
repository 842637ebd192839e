"""Datasets by name from local or shared folders: each loader gives relations by name, read by Spark."""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import fixed_split
from ..operators.graph import dense_ids, hashed, symmetric
from ..operators.hypergraph import with_singletons
from . import fixtures, readers

Relations = dict[str, DataFrame]
LOADERS: dict[str, Callable[..., Relations]] = {}


def loader(name: str) -> Callable[[Callable[..., Relations]], Callable[..., Relations]]:
    """Makes a loader known by name; a later one of the same name takes its place."""

    def add(f: Callable[..., Relations]) -> Callable[..., Relations]:
        LOADERS[name] = f
        return f

    return add


@dataclass
class Dataset:
    """What every loader gives: its relations, and the folder they came from."""

    name: str
    folder: str
    parameters: dict[str, Any] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> tuple[Relations, str]:
        """ValueError for a name that no loader has."""
        if self.name not in LOADERS:
            raise ValueError(f"no such dataset: {self.name}")
        return LOADERS[self.name](spark, self.folder, **self.parameters), self.folder


def text_fields(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(f array of trimmed fields) of the lines that have any."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.transform(F.split("value", separator), lambda v: F.trim(v)).alias("f"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines, numbered 1, 2, .., that hold something; one task reads the file, a record a line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    return lines.select((F.col("at") + 1).cast("long").alias("line"), F.trim("value").alias("value")).where("value <> ''")


@loader("manual_graph")
def manual(spark: SparkSession, folder: str) -> Relations:
    nodes, edges = fixtures.manual_graph(spark)
    return {"nodes": nodes, "edges": edges}


@loader("citation_text")
def citations(spark: SparkSession, folder: str, name: str = "cora") -> Relations:
    """A citation graph of `<name>.content` (id, features, label) and `<name>.cites` (id, id), separated by blanks; labels
    are numbered in their order, links go both ways, links to unknown papers go."""
    rows = spark.read.text(f"{folder}/{name}.content").select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") > 2)
    rows = rows.select(F.get("f", F.lit(0)).alias("name"), F.slice("f", 2, F.size("f") - 2).cast("array<double>").alias("x"), F.element_at("f", -1).alias("label"))
    return named_graph(rows, spark.read.text(f"{folder}/{name}.cites").select(F.split(F.trim("value"), r"\s+").alias("f")))


def named_graph(rows: DataFrame, pairs: DataFrame) -> Relations:
    """Nodes numbered by their names' hashes in order, from rows (name, x, label) and pairs (f: two names)."""
    named = rows.withColumn("h", hashed("name"))
    ids = named.join(dense_ids(named, "h", "node"), "h")
    labels = dense_ids(rows.select(hashed("label").alias("h")).distinct(), "h", "y")
    nodes = ids.withColumn("h", hashed("label")).join(labels, "h").select("node", "x", "y", "name")
    ends = pairs.select(F.get("f", F.lit(0)).alias("a"), F.get("f", F.lit(1)).alias("b"))
    known = nodes.select("name", "node")
    edges = ends.join(known.toDF("a", "src"), "a").join(known.toDF("b", "dst"), "b").where("src <> dst").select("src", "dst")
    return {"nodes": nodes.drop("name"), "edges": symmetric(edges)}


@loader("tu")
def tu(spark: SparkSession, folder: str, name: str = "MUTAG", use_node_attr: bool = False) -> Relations:
    """Many small graphs of `<name>_A.txt` (pairs of nodes from 1 on), `_graph_indicator.txt`, `_graph_labels.txt`, and
    `_node_labels.txt` (one-hot x) or, if asked, `_node_attributes.txt`. Graph labels are numbered from 0 in order."""
    base = f"{folder}/{name}"
    graph = numbered_lines(spark, f"{base}_graph_indicator.txt").select(F.col("line").alias("node"), (F.col("value").cast("long") - 1).alias("graph_id"))
    pairs = text_fields(spark, f"{base}_A.txt").select(F.get("f", F.lit(0)).cast("long").alias("src"), F.get("f", F.lit(1)).cast("long").alias("dst"))
    raw = numbered_lines(spark, f"{base}_graph_labels.txt").select((F.col("line") - 1).alias("graph_id"), F.col("value").cast("long").alias("label"))
    kinds = {r["label"]: i for i, r in enumerate(sorted(raw.select("label").distinct().collect(), key=lambda r: r["label"]))}  # a row a class
    y = F.lit(None).cast("long")
    for label, i in kinds.items():
        y = F.when(F.col("label") == label, F.lit(i)).otherwise(y)
    if use_node_attr:
        x = numbered_lines(spark, f"{base}_node_attributes.txt").select(F.col("line").alias("node"), F.split("value", r"\s*,\s*").cast("array<double>").alias("x"))
    else:
        marks = numbered_lines(spark, f"{base}_node_labels.txt").select(F.col("line").alias("node"), F.split("value", ",")[0].cast("long").alias("k"))
        ends = marks.agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        hot = F.transform(F.sequence(F.col("lo"), F.col("hi")), lambda i: F.when(i == F.col("k"), 1.0).otherwise(0.0))
        x = marks.crossJoin(F.broadcast(ends)).select("node", hot.alias("x"))  # one row
    edges = pairs.join(graph.toDF("src", "graph_id"), "src").select("graph_id", "src", "dst").distinct()
    return {"nodes": graph.join(x, "node").select("graph_id", "node", "x"), "edges": edges, "graphs": raw.select("graph_id", y.alias("y"))}


def arrays_of(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Arrays of a NumPy archive as (at, x array of doubles); a file is one task, as its format asks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    for name in names:
                        a = np.asarray(held[name], float)
                        a = a.reshape(len(a), -1)
                        yield pd.DataFrame({"name": name, "at": np.arange(len(a)), "x": list(a)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "name string, at long, x array<double>")
    return {n: rows.where(F.col("name") == n).select("at", "x") for n in names}


@loader("heterophilous")
def heterophilous(spark: SparkSession, folder: str, name: str = "minesweeper") -> Relations:
    """A graph of `<name>.npz` with node_features, node_labels and edges; links go both ways."""
    parts = arrays_of(spark, f"{folder}/{name}.npz", ["node_features", "node_labels", "edges"])
    y = parts["node_labels"].select("at", F.get("x", F.lit(0)).cast("long").alias("y"))
    nodes = parts["node_features"].join(y, "at").select(F.col("at").alias("node"), "x", "y")
    edges = parts["edges"].select(F.get("x", F.lit(0)).cast("long").alias("src"), F.get("x", F.lit(1)).cast("long").alias("dst"))
    return {"nodes": nodes, "edges": symmetric(edges)}


@loader("molecules")
def molecules(spark: SparkSession, folder: str) -> Relations:
    """Graphs in Parquet folders train, valid and test with tables nodes (graph_id, node, x), edges (graph_id, src, dst)
    and graphs (graph_id, y); one relation each, with the split that the folder names."""
    parts = ("train", "valid", "test")
    return {t: fixed_split({p: spark.read.parquet(f"{folder}/{p}/{t}.parquet") for p in parts}) for t in ("nodes", "edges", "graphs")}


@loader("ogbg")
def ogbg(spark: SparkSession, folder: str) -> Relations:
    """Graphs of raw CSV files: num-node-list, num-edge-list, edge, node-feat, graph-label, and split/<name>.csv, plain or
    gzipped. Nodes and edges belong to graphs by running sums of the lists; x becomes numbers."""

    def lines(name: str) -> DataFrame:
        return numbered_lines(spark, f"{folder}/{name}.csv*").select((F.col("line") - 1).alias("at"), F.split("value", ",").cast("array<double>").alias("x"))

    def owners(name: str, n: str) -> DataFrame:
        from ..operators.simplicial import with_starts

        sizes = lines(name).select(F.col("at").alias("graph_id"), F.get("x", F.lit(0)).cast("long").alias(n))
        return with_starts(sizes, "graph_id", n)

    nodes_of, edges_of = owners("num-node-list", "n"), owners("num-edge-list", "m")
    spans = nodes_of.where("n > 0").select("graph_id", "start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
    nodes = lines("node-feat").join(spans, "at").select("graph_id", F.col("at").alias("node"), "x")
    links = edges_of.where("m > 0").select("graph_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("at"))
    base = nodes_of.select("graph_id", F.col("start").alias("first"))
    edges = lines("edge").join(links, "at").join(base, "graph_id").select("graph_id", (F.get("x", F.lit(0)).cast("long") + F.col("first")).alias("src"), (F.get("x", F.lit(1)).cast("long") + F.col("first")).alias("dst"))
    graphs = lines("graph-label").select(F.col("at").alias("graph_id"), F.get("x", F.lit(0)).alias("y"))
    splits = {p: numbered_lines(spark, f"{folder}/split/{p}.csv*").select(F.col("value").cast("long").alias("graph_id")) for p in ("train", "valid", "test")}
    return {"nodes": nodes, "edges": symmetric(edges, "graph_id").select("graph_id", "src", "dst"), "graphs": graphs.join(fixed_split(splits), "graph_id")}


@loader("us_county_demos")
def county_demos(spark: SparkSession, folder: str, year: int = 2012, task_variable: str = "Election") -> Relations:
    stats = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(f"{folder}/county_stats_{year}.csv")
    links = spark.read.option("header", True).csv(f"{folder}/county_graph.csv")
    nodes, edges = readers.counties(stats, links, task_variable)
    return {"nodes": nodes, "edges": edges}


@loader("mantra")
def mantra(spark: SparkSession, folder: str, manifold_dim: int = 2, task_variable: str = "name", most: int | None = None) -> Relations:
    """Triangulations of `<folder>/<dim>_manifolds.json`, gzipped or not, with the label task_variable numbered in the order
    of its values, x of ones for each cell, and at most `most` graphs, those of the least ids."""
    graphs, cells = readers.triangulations(spark, f"{folder}/{manifold_dim}_manifolds.json*", manifold_dim)
    if most is not None:
        graphs = graphs.orderBy("graph_id").limit(most)
        cells = cells.join(graphs.select("graph_id"), "graph_id", "left_semi")
    value = F.col(task_variable)
    values = [r["v"] for r in graphs.select(value.cast("string").alias("v")).distinct().orderBy("v").collect()]  # a row a class
    y = F.lit(None).cast("long")
    for i, v in enumerate(values):
        y = F.when(value.cast("string") == v, F.lit(i)).otherwise(y)
    return {"graphs": graphs.select("graph_id", y.alias("y")), "cells": cells, "features": cells.select("graph_id", "rank", "key", F.array(F.lit(1.0)).alias("x"))}


class PlainUnpickler(pickle.Unpickler):
    """Containers, numbers and NumPy arrays only."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] in ("numpy", "collections") and name in ("_reconstruct", "ndarray", "dtype", "scalar", "defaultdict", "OrderedDict", "_frombuffer"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not plain data")


@loader("citation_hypergraph")
def citation_hypergraph(spark: SparkSession, folder: str) -> Relations:
    """A hypergraph of pickles: hypergraph.pickle (hyperedge to nodes), features.pickle (a matrix) and labels.pickle (a
    list). A file is one task; each node without a hyperedge gets one of its own."""

    def rows(kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    held = PlainUnpickler(io.BytesIO(content)).load()
                    if kind == "members":
                        yield pd.DataFrame([(i, int(v)) for i, nodes in enumerate(held.values()) for v in nodes], columns=["he", "node"])
                    elif kind == "x":
                        x = np.asarray(held, float)
                        yield pd.DataFrame({"node": np.arange(len(x)), "x": list(x)})
                    else:
                        yield pd.DataFrame({"node": np.arange(len(held)), "y": np.asarray(held, np.int64).reshape(-1)})

        return read

    def table(name: str, kind: str, schema: str) -> DataFrame:
        return spark.read.format("binaryFile").load(f"{folder}/{name}.pickle").select("content").mapInPandas(rows(kind), schema)

    nodes = table("features", "x", "node long, x array<double>").join(table("labels", "y", "node long, y long"), "node")
    members = table("hypergraph", "members", "he long, node long").distinct()
    return {"nodes": nodes, "members": with_singletons(members, nodes)}


@loader("hypergraph")
def content_hypergraph(spark: SparkSession, folder: str, name: str = "zoo") -> Relations:
    nodes, members = readers.hypergraph_content(spark, f"{folder}/{name}.content", f"{folder}/{name}.edges")
    return {"nodes": nodes, "members": members}


@loader("geometric_shapes")
def geometric_shapes(spark: SparkSession, folder: str) -> Relations:
    """Point clouds of OFF files in raw/<shape>/<train or test>/<n>.off: clouds (graph_id, node, x) and graphs (graph_id, y,
    split), shapes numbered in order of their names."""
    files = spark.read.text(f"{folder}/raw/*/*/*.off", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split("path", "/")
    files = files.select("value", F.element_at(parts, -3).alias("shape"), F.element_at(parts, -2).alias("split"), F.xxhash64("path").alias("graph_id"))
    shapes = [r["shape"] for r in files.select("shape").distinct().orderBy("shape").collect()]  # a row a shape
    y = F.array_position(F.array(*map(F.lit, shapes)), F.col("shape")) - 1 if shapes else F.lit(None).cast("long")
    lines = F.filter(F.split("value", r"\r?\n"), lambda v: F.trim(v) != "")
    counts = F.split(F.trim(F.get(lines, F.lit(1))), r"\s+")
    points = F.slice(lines, F.lit(3), F.get(counts, F.lit(0)).cast("int"))
    clouds = files.select("graph_id", F.posexplode(points).alias("node", "line"))
    clouds = clouds.select("graph_id", F.col("node").cast("long").alias("node"), F.split(F.trim("line"), r"\s+").cast("array<double>").alias("x"))
    return {"clouds": clouds, "graphs": files.select("graph_id", y.alias("y"), "split")}
