"""Graphs, hypergraphs and point clouds derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The market segments of the customer table.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypergraph: a hyperedge per order, its parts as members."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("he"), F.col("l_partkey").alias("node"))
    return items.repartition("he").distinct()  # dealt by the hyperedge at once, as joins over it ask


def pairs(members: DataFrame) -> DataFrame:
    """(src < dst), once for each hyperedge that holds both."""
    a, b = members.toDF("he", "src"), members.toDF("he", "dst")
    return a.join(b, "he").where("src < dst").select("src", "dst")


def bought_together(members: DataFrame, least: int = 1) -> DataFrame:
    """Edges src < dst between nodes that share at least `least` hyperedges; w counts them."""
    return pairs(members).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= least)


def sparse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that at least two orders hold together."""
    return bought_together(baskets(spark, sf_dir), 2)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as nodes (node, x, y, size)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"), F.col("p_type").alias("y"), F.col("p_size").alias("size"))


def dense_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that any order holds together; w counts the orders."""
    return bought_together(baskets(spark, sf_dir))


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A connected graph of few nodes: nations, and market segments numbered from 100 on, joined by customers; w counts
    them."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("src"), "c_mktsegment")
    names = F.array(*(F.lit(s) for s in SEGMENTS))
    edges = rows.groupBy("src", (F.array_position(names, F.col("c_mktsegment")) + 99).alias("dst")).agg(F.count(F.lit(1)).alias("w"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes, edges


def customer_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many graphs: (graph_id, node, x), the parts that each customer bought."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("he"), F.col("o_custkey").alias("graph_id"))
    nodes = baskets(spark, sf_dir).join(orders, "he").select("graph_id", "node").distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"))
    return nodes.join(parts, "node").select("graph_id", "node", "x")


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, src < dst): the pairs of parts that some order of the customer holds."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("he"), F.col("o_custkey").alias("graph_id"))
    members = baskets(spark, sf_dir).join(orders, "he")
    a, b = members.toDF("he", "src", "graph_id"), members.select("he", F.col("node").alias("dst"))
    return a.join(b, "he").where("src < dst").select("graph_id", "src", "dst").distinct()
