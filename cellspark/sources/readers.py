"""Readers of the dataset formats: triangulation JSON, county tables, and hypergraphs of content and edge files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import dense_ids, symmetric

#: The columns of a county table.
COUNTY = ["FIPS", "DEM", "GOP", "MedianIncome", "MigraRate", "BirthRate", "DeathRate", "BachelorRate", "UnemploymentRate"]


def triangulations(spark: SparkSession, path: str, dim: int = 2) -> tuple[DataFrame, DataFrame]:
    """Manifolds of a JSON array of records: (graphs, cells). Cells (graph_id, rank, key) are all faces of the top
    simplices; graphs keep name, genus, orientability and Betti numbers where the records have them."""
    rows = spark.read.option("multiLine", True).json(path).where(F.size(F.get("triangulation", F.lit(0))) == dim + 1)
    rows = rows.withColumn("graph_id", F.xxhash64(F.to_json(F.struct("triangulation"))))
    tops = rows.select("graph_id", F.explode("triangulation").alias("top")).select("graph_id", F.array_sort("top").alias("top"))
    masks = F.explode(F.sequence(F.lit(1), F.lit((1 << (dim + 1)) - 1))).alias("mask")
    chosen = F.filter("top", lambda _, i: F.shiftright(F.col("mask"), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    cells = tops.select("graph_id", "top", masks).select("graph_id", chosen.alias("key")).distinct()
    kept = [c for c in ("name", "genus", "orientable", "n_vertices", "betti_numbers", "torsion_coefficients") if c in rows.columns]
    return rows.select("graph_id", *kept), cells.select("graph_id", (F.size("key") - 1).alias("rank"), "key")


def counties(stats: DataFrame, links: DataFrame, target: str = "Election") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of county tables: decimal commas of incomes become points, what is no number becomes the column's
    mean. Links stay between known counties, counties that occur as a link's source and as one's end; self-loops go;
    counties without a link go, the rest are renumbered 0, 1, .. and links go both ways.

    nodes has node, x (the columns but the target's, the election's last) and y; `Election` is (DEM - GOP) / (DEM + GOP).
    """
    point = "regexp_replace(cast(`MedianIncome` AS string), ',', '.')"
    numbers = stats.select(*(F.expr(f"try_cast({point if c == 'MedianIncome' else f'cast(`{c}` AS string)'} AS double)").alias(c) for c in COUNTY))
    means = numbers.agg(*(F.avg(c).alias(f"mean_{c}") for c in COUNTY[1:]))
    numbers = numbers.where("FIPS IS NOT NULL").crossJoin(F.broadcast(means))  # one row
    numbers = numbers.select(F.col("FIPS").cast("long").alias("fips"), *(F.coalesce(c, f"mean_{c}").alias(c) for c in COUNTY[1:]))
    pairs = links.select(F.col("SRC").cast("long").alias("src"), F.col("DST").cast("long").alias("dst"))
    for end in ("src", "dst"):
        pairs = pairs.join(numbers.select(F.col("fips").alias(end)), end, "left_semi")
    kept = numbers.select("fips")
    for end in ("src", "dst"):
        kept = kept.join(pairs.select(F.col(end).alias("fips")), "fips", "left_semi")
    both = symmetric(pairs.where("src <> dst"))
    for end in ("src", "dst"):
        both = both.join(kept.select(F.col("fips").alias(end)), end, "left_semi")
    both = both.select("src", "dst")
    ids = dense_ids(both.select(F.col("src").alias("fips")), "fips", "node")
    edges = both.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    every = numbers.withColumn("Election", (F.col("DEM") - F.col("GOP")) / (F.col("DEM") + F.col("GOP")))
    used = [c for c in [*COUNTY[3:], "Election"] if c != target]
    return every.join(ids, "fips").select("node", F.array(*used).alias("x"), F.col(target).alias("y")), edges


def hypergraph_content(spark: SparkSession, content: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of a content file (id, features, label) and an edge file (node, hyperedge), both separated by
    blanks; labels begin at 0, and each node without a hyperedge gets one of its own."""
    from ..operators.hypergraph import with_singletons

    def fields(path: str) -> DataFrame:
        return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") > 1)

    rows = fields(content).select(F.get("f", F.lit(0)).cast("long").alias("node"), F.slice("f", 2, F.size("f") - 2).cast("array<double>").alias("x"), F.element_at("f", -1).cast("long").alias("label"))
    least = rows.agg(F.min("label").alias("least"))
    nodes = rows.crossJoin(F.broadcast(least)).select("node", "x", (F.col("label") - F.col("least")).alias("y"))  # one row
    members = fields(edges).select(F.get("f", F.lit(0)).cast("long").alias("node"), F.get("f", F.lit(1)).cast("long").alias("he")).distinct()
    return nodes, with_singletons(members.join(nodes, "node", "left_semi"), nodes)


def drive_file_id(url: str) -> str:
    """The file's id in a link of the form `?id=...` or `/file/d/.../`."""
    from urllib.parse import parse_qs, urlparse

    parts = urlparse(url)
    if ids := parse_qs(parts.query).get("id"):
        return ids[0]
    steps = parts.path.split("/")
    if "d" in steps[:-1] and "file" in steps:
        return steps[steps.index("d") + 1]
    raise ValueError(f"no file id in {url}")
