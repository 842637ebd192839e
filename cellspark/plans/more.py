"""Registered queries of the liftings, message passing, losses and batching, and SQL to hold them against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
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
from . import graphs as gs
from .queries import BASKETS, BOTH, CLOUD, DENSE, SAID, SPARSE, TRI, brand, cells, cloud, dense, once, query, said, shown, sparse, sparse_cells
from .storage import written

NEAR = f"{BOTH}, n AS (SELECT node AS center, node FROM v UNION SELECT src, dst FROM s)"
TRIPLES = "SELECT DISTINCT a.node || '-' || b.node || '-' || c.node AS cell FROM {0} a JOIN {0} b ON a.center = b.center AND a.node < b.node JOIN {0} c ON c.center = a.center AND b.node < c.node"
SEGMENTS = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {100 + i}" for i, s in enumerate(gs.SEGMENTS)) + " END"
TRADE = f"e AS (SELECT c_nationkey::BIGINT AS src, ({SEGMENTS})::BIGINT AS dst, count(*) AS w FROM customer GROUP BY 1, 2), v AS (SELECT DISTINCT src AS node FROM e UNION SELECT dst FROM e)"
MANY = f"{BASKETS}, o AS (SELECT he, node, o_custkey AS graph_id FROM m JOIN orders ON o_orderkey = he), ge AS (SELECT DISTINCT a.graph_id, a.node AS src, b.node AS dst FROM o a JOIN o b ON a.he = b.he AND a.node < b.node), gv AS (SELECT DISTINCT graph_id, node FROM o)"
TETRA = "k AS (SELECT a, b, c, z.dst AS f FROM t JOIN e x ON x.src = a JOIN e y ON y.src = b AND y.dst = x.dst JOIN e z ON z.src = c AND z.dst = x.dst)"


def rank_keys(c: DataFrame, rank: int) -> DataFrame:
    return c.where(F.col("rank") == rank).select(cx.text("key").alias("cell"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- liftings to simplicial complexes


@query("khop_triples", f"WITH {SPARSE}, {NEAR} {TRIPLES.format('n')}")
def khop_triples(spark, d):
    return rank_keys(si.khop_complex(*sparse(spark, d), 2), 2)


@query("khop_pairs", f"WITH {SPARSE}, {NEAR} SELECT DISTINCT a.node || '-' || b.node AS cell FROM n a JOIN n b ON a.center = b.center AND a.node < b.node")
def khop_pairs(spark, d):
    """The closure of subsets of closed neighbourhoods: pairs of nodes with a neighbour in common, and edges."""
    return rank_keys(si.khop_complex(*sparse(spark, d), 2), 1)


@query(
    "khop_capped",
    f"WITH {SPARSE}, {NEAR}, q AS (SELECT a.center, a.node AS x, b.node AS y, c.node AS z FROM n a JOIN n b ON a.center = b.center AND a.node < b.node JOIN n c ON c.center = a.center AND b.node < c.node), r AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY x, y, z) AS place FROM q) SELECT DISTINCT x || '-' || y || '-' || z AS cell FROM r WHERE place <= 6",
)
def khop_capped(spark, d):
    return rank_keys(si.khop_complex(*sparse(spark, d), 2, 5), 2)


@query("graph_induced_triples", f"WITH {SPARSE}, {BOTH}, p AS (SELECT list_sort([a.src, a.dst, b.dst]) AS k FROM s a JOIN s b ON a.dst = b.src AND a.src <> b.dst) SELECT DISTINCT array_to_string(k, '-') AS cell FROM p")
def graph_induced_triples(spark, d):
    return rank_keys(si.induced_complex(*sparse(spark, d), 2), 2)


@query(
    "neighborhood_triples",
    f"WITH {SPARSE}, {BOTH}, u AS (SELECT node AS center, node FROM v UNION SELECT a.src, b.dst FROM s a JOIN s b ON a.dst = b.src EXCEPT SELECT src, dst FROM s), q AS (SELECT a.center, a.node AS x, b.node AS y, c.node AS z FROM u a JOIN u b ON a.center = b.center AND a.node < b.node JOIN u c ON c.center = a.center AND b.node < c.node), r AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY x, y, z) AS place FROM q) SELECT DISTINCT x || '-' || y || '-' || z AS cell FROM r WHERE place <= 11",
)
def neighborhood_triples(spark, d):
    return rank_keys(si.neighborhood_cells(*sparse(spark, d), 2, 10), 2)


@query("vietoris_rips_2", f"WITH {SPARSE}, {BOTH}, h AS (SELECT src, dst FROM s UNION SELECT a.src, b.dst FROM s a JOIN s b ON a.dst = b.src WHERE a.src <> b.dst), g AS (SELECT src, dst FROM h WHERE src < dst) SELECT x.src || '-' || x.dst || '-' || y.dst AS cell FROM g x JOIN g y ON x.src = y.src AND x.dst < y.dst JOIN g z ON z.src = x.dst AND z.dst = y.dst")
def vietoris_rips_2(spark, d):
    return rank_keys(si.vietoris_rips(*sparse(spark, d), 2, 2), 2)


@query("eccentricities", f"WITH RECURSIVE {TRADE}, {BOTH}, r AS (SELECT node AS center, node, 0 AS d FROM v UNION SELECT r.center, s.dst, r.d + 1 FROM r JOIN s ON s.src = r.node WHERE r.d < 6), l AS (SELECT center, node, min(d) AS d FROM r GROUP BY 1, 2) SELECT center AS node, max(d) AS eccentricity FROM l GROUP BY 1")
def eccentricities(spark, d):
    return si.eccentricities(*gs.trade(spark, d))


@query("eccentricity_pairs", f"WITH {TRADE} SELECT a.node || '-' || b.node AS cell FROM v a JOIN v b ON a.node < b.node")
def eccentricity_pairs(spark, d):
    return rank_keys(si.eccentricity_complex(*gs.trade(spark, d), 2), 1)


LINE = "i AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS id FROM e)"


@query("line_vertices", f"WITH {SPARSE}, {LINE} SELECT id, src, dst, (p.x + q.x) / 2 AS x FROM i JOIN v p ON p.node = src JOIN v q ON q.node = dst")
def line_vertices(spark, d):
    return si.line_complex(*sparse(spark, d), 2)[0]


@query("line_triples", f"WITH {SPARSE}, {LINE}, h AS (SELECT id, unnest([src, dst]) AS node FROM i), l AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM h a JOIN h b ON a.node = b.node AND a.id < b.id) SELECT x.src || '-' || x.dst || '-' || y.dst AS cell FROM l x JOIN l y ON x.src = y.src AND x.dst < y.dst JOIN l z ON z.src = x.dst AND z.dst = y.dst")
def line_triples(spark, d):
    return rank_keys(si.line_complex(*sparse(spark, d), 2)[1], 2)


CURVED = f"{DENSE}, {TRI}, g AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), te AS (SELECT x AS src, y AS dst, count(*) AS n FROM (SELECT a AS x, b AS y FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) GROUP BY 1, 2), k1 AS (SELECT e.src, e.dst, 4.0 - p.k - q.k + 3 * coalesce(te.n, 0) AS c FROM e JOIN g p ON p.node = e.src JOIN g q ON q.node = e.dst LEFT JOIN te ON te.src = e.src AND te.dst = e.dst)"


@query("simplicial_curvature_1", f"WITH {CURVED} SELECT src || '-' || dst AS cell, c::DOUBLE AS curvature FROM k1")
def simplicial_curvature_1(spark, d):
    return si.clique_curvature(*once(spark, d), [1])[1].select(cx.text("key").alias("cell"), "curvature")


@query("simplicial_curvature_0", f"WITH {CURVED}, z AS (SELECT node, sum(c) AS c FROM (SELECT src AS node, c FROM k1 UNION ALL SELECT dst, c FROM k1) GROUP BY 1) SELECT v.node::VARCHAR AS cell, coalesce(c, 0)::DOUBLE AS curvature FROM v LEFT JOIN z ON z.node = v.node")
def simplicial_curvature_0(spark, d):
    return si.clique_curvature(*once(spark, d), [0])[0].select(cx.text("key").alias("cell"), "curvature")


@query(
    "simplicial_curvature_2",
    f"WITH {CURVED}, {TETRA}, kt AS (SELECT x, y, z, count(*) AS n FROM (SELECT a AS x, b AS y, c AS z FROM k UNION ALL SELECT a, b, f FROM k UNION ALL SELECT a, c, f FROM k UNION ALL SELECT b, c, f FROM k) GROUP BY 1, 2, 3) SELECT a || '-' || b || '-' || c AS cell, (3.0 + coalesce(kt.n, 0) - (p.n - 1 + q.n - 1 + r.n - 1 - 3 * coalesce(kt.n, 0)))::DOUBLE AS curvature FROM t JOIN te p ON p.src = a AND p.dst = b JOIN te q ON q.src = a AND q.dst = c JOIN te r ON r.src = b AND r.dst = c LEFT JOIN kt ON kt.x = a AND kt.y = b AND kt.z = c",
)
def simplicial_curvature_2(spark, d):
    return si.clique_curvature(*once(spark, d), [2])[2].select(cx.text("key").alias("cell"), "curvature")


@query("connectivity_counts", f"WITH {SPARSE}, {TRI}, {BOTH} SELECT 'incidence_1' AS name, (SELECT 2 * count(*) FROM e) AS n UNION ALL SELECT 'incidence_2', (SELECT 3 * count(*) FROM t) UNION ALL SELECT 'adjacency_0', (SELECT count(*) FROM s)")
def connectivity_counts(spark, d):
    """Entries of operators that the finisher makes for every rank."""
    made = si.connectivity(sparse_cells(spark, d), 2)
    names = ("incidence_1", "incidence_2", "adjacency_0")
    return reduce(DataFrame.union, (made[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names))


@query("redefined_adjacency", f"WITH {SPARSE}, {BOTH} SELECT src::VARCHAR AS r, dst::VARCHAR AS c, 1.0::DOUBLE AS val FROM s")
def redefined_adjacency(spark, d):
    nodes, edges = sparse(spark, d)
    both = gr.symmetric(edges).toDF("row", "col")
    return shown(si.redefined(nodes, both, 2, ["up_adjacency-0"])[1]["up_adjacency-0"])


# ---- combinatorial complexes and configurations


SETS = f"{BASKETS}, k AS (SELECT he, list_sort(list(node)) AS key FROM m GROUP BY 1), u AS (SELECT key, min(he) AS he, len(key) AS n FROM k GROUP BY 1, 3), w AS (SELECT he, n, unnest(key) AS node FROM u), ins AS (SELECT a.he AS small, b.he AS large FROM w a JOIN w b ON a.node = b.node AND a.n < b.n GROUP BY a.he, b.he, a.n HAVING count(*) = a.n)"


@query("containment_ranks", f"WITH RECURSIVE {SETS}, r AS (SELECT he, CASE WHEN n = 1 THEN 0 ELSE 1 END AS rank FROM u UNION SELECT ins.large, r.rank + 1 FROM r JOIN ins ON ins.small = r.he) SELECT he, max(rank)::INT AS rank FROM r GROUP BY 1")
def containment_ranks(spark, d):
    return hy.containment_rank(gs.baskets(spark, d))


@query("universal_strict_cells", f"WITH RECURSIVE {SETS}, r AS (SELECT he, CASE WHEN n = 1 THEN 0 ELSE 1 END AS rank FROM u UNION SELECT ins.large, r.rank + 1 FROM r JOIN ins ON ins.small = r.he), q AS (SELECT he, max(rank)::INT AS rank FROM r GROUP BY 1) SELECT rank, array_to_string(key, '-') AS cell FROM q JOIN u USING (he) UNION SELECT 0, node::VARCHAR FROM m")
def universal_strict_cells(spark, d):
    return co.universal_strict(gs.baskets(spark, d)).select("rank", cx.text("key").alias("cell"))


@query(
    "triangle_induced_cells",
    f"WITH RECURSIVE {SPARSE}, {TRI}, {TETRA}, i AS (SELECT a, b, c FROM k UNION SELECT a, b, f FROM k UNION SELECT a, c, f FROM k UNION SELECT b, c, f FROM k), mt AS (SELECT *, row_number() OVER (ORDER BY a, b, c) AS id FROM (SELECT * FROM t EXCEPT SELECT * FROM i)), x AS (SELECT id, unnest([a, b, c]) AS node FROM mt), p AS (SELECT a.id AS i, b.id AS j, count(*) AS n FROM x a JOIN x b ON a.node = b.node AND a.id <> b.id GROUP BY 1, 2), l AS (SELECT 1 AS kind, i, j FROM p WHERE n = 1 UNION ALL SELECT 2, i, j FROM p WHERE n = 2 UNION ALL SELECT 3, i, j FROM p), r AS (SELECT kind, i AS id, i AS seen FROM l UNION SELECT r.kind, r.id, l.j FROM r JOIN l ON l.kind = r.kind AND l.i = r.seen), g AS (SELECT kind, id, min(seen) AS comp FROM r GROUP BY 1, 2) SELECT DISTINCT CASE WHEN kind = 3 THEN 3 ELSE 2 END AS rank, cell FROM (SELECT kind, comp, string_agg(DISTINCT node::VARCHAR, '-' ORDER BY node::VARCHAR) AS cell FROM g JOIN x USING (id) GROUP BY 1, 2)",
)
def triangle_induced_cells(spark, d):
    made = co.triangle_induced(*sparse(spark, d)).where("rank >= 2")
    return made.select("rank", F.array_join(F.array_sort(F.col("key").cast("array<string>")), "-").alias("cell"))


@query("configurations_2", f"WITH {TRADE} SELECT 0 AS rank, a.node || '|' || b.node AS cell FROM v a JOIN v b ON a.node <> b.node UNION ALL SELECT 1, src || '~' || dst || '|' || node FROM e JOIN v ON node NOT IN (src, dst) UNION ALL SELECT 1, node || '|' || src || '~' || dst FROM e JOIN v ON node NOT IN (src, dst) UNION ALL SELECT 2, a.src || '~' || a.dst || '|' || b.src || '~' || b.dst FROM e a JOIN e b ON a.src <> b.src AND a.dst <> b.dst")
def configurations_2(spark, d):
    nodes, edges = gs.trade(spark, d)
    return co.configurations(nodes, edges.select("src", "dst"), 2).select("rank", F.array_join("key", "|").alias("cell"))


@query("containment_incidence", f"WITH {SPARSE}, {TRI} SELECT src || '-' || dst AS r, a || '-' || b || '-' || c AS c, 1.0::DOUBLE AS val FROM t JOIN e ON list_contains([a, b, c], src) AND list_contains([a, b, c], dst)")
def containment_incidence(spark, d):
    return shown(co.containment(sparse_cells(spark, d), 1, 2))


# ---- liftings to hypergraphs


@query("knn_hyperedges", f"WITH {CLOUD}, r AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY distance, node) AS rank FROM q) SELECT node AS he, center AS node FROM r WHERE rank <= 2 UNION ALL SELECT node, node FROM c")
def knn_hyperedges(spark, d):
    return li.knn_hyperedges(cloud(spark, d), 3)


@query("modularity_matrix", f"WITH {TRADE}, g AS (SELECT src AS node, count(*) AS k FROM e GROUP BY 1), m AS (SELECT count(*) / 2 AS m FROM e) SELECT a.node AS src, b.node AS dst, round(0 - a.k * b.k / (2 * m), 6)::DOUBLE AS b FROM g a CROSS JOIN g b CROSS JOIN m")
def modularity_matrix(spark, d):
    return rounded(li.modularity_matrix(gs.trade(spark, d)[1]), 6, "b")


@query("forman_hyperedges", f"WITH RECURSIVE {SPARSE}, g AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), f AS (SELECT src, dst, 4 - a.k - b.k AS q FROM e JOIN g a ON a.node = src JOIN g b ON b.node = dst), h AS (SELECT src, dst FROM f WHERE q <= (SELECT quantile_cont(q, 0.6) FROM f)), s AS (SELECT src, dst FROM h UNION SELECT dst, src FROM h), r AS (SELECT node, node AS seen FROM v UNION SELECT r.node, s.dst FROM r JOIN s ON s.src = r.seen), l AS (SELECT node, min(seen) AS comp FROM r GROUP BY 1), z AS (SELECT comp, row_number() OVER (ORDER BY count(*) DESC, comp) - 1 AS he FROM l GROUP BY 1) SELECT he, node FROM l JOIN z USING (comp)")
def forman_hyperedges(spark, d):
    nodes, edges = sparse(spark, d)
    return li.forman_hyperedges(nodes, edges, 0.6, "quantile", "above")


@query(
    "mapper_clusters",
    f"WITH RECURSIVE {SPARSE}, {BOTH}, x AS (SELECT min(x) - 1e-3 AS lo, max(x) + 1e-3 AS hi FROM v), y AS (SELECT lo, (hi - lo) / (10 - 9 * 0.3::DOUBLE) AS w FROM x), iv AS (SELECT i, lo + i * w * (1 - 0.3::DOUBLE) AS a, lo + i * w * (1 - 0.3::DOUBLE) + w AS b FROM y CROSS JOIN (SELECT unnest(range(10)) AS i)), c AS (SELECT node, i FROM v JOIN iv ON x > a - 1e-8 - 1e-5 * abs(a) AND x < b + 1e-8 + 1e-5 * abs(b)), r AS (SELECT i, node, node AS seen FROM c UNION SELECT r.i, r.node, s.dst FROM r JOIN s ON s.src = r.seen JOIN c ON c.i = r.i AND c.node = s.dst) SELECT i AS interval, node, min(seen) AS least FROM r GROUP BY 1, 2",
)
def mapper_clusters(spark, d):
    nodes, edges = sparse(spark, d)
    found = li.mapper_hyperedges(edges.select("src", "dst"), nodes.select("node", F.col("x").alias("value")))
    return found.where("kind = 'cluster'").select(F.col("a").alias("interval"), "node", F.col("b").alias("least"))


@query("expander_degrees", "SELECT p_partkey AS node, 4 AS degree, 2 AS size FROM part")
def expander_degrees(spark, d):
    """What any such graph has: each node in four hyperedges, each of two nodes."""
    made = written(li.expander_hyperedges(gs.parts(spark, d).select("node"), 4), "expander")
    size = made.groupBy("he").agg(F.count_distinct("node").alias("size"))
    return made.join(size, "he").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("size").alias("size"))


FARTHEST = "c AS (SELECT vec_id AS node, embedding::DOUBLE[] AS x FROM embeddings), k AS (SELECT greatest(1, ceil(count(*) * {0})::INT) AS n FROM c), f AS (SELECT 1 AS i, [min(node)] AS ids FROM c UNION ALL SELECT i + 1, list_append(ids, (SELECT node FROM (SELECT z.node, min(list_distance(z.x, y.x)) AS d FROM c z CROSS JOIN c y WHERE list_contains(f.ids, y.node) GROUP BY z.node) ORDER BY d DESC, node LIMIT 1)) FROM f, k WHERE i < k.n), g AS (SELECT unnest(ids) AS s, unnest(range(len(ids))) AS he FROM f, k WHERE i = k.n)"


@query("voronoi", f"WITH RECURSIVE {FARTHEST.format('0.02')}, r AS (SELECT c.node, g.he, row_number() OVER (PARTITION BY c.node ORDER BY list_distance(c.x, y.x), g.he) AS place FROM c CROSS JOIN g JOIN c y ON y.node = g.s) SELECT node, he::INT AS he FROM r WHERE place = 1")
def voronoi(spark, d):
    return pt.voronoi(cloud(spark, d), 0.02)


@query("pointnet", f"WITH RECURSIVE {FARTHEST.format('0.02')}, b AS (SELECT c.node, g.he FROM c CROSS JOIN g JOIN c y ON y.node = g.s WHERE list_distance(c.x, y.x) <= 1.3), l AS (SELECT node, row_number() OVER (ORDER BY node) - 1 + (SELECT n FROM k) AS he FROM c WHERE node NOT IN (SELECT node FROM b)) SELECT he::BIGINT AS he, node FROM b UNION ALL SELECT he::BIGINT, node FROM l")
def pointnet(spark, d):
    return li.pointnet_hyperedges(cloud(spark, d), 0.02, 1.3)


@query("radius_balls", f"WITH {CLOUD} SELECT center AS he, node FROM q WHERE distance <= 1.25 UNION ALL SELECT node, node FROM c")
def radius_balls(spark, d):
    return li.radius_balls(cloud(spark, d), 1.25)


# ---- many graphs


def many(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return written(gs.customer_graphs(spark, d), "many"), written(gs.customer_edges(spark, d), "many-edges")


@query("cycle_counts", f"WITH RECURSIVE {MANY}, gs AS (SELECT graph_id, src, dst FROM ge UNION SELECT graph_id, dst, src FROM ge), r AS (SELECT graph_id, node, node AS seen FROM gv UNION SELECT r.graph_id, r.node, gs.dst FROM r JOIN gs ON gs.graph_id = r.graph_id AND gs.src = r.seen), l AS (SELECT graph_id, node, min(seen) AS comp FROM r GROUP BY 1, 2), c AS (SELECT graph_id, count(*) AS n, count(DISTINCT comp) AS c FROM l GROUP BY 1), mm AS (SELECT graph_id, count(*) AS m FROM ge GROUP BY 1) SELECT graph_id, m - n + c AS cycles FROM c JOIN mm USING (graph_id) WHERE m - n + c > 0")
def cycle_counts(spark, d):
    return sp.cycle_basis(*many(spark, d)).groupBy("graph_id").agg(F.count(F.lit(1)).alias("cycles"))


@query("euler_characteristics", f"WITH {MANY}, gt AS (SELECT x.graph_id, count(*) AS t FROM ge x JOIN ge y ON x.graph_id = y.graph_id AND x.src = y.src AND x.dst < y.dst JOIN ge z ON z.graph_id = x.graph_id AND z.src = x.dst AND z.dst = y.dst GROUP BY 1), n AS (SELECT graph_id, count(*) AS n FROM gv GROUP BY 1), mm AS (SELECT graph_id, count(*) AS m FROM ge GROUP BY 1) SELECT graph_id, n - coalesce(m, 0) + coalesce(t, 0) AS chi FROM n LEFT JOIN mm USING (graph_id) LEFT JOIN gt USING (graph_id)")
def euler_characteristics(spark, d):
    """The alternating sum of Betti numbers of each customer's clique complex up to triangles, which is that of its cells."""
    nodes, edges = many(spark, d)
    x, y, z = edges.toDF("graph_id", "a", "b"), edges.toDF("graph_id", "a", "c"), edges.toDF("graph_id", "b", "c")
    tri = x.join(y, ["graph_id", "a"]).where("b < c").join(z, ["graph_id", "b", "c"]).select("graph_id", F.lit(2).alias("rank"), F.array("a", "b", "c").alias("key"))
    every = nodes.select("graph_id", F.lit(0).alias("rank"), F.array("node").alias("key")).union(edges.select("graph_id", F.lit(1), F.array("src", "dst"))).union(tri)
    sign = F.when(F.col("rank") % 2 == 0, F.col("betti")).otherwise(-F.col("betti"))
    return li.betti_numbers(every, 2).groupBy("graph_id").agg(F.sum(sign).alias("chi"))


@query("lap_pe_norms", f"WITH {MANY}, z AS (SELECT graph_id, count(*) AS n FROM gv GROUP BY 1) SELECT graph_id, n FROM z")
def lap_pe_norms(spark, d):
    """A row for each node of each graph; encodings of 4 eigenvectors."""
    made = sp.lap_pe(*many(spark, d), 4)
    return made.where(F.size("x") == 4).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


@query("kernel_hyperedges")
def kernel_hyperedges(spark, d):
    return li.kernel_members(*many(spark, d)).select("graph_id", cx.text("key").alias("cell"))


@query("communities")
def communities(spark, d):
    return li.communities(*many(spark, d), 2)


@query("graph_norm", f"WITH {MANY}, x AS (SELECT graph_id, node, p_retailprice AS x FROM gv JOIN part ON p_partkey = node) SELECT graph_id, node AS cell, round((x - avg(x) OVER g) / sqrt(var_pop(x) OVER g + 1e-5), 6) AS x FROM x WINDOW g AS (PARTITION BY graph_id)")
def graph_norm(spark, d):
    x = gs.customer_graphs(spark, d).select("graph_id", F.col("node").alias("cell"), F.array("x").alias("x"))
    return ms.graph_norm(x).select("graph_id", "cell", F.round(F.get("x", F.lit(0)), 6).alias("x"))


@query("collated_edges", f"WITH {MANY}, z AS (SELECT graph_id, count(*) AS n FROM gv GROUP BY 1), b AS (SELECT graph_id, n, (row_number() OVER (ORDER BY graph_id) - 1) // 16 AS batch FROM z), oo AS (SELECT graph_id, batch, coalesce(sum(n) OVER (PARTITION BY batch ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b), i AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS at FROM gv) SELECT batch, (p.at + start)::BIGINT AS row, (q.at + start)::BIGINT AS col, 1.0::DOUBLE AS val FROM ge JOIN oo USING (graph_id) JOIN i p ON p.graph_id = ge.graph_id AND p.node = src JOIN i q ON q.graph_id = ge.graph_id AND q.node = dst")
def collated_edges(spark, d):
    from pyspark.sql import Window

    nodes, edges = many(spark, d)
    at = nodes.select("graph_id", "node", (F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1).alias("at"))
    local = edges.join(at.toDF("graph_id", "src", "row"), ["graph_id", "src"]).join(at.toDF("graph_id", "dst", "col"), ["graph_id", "dst"])
    offsets = ev.batch_offsets(nodes, 16)
    return ev.collated(local.select("graph_id", "row", "col", F.lit(1.0).alias("val")), offsets, offsets).select("batch", F.col("row").cast("long"), F.col("col").cast("long"), "val")


@query("batch_membership", f"WITH {MANY}, z AS (SELECT graph_id, count(*) AS n FROM gv GROUP BY 1), b AS (SELECT graph_id, n, row_number() OVER (ORDER BY graph_id) - 1 AS i FROM z), oo AS (SELECT *, i // 16 AS batch, coalesce(sum(n) OVER (PARTITION BY i // 16 ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b) SELECT batch, unnest(range(start::BIGINT, (start + n)::BIGINT)) AS cell, (i % 16)::INT AS graph FROM oo")
def batch_membership(spark, d):
    return ev.batch_membership(ev.batch_offsets(gs.customer_graphs(spark, d), 16))


@query("cell_statistics", f"WITH {MANY}, n AS (SELECT graph_id, count(*) AS n0 FROM gv GROUP BY 1), mm AS (SELECT graph_id, count(*) AS n1 FROM ge GROUP BY 1) SELECT graph_id, n0, coalesce(n1, 0) AS n1 FROM n LEFT JOIN mm USING (graph_id)")
def cell_statistics(spark, d):
    nodes, edges = many(spark, d)
    return ev.cell_statistics(nodes.select("graph_id", F.lit(0).alias("rank")).union(edges.select("graph_id", F.lit(1))), 1)


@query("flat_encoder", f"WITH {MANY}, x AS (SELECT graph_id, node, p_retailprice AS x FROM gv JOIN part ON p_partkey = node) SELECT graph_id, string_agg(round(x, 2)::VARCHAR, ',' ORDER BY node) AS x FROM x GROUP BY 1")
def flat_encoder(spark, d):
    x = gs.customer_graphs(spark, d).select("graph_id", F.col("node").alias("cell"), F.array(F.round("x", 2)).alias("x"))
    return ms.flattened(x).select("graph_id", F.array_join(F.col("x").cast("array<string>"), ",").alias("x"))


# ---- message passing


def priced(spark: SparkSession, d: str) -> DataFrame:
    return gs.parts(spark, d).select(F.array("node").alias("cell"), F.array(F.col("x"), F.lit(1.0)).alias("x"))


def pair_shown(x: DataFrame, digits: int = 4) -> DataFrame:
    return x.select(cx.text("cell").alias("cell"), F.round(F.get("x", F.lit(0)), digits).alias("x0"), F.round(F.get("x", F.lit(1)), digits).alias("x1"))


@query("spread_up_laplacian", f"WITH {SPARSE}, g AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), {BOTH} SELECT s.src::VARCHAR AS cell, round(any_value(g.k) * any_value(p.x) + sum(q.x), 4) AS x0, round((any_value(g.k) + count(*))::DOUBLE, 4) AS x1 FROM s JOIN v p ON p.node = s.src JOIN v q ON q.node = s.dst JOIN g ON g.node = s.src GROUP BY 1")
def spread_up_laplacian(spark, d):
    """The unsigned Laplacian of the nodes times their prices, and times ones."""
    return pair_shown(ms.spread(cx.up_laplacian(sparse_cells(spark, d), 0), priced(spark, d)))


@query("scn_normalised", f"WITH {SPARSE}, {BOTH}, g AS (SELECT src AS node, count(*) AS k FROM s GROUP BY 1) SELECT src::VARCHAR AS r, dst::VARCHAR AS c, round(1 / sqrt(a.k * b.k), 8)::DOUBLE AS val FROM s JOIN g a ON a.node = src JOIN g b ON b.node = dst")
def scn_normalised(spark, d):
    made = ms.scn_normalised(cx.neighborhood(sparse_cells(spark, d), "up_adjacency-0"))
    return rounded(shown(made), 8, "val")


@query("chebyshev_powers", f"WITH {SPARSE}, {BOTH}, a1 AS (SELECT src AS node, sum(x) AS x FROM s JOIN v ON v.node = s.dst GROUP BY 1), a2 AS (SELECT src AS node, sum(x) AS x FROM s JOIN a1 ON a1.node = s.dst GROUP BY 1) SELECT v.node::VARCHAR AS cell, round(v.x + 2 * coalesce(a1.x, 0) + 0.5 * coalesce(a2.x, 0), 4) AS x FROM v LEFT JOIN a1 ON a1.node = v.node LEFT JOIN a2 ON a2.node = v.node")
def chebyshev_powers(spark, d):
    x = gs.parts(spark, d).select(F.array("node").alias("cell"), F.array("x").alias("x"))
    a = cx.neighborhood(sparse_cells(spark, d), "up_adjacency-0")
    return ms.chebyshev_layer(x, [a], [[[[1.0]], [[2.0]], [[0.5]]]]).select(cx.text("cell").alias("cell"), F.round(F.get("x", F.lit(0)), 4).alias("x"))


@query("hyperedge_layer", f"WITH {BASKETS}, h AS (SELECT he, avg(p_retailprice) AS x FROM m JOIN part ON p_partkey = node GROUP BY 1) SELECT p_partkey AS cell, round(0.5 * coalesce(avg(h.x) + 2 * any_value(p_retailprice) * (count(m.he) > 0)::INT, 0) + 0.5 * any_value(p_retailprice), 2) AS x FROM part LEFT JOIN m ON m.node = p_partkey LEFT JOIN h ON h.he = m.he GROUP BY 1")
def hyperedge_layer(spark, d):
    x = gs.parts(spark, d).select(F.col("node").alias("cell"), F.array("x").alias("x"))
    made = ms.hyperedge_layer(gs.baskets(spark, d), x, x, [[1.0]], [[2.0, 1.0]], [[1.0]])
    return made.select("cell", F.round(F.get("x", F.lit(0)), 2).alias("x"))


@query("mean_degree_scatter", f"WITH {BASKETS}, h AS (SELECT he, avg(p_retailprice) AS x FROM m JOIN part ON p_partkey = node GROUP BY 1) SELECT node AS cell, round(sum(x) * ln(1 + count(*)), 2) AS x FROM m JOIN h USING (he) GROUP BY 1")
def mean_degree_scatter(spark, d):
    x = gs.parts(spark, d).select(F.col("node").alias("cell"), F.array("x").alias("x"))
    return ms.mean_degree_scatter(gs.baskets(spark, d), x).select("cell", F.round(F.get("x", F.lit(0)), 2).alias("x"))


@query("neighbourhood_layer", f"WITH {SPARSE}, {BOTH}, a AS (SELECT src AS node, sum(x) AS y FROM s JOIN v ON v.node = s.dst GROUP BY 1), i AS (SELECT f.node, sum(p.x + q.x) AS y FROM (SELECT src AS node, src, dst FROM e UNION ALL SELECT dst, src, dst FROM e) f JOIN v p ON p.node = f.src JOIN v q ON q.node = f.dst GROUP BY 1) SELECT v.node::VARCHAR AS cell, round(coalesce(a.y, 0) + 0.5 * coalesce(i.y, 0), 4) AS x FROM v LEFT JOIN a ON a.node = v.node LEFT JOIN i ON i.node = v.node")
def neighbourhood_layer(spark, d):
    """Nodes get their neighbours' prices and half of what their edges hold, the sums of both ends."""
    c = sparse_cells(spark, d)
    x0 = gs.parts(spark, d).select(F.array("node").alias("cell"), F.array("x").alias("x"))
    x1 = ms.spread(cx.transposed(cx.incidence(c, 1)), x0)
    made = ms.neighbourhood_layer({0: x0, 1: x1}, c, {"up_adjacency-0": [[1.0]], "down_incidence-1": [[0.5]]})
    return made[0].select(cx.text("cell").alias("cell"), F.round(F.get("x", F.lit(0)), 4).alias("x"))


@query("cell_layer", f"WITH {SPARSE}, {TRI}, x AS (SELECT src, dst, p.x + q.x AS x FROM e JOIN v p ON p.node = src JOIN v q ON q.node = dst), h AS (SELECT src, dst, unnest([src, dst]) AS node FROM e), dn AS (SELECT DISTINCT a.src AS a, a.dst AS b, b.src AS c, b.dst AS d FROM h a JOIN h b ON a.node = b.node AND (a.src, a.dst) <> (b.src, b.dst)), k AS (SELECT a, b, count(*) AS k FROM dn GROUP BY 1, 2), g AS (SELECT dn.a, dn.b, sum(x.x / sqrt(p.k * q.k)) AS y FROM dn JOIN x ON x.src = dn.c AND x.dst = dn.d JOIN k p ON p.a = dn.a AND p.b = dn.b JOIN k q ON q.a = dn.c AND q.b = dn.d GROUP BY 1, 2), f AS (SELECT unnest([a || '-' || b, a || '-' || c, b || '-' || c]) AS cell, a || '-' || b || '-' || c AS t FROM t), un AS (SELECT DISTINCT i.cell AS r, j.cell AS c FROM f i JOIN f j ON i.t = j.t AND i.cell <> j.cell), uk AS (SELECT r, count(*) AS k FROM un GROUP BY 1), ug AS (SELECT un.r, sum(x.x / sqrt(p.k * q.k)) AS y FROM un JOIN x ON x.src || '-' || x.dst = un.c JOIN uk p ON p.r = un.r JOIN uk q ON q.r = un.c GROUP BY 1) SELECT x.src || '-' || x.dst AS cell, round(x.x + coalesce(g.y, 0) + coalesce(ug.y, 0), 3) AS x FROM x LEFT JOIN g ON g.a = x.src AND g.b = x.dst LEFT JOIN ug ON ug.r = x.src || '-' || x.dst")
def cell_layer(spark, d):
    c = sparse_cells(spark, d)
    x0 = gs.parts(spark, d).select(F.array("node").alias("cell"), F.array("x").alias("x"))
    x1 = ms.spread(cx.transposed(cx.incidence(c, 1)), x0)
    one = [[1.0]]
    made = ms.cell_layer(x1, cx.neighborhood(c, "up_adjacency-1"), cx.neighborhood(c, "down_adjacency-1"), one, one, one)
    return made.select(cx.text("cell").alias("cell"), F.round(F.get("x", F.lit(0)), 3).alias("x"))


@query("reverse_edges", f"WITH {SPARSE}, {BOTH}, i AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS id FROM s) SELECT a.src, a.dst, b.src AS rsrc, b.dst AS rdst FROM i a JOIN i b ON a.src = b.dst AND a.dst = b.src")
def reverse_edges(spark, d):
    both = written(gr.symmetric(sparse(spark, d)[1]).withColumn("id", F.monotonically_increasing_id()), "directed")
    made = ms.reverse_edges(both)
    return made.join(both.toDF("rsrc", "rdst", "right"), "right").select("src", "dst", "rsrc", "rdst")


@query("sheaf_laplacian", f"WITH {SPARSE}, {BOTH}, f AS (SELECT s.src, s.dst, p.x / 1000 AS p, q.x / 1000 AS q FROM s JOIN v p ON p.node = s.src JOIN v q ON q.node = s.dst) SELECT src AS row, dst AS col, round(-p * q, 8) AS a, -1.0::DOUBLE AS b FROM f UNION ALL SELECT src, src, round(sum(p * p), 8), count(*)::DOUBLE FROM f GROUP BY src")
def sheaf_laplacian(spark, d):
    nodes, edges = sparse(spark, d)
    both = gr.symmetric(edges)
    maps = both.join(nodes.select(F.col("node").alias("src"), "x"), "src").select("src", "dst", F.array(F.col("x") / 1000, F.lit(1.0)).alias("p"))
    made = ms.sheaf_laplacian(both, maps, "diag", 2, False)
    return made.select("row", "col", F.round(F.get("block", F.lit(0)), 8).alias("a"), F.get("block", F.lit(3)).alias("b"))


@query("cosine_similarities", "WITH c AS (SELECT vec_id AS node, embedding::DOUBLE[] AS x FROM embeddings) SELECT a.node AS row, b.node AS col, round(list_cosine_similarity(a.x, b.x), 6) AS similarity FROM c a JOIN c b ON a.node <> b.node WHERE list_cosine_similarity(a.x, b.x) > 0.25")
def cosine_similarities(spark, d):
    x = cloud(spark, d).select(F.lit(0).alias("graph_id"), F.col("node").alias("cell"), "x")
    return rounded(ms.cosine_similarities(x, 0.25), 6, "similarity")


@query("latent_graph", "WITH c AS (SELECT vec_id AS node, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT a.node AS row, b.node AS col, list_distance(a.x, b.x) ** 2 AS d FROM c a CROSS JOIN c b), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, col) AS place FROM q) SELECT row, col, round(-0.5 * d, 6) + 0.0 AS logp FROM r WHERE place <= 4")
def latent_graph(spark, d):
    x = cloud(spark, d).select(F.lit(0).alias("graph_id"), F.col("node").alias("cell"), "x")
    return ms.latent_graph(x, 4, 0.5).withColumn("logp", F.round("logp", 6) + F.lit(0.0))


# ---- losses, splits, histories


@query("cross_entropy", f"WITH {SAID} SELECT round(avg(ln(1 + exp(score / 1000)) - CASE WHEN y = 1 THEN score / 1000 ELSE 0 END), 6) AS loss FROM p")
def cross_entropy(spark, d):
    z = said(spark, d).select(F.array(F.lit(0.0), F.col("score") / 1000).alias("z"), "y")
    return rounded(ev.cross_entropy(z), 6, "loss")


@query("masked_bce", "WITH p AS (SELECT doc_id, quality, toxic, n_chars / 1000 AS z FROM documents JOIN labels USING (doc_id)), r AS (SELECT CASE WHEN quality = 1 THEN ln(1 + exp(z)) - z * toxic ELSE (ln(1 + exp(z)) - z * quality + ln(1 + exp(-z)) + z * toxic) / 2 END AS l FROM p) SELECT round(avg(l), 6) AS loss FROM r")
def masked_bce(spark, d):
    """Two labels a document, the first unknown where the document is good."""
    docs, labels = gs.table(spark, d, "documents"), gs.table(spark, d, "labels")
    z = F.col("n_chars") / 1000
    good = F.col("quality") == 1
    rows = docs.join(labels, "doc_id").select(F.array(z, F.when(good, z).otherwise(-z)).alias("z"), F.array(F.when(~good, F.col("quality").cast("double")), F.col("toxic").cast("double")).alias("y"))
    return rounded(ev.masked_bce(rows), 6, "loss")


@query("structure_loss", f"WITH {SAID} SELECT round(avg((0.5 - (pred = y)::INT) * exp(-score / 1000)), 6) AS loss FROM p")
def structure_loss(spark, d):
    rows = said(spark, d).select("y", "pred", F.lit(None).cast("double").alias("accuracy"), F.array(-F.col("score") / 1000).alias("logp"))
    return rounded(ev.structure_loss(rows), 6, "loss")


@query("contrast_loss", f"WITH {SPARSE}, {BOTH}, c AS (SELECT a.src AS row, b.dst AS col, count(*) AS n FROM s a JOIN s b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2), j AS (SELECT c.row, exp(0.5 * n) AS x, CASE WHEN s.src IS NULL THEN 0 ELSE 1 END AS near FROM c LEFT JOIN s ON s.src = c.row AND s.dst = c.col), r AS (SELECT row, sum(x * near) / sum(x) AS p FROM j GROUP BY 1) SELECT round(-avg(ln(p + 1e-8)), 6) AS loss FROM r")
def contrast_loss(spark, d):
    """Similarity as the number of neighbours in common, against adjacency."""
    both = written(gr.symmetric(sparse(spark, d)[1]), "both")
    similar = both.toDF("row", "mid").join(both.toDF("mid", "col"), "mid").where("row <> col").groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("similarity"))
    near = both.toDF("row", "col").withColumn("val", F.lit(1.0))
    return rounded(ev.contrast_loss(similar, near, 0.5), 6, "loss")


@query("total_loss", f"WITH {SAID} SELECT round(avg((pred - y) * (pred - y)) + avg(abs(pred - y)), 6)::DOUBLE AS loss FROM p")
def total_loss(spark, d):
    rows = said(spark, d)
    return rounded(ev.total_loss(ev.regression_loss(rows, "mse"), ev.regression_loss(rows, "mae")), 6, "loss")


@query("example_metric", f"WITH {SAID} SELECT round(avg((pred - y) * (pred - y)), 6)::DOUBLE AS mean_squared_error FROM p")
def example_metric(spark, d):
    return rounded(ev.example_metric(said(spark, d)), 6, "mean_squared_error")


@query("standardised_train", "WITH k AS (SELECT p_partkey AS node, p_retailprice AS x, row_number() OVER (ORDER BY md5(p_partkey || ':42'), p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), s AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM k WHERE i < floor(n * 0.6)) SELECT node, round((x - m) / s, 6) AS x FROM k CROSS JOIN s")
def standardised_train(spark, d):
    nodes = gs.parts(spark, d).select("node", "x")
    split = ev.random_split(nodes, "node", 0.6)
    return ev.standardised(nodes.join(split, "node"), "x").select("node", F.round("x", 6).alias("x"))


@query("random_folds", "WITH k AS (SELECT p_partkey AS node, f AS fold, row_number() OVER (PARTITION BY f ORDER BY md5(p_partkey || ':' || (42000 + f)), p_partkey) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM part CROSS JOIN (SELECT unnest(range(10))::INT AS f)) SELECT node, fold, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + floor(n * 0.4 / 2) THEN 'valid' ELSE 'test' END AS split FROM k")
def random_folds(spark, d):
    return ev.random_folds(gs.parts(spark, d).select("node"), "node", 0.6)


@query("best_epoch", "SELECT l_shipdate::VARCHAR AS day, l_orderkey AS epoch, l_extendedprice AS price FROM lineitem ORDER BY price DESC, epoch LIMIT 1")
def best_epoch(spark, d):
    """The dearest item as the best of a history."""
    items = gs.table(spark, d, "lineitem")
    return ev.best_epoch(items.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day") if dict(items.dtypes)["l_shipdate"] == "date" else F.col("l_shipdate").cast("string").alias("day"), F.col("l_orderkey").alias("epoch"), F.col("l_extendedprice").alias("price")), "price", "max")


@query("auroc_macro", f"WITH {SAID}, n AS (SELECT score, y FROM p), a AS (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS u FROM n a JOIN n b ON a.y = 1 AND b.y = 0) SELECT round(u, 6)::DOUBLE AS auroc FROM a")
def auroc_macro(spark, d):
    """Two classes with opposite scores, whose areas are equal."""
    rows = said(spark, d).select("y", F.array(-F.col("score"), F.col("score")).alias("z"))
    return rounded(ev.auroc_macro(rows, [0, 1]), 6, "auroc")


@query("class_homophily", f"WITH {BASKETS}, l AS (SELECT p_partkey AS node, p_type AS y FROM part), c AS (SELECT he, y, count(*) AS n FROM m JOIN l USING (node) GROUP BY 1, 2), e0 AS (SELECT he, y, n / sum(n) OVER (PARTITION BY he) AS p FROM c), zh AS (SELECT node, count(*) AS c FROM m GROUP BY 1), n0 AS (SELECT node, y, sum(p) / any_value(zh.c) AS p FROM m JOIN e0 USING (he) JOIN zh USING (node) GROUP BY 1, 2), w AS (SELECT he FROM m GROUP BY 1 HAVING count(*) > 1), o AS (SELECT DISTINCT node FROM m JOIN w USING (he)) SELECT 0 AS step, l.y, round(avg(coalesce(n0.p, 0)), 8)::DOUBLE AS p FROM l JOIN o USING (node) LEFT JOIN n0 ON n0.node = l.node AND n0.y = l.y GROUP BY 2")
def class_homophily(spark, d):
    members, labels = gs.baskets(spark, d), brand(spark, d)
    return rounded(ev.class_homophily(hy.message_homophily(members, labels, 1), labels, members), 8, "p")


@query("principal_values")
def principal_values(spark, d):
    return rounded(li.principal_values(cloud(spark, d), True), 6, "value")


@query("mixture_hyperedges")
def mixture_hyperedges(spark, d):
    return li.mixture_hyperedges(cloud(spark, d).withColumn("x", F.slice("x", 1, 4)), 2, 3)


@query("random_flag_cells")
def random_flag_cells(spark, d):
    return rank_keys(li.random_flag(gs.parts(spark, d).select("node"), 1, 0.002, only=1), 1)
