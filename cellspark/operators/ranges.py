"""Cliques and common neighbours of graphs with whole numbers as ids, without a row for each path of two edges.

Ids are cut into ranges. A first exchange brings each range its nodes' whole neighbour lists, packed. From there a list goes,
packed, to each set of ranges in which its node may be part of a clique, and one task works each set out: it knows the
whole lists of its nodes, and so every triangle that holds two of them. Where neighbours have near ids a list goes to a
few sets; where they haven't, to as many as there are ranges, or half their square for sets of three.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import NONE, NULL, Graph
from .buckets import Part as Three
from .packing import pack, unpack

#: Nodes of a range; edges that a task packs at once; paths of two edges that are tried at once.
NODES, EDGES, PATHS = 20_000, 1_000_000, 1_000_000
PACKED = "task long, data binary"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def range_starts(ids: DataFrame) -> np.ndarray:
    """The first ids of the second and later ranges; ids is a table of one column."""
    name = ids.columns[0]
    n = ids.count()
    cuts = -(-n // NODES)
    if cuts < 2:
        return np.zeros(0, np.int64)
    at = [i / cuts for i in range(1, cuts)]
    return np.unique(np.array(ids.agg(F.percentile_approx(name, at, 100_000)).first()[0], np.int64))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The packed parts of each task of a partition; a task's own are unpacked by whoever works it out."""
    held: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for task, data in zip(batch.column("task").to_pylist(), batch.column("data").to_pylist(), strict=True):
            held[task].append(data)
    while held:
        yield held.popitem()


def as_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["task", "data"])


def dealt(df: DataFrame) -> DataFrame:
    """df with the rows of a task together; so many partitions as the session says, as few bytes may be much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task")


class Part:
    """What one set of ranges knows: ids of all nodes seen, ascending; which of them have their whole list here (own), and
    their value and degree; edges (lo, hi), lo < hi, as places in ids, in ascending order of codes lo * n + hi."""

    def __init__(self, ranges: tuple[int, ...], starts: np.ndarray, data: list[bytes], whole: bool):
        keys, sizes, near, bits = (np.concatenate(c) for c in zip(*map(unpack, data), strict=True))
        order = np.argsort(keys, kind="stable")
        first = np.cumsum(sizes) - sizes
        ids = np.unique(np.concatenate([keys, near])) if whole else keys[order]
        self.ids, n = ids, len(ids)
        at = np.searchsorted(ids, keys)
        self.own, self.degree, self.value = np.zeros(n, bool), np.zeros(n, np.int64), np.full(n, NONE, np.int64)
        self.own[at], self.degree[at], self.value[at] = True, sizes, bits
        a, b = np.repeat(at, sizes), np.minimum(np.searchsorted(ids, near), max(n - 1, 0))
        if not whole:
            seen = ids[b] == near
            a, b = a[seen], b[seen]
        self.codes = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
        self.lo, self.hi = self.codes // max(n, 1), self.codes % max(n, 1)
        self.bits = max(10, (8 * len(self.codes)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.spot(self.codes)] = True
        # Each range of the set has a weight, so that a sum tells whether nodes are of just these ranges.
        kinds = sorted(set(ranges))
        place = np.searchsorted(starts, ids, "right")
        self.weight = np.full(n, 1000, np.int64)
        for i, r in enumerate(kinds):
            self.weight[place == r] = 4**i
        self.weight[~self.own] = 1000
        self.total = sum(4 ** kinds.index(r) for r in ranges)

    def values(self, *nodes: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        """Of rows of nodes: which have a row of values for each, and these values."""
        bits = [self.value[x] for x in nodes]
        there = np.flatnonzero(np.logical_and.reduce([x != NONE for x in bits]))
        return there, [pa.array(x[there].view(np.float64), mask=x[there] == NULL) for x in bits]

    def spot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)

    def edge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the edge between two nodes, -1 where there is none."""
        codes = np.minimum(a, b) * len(self.ids) + np.maximum(a, b)
        out = np.full(len(codes), -1, np.int64)
        some = np.flatnonzero(self.table[self.spot(codes)])
        at = np.searchsorted(self.codes, codes[some])
        at[at == len(self.codes)] = 0
        hit = self.codes[at] == codes[some]
        out[some[hit]] = at[hit]
        return out

    def triangles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places (a, b, c), a < b < c, of all triangles of the known edges. Paths start at the end of less degree."""
        n = len(self.ids)
        degree = np.bincount(self.lo, minlength=n) + np.bincount(self.hi, minlength=n)
        turn = degree[self.lo] > degree[self.hi]
        start, end = np.where(turn, self.hi, self.lo), np.where(turn, self.lo, self.hi)
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        last = np.cumsum(np.bincount(start, minlength=n))
        after = last[start] - np.arange(len(start)) - 1
        total = np.cumsum(after)
        p = 0
        while p < len(start):
            q = max(p + 1, int(np.searchsorted(total, (total[p - 1] if p else 0) + PATHS, "right")))
            count = after[p:q]
            left = np.repeat(np.arange(p, q), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            x, y = end[left], end[right]
            closed = np.flatnonzero(self.edge_of(x, y) >= 0)
            if len(closed):
                three = np.sort(np.stack([start[left[closed]], x[closed], y[closed]]), axis=0)
                yield three[0], three[1], three[2]
            p = q

    def ours(self, *nodes: np.ndarray) -> np.ndarray:
        """Whether the nodes are of the set's ranges, one for each."""
        return sum(self.weight[x] for x in nodes) == self.total

    def all_triangles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = list(self.triangles())
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))

    def common(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all triangles: how many each edge has, and, for those of ours, pairs (triangle, node) that make four
        nodes of which every two are joined."""
        sides = np.stack([self.edge_of(a, b), self.edge_of(a, c), self.edge_of(b, c)])
        third = np.stack([c, b, a])
        on = np.bincount(sides.reshape(-1), minlength=len(self.codes))
        order = np.argsort(sides.reshape(-1), kind="stable")
        others, first = third.reshape(-1)[order], np.cumsum(on) - on
        mine = np.flatnonzero(self.ours(a, b, c))
        tri, node = [], []
        for at in range(0, len(mine), 200_000):
            own = mine[at : at + 200_000]
            side = on[sides[:, own]].argmin(0)
            edge, apex = sides[side, own], third[side, own]
            count = on[edge]
            t = np.repeat(own, count)
            f = others[np.repeat(first[edge] - (np.cumsum(count) - count), count) + np.arange(len(t))]
            top = np.repeat(apex, count)
            good = f != top
            t, f, top = t[good], f[good], top[good]
            good = self.edge_of(f, top) >= 0
            tri.append(t[good])
            node.append(f[good])
        return on, np.concatenate(tri) if tri else np.zeros(0, np.int64), np.concatenate(node) if node else np.zeros(0, np.int64)


def gathered(edges: DataFrame, ids: DataFrame, size: int, run: Callable[[Part], Iterator[list[pa.Array]]], schema: str, whole: bool = True, values: DataFrame | None = None) -> DataFrame:
    """What `run` makes of each set of `size` ranges in which edges may join nodes of every two. Edges (src, dst) count
    once in either direction, loops and nulls don't; ids is a table of one column, the nodes or any ids like theirs, by
    which ranges are cut; values is (node, value), a number or null. Without `whole` a list holds but the
    nodes of the set's ranges that are there."""
    starts = range_starts(ids)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    b = len(starts) + 1

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            src, dst = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            keep = src != dst
            src, dst = src[keep], dst[keep]
            x, y = np.concatenate([src, dst]), np.concatenate([dst, src])
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            place = np.searchsorted(starts, x, "right")
            cut = np.flatnonzero(np.diff(place)) + 1
            return as_batch([(int(place[i]), b"e" + pack(np.diff(x[i:j], prepend=0), y[i:j])) for i, j in zip([0, *cut], [*cut, len(x)], strict=True) if i < j])

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("src", "dst")])
            n += batch.num_rows
            if n >= EDGES:
                yield rows()
                n = 0
        if n:
            yield rows()

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, v = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
            bits = np.where(batch.column("value").is_null().to_numpy(zero_copy_only=False), NULL, v.view(np.int64))
            place = np.searchsorted(starts, x, "right")
            yield as_batch([(int(r), b"v" + pack(x[place == r], bits[place == r])) for r in np.unique(place)])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data in grouped(batches):
            pairs = [unpack(d[1:]) for d in data if d[:1] == b"e"]
            if not pairs:
                continue
            x, y = np.concatenate([np.cumsum(p[0]) for p in pairs]), np.concatenate([p[1] for p in pairs])
            del pairs
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.ones(len(x), bool)
            new[1:] = (np.diff(x) != 0) | (np.diff(y) != 0)
            x, y = x[new], y[new]
            keys, first, sizes = np.unique(x, return_index=True, return_counts=True)
            value = np.full(len(keys), NONE, np.int64)
            for d in data:
                if d[:1] == b"v":
                    named, bits = unpack(d[1:])
                    at = np.minimum(np.searchsorted(keys, named), len(keys) - 1)
                    hit = keys[at] == named
                    value[at[hit]] = bits[hit]
            place = np.searchsorted(starts, y, "right")
            owner = np.repeat(np.arange(len(keys)), sizes)
            met = {}
            for r in np.unique(place).tolist():
                met[r] = np.zeros(len(keys), bool)
                met[r][owner[place == r]] = True
            out, weight = [], 0
            for rest in combinations_with_replacement(sorted(met), size - 1):
                mask = np.logical_and.reduce([met[r] for r in rest]) if rest else np.ones(len(keys), bool)
                if not mask.any():
                    continue
                sent_to = mask[owner] if whole else mask[owner] & np.isin(place, [own, *rest])
                count = np.bincount(owner[sent_to], minlength=len(keys))[mask]
                task = 0
                for r in sorted((own, *rest)):
                    task = task * b + r
                out.append((task, pack(keys[mask], count, y[sent_to], value[mask])))
                weight += len(out[-1][1])
                if weight > 4_000_000:
                    yield as_batch(out)
                    out, weight = [], 0
            if out:
                yield as_batch(out)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, data in grouped(batches):
            ranges = tuple(task // b**i % b for i in range(size - 1, -1, -1))
            for columns in run(Part(ranges, starts, data, whole)):
                for i in range(0, len(columns[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 100_000) for c in columns], names)

    packed = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").mapInArrow(sent, PACKED)
    if values is not None:
        packed = packed.union(values.toDF("node", "value").where("node IS NOT NULL").mapInArrow(valued, PACKED))
    return dealt(dealt(packed).mapInArrow(lists, PACKED)).mapInArrow(worked, schema)


def keys_of(*columns: np.ndarray) -> pa.Array:
    """Arrays of as many ids as there are columns."""
    n = len(columns[0])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(columns)), pa.array(np.stack(columns, axis=1).reshape(-1)))


def graph_of(edges: DataFrame | Graph, ids: DataFrame) -> Graph:
    return edges if isinstance(edges, Graph) else Graph(edges, ids, NODES)


def cliques(edges: DataFrame | Graph, ids: DataFrame, size: int) -> DataFrame:
    """(key): all sets of `size` nodes, three or four, of which every two are joined."""

    def three(part: Three) -> Iterator[list[pa.Array]]:
        for abc in part.all_triangles():
            yield [keys_of(*(part.ids[x] for x in abc))]

    def four(a: np.ndarray, b: np.ndarray, link: Three) -> Iterator[list[pa.Array]]:
        key = link.directed()
        key.sort()
        for three in link.triangles(key):
            three = three[:3]
            yield [keys_of(a[three[0]], *np.sort(np.stack([b[v] for v in three]), axis=0))]

    graph = graph_of(edges, ids)
    return graph.worked(three, "key array<long>") if size == 3 else graph.linked(four, "key array<long>", False)


def maximal_triangles(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(key): the triangles whose three nodes have no common neighbour."""

    def run(a: np.ndarray, b: np.ndarray, link: Three) -> Iterator[list[pa.Array]]:
        first, second = b[link.lo], b[link.hi]
        first, second = np.minimum(first, second), np.maximum(first, second)
        alone = np.flatnonzero((link.on() == 0) & (a[link.lo] < first))
        yield [keys_of(a[link.lo[alone]], first[alone], second[alone])]

    return graph_of(edges, ids).linked(run, "key array<long>", True)


def triangle_sums(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, x) of all triangles: values of nodes (node, x) summed over the ends of edges, and these over the sides of
    triangles, so each node's twice. A triangle with a node that has no row has none; null x gives null."""

    def run(part: Three) -> Iterator[list[pa.Array]]:
        value = part.values()
        for abc in part.all_triangles():
            bits = [value[v] for v in abc]
            there = np.flatnonzero(np.logical_and.reduce([x != NONE for x in bits]))
            x = [pa.array(b[there].view(np.float64), mask=b[there] == NULL) for b in bits]
            yield [keys_of(*(part.ids[v[there]] for v in abc)), pc.multiply(pc.add(pc.add(x[0], x[1]), x[2]), 2.0)]

    return graph_of(edges, nodes.select("node")).worked(run, "cell array<long>, x double", nodes.select("node", "x"))


def edge_values(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, first, second) of all edges: the ends' x, of the lesser node first. An edge with an end that has no row in
    nodes (node, x) has none."""

    def run(part: Part) -> Iterator[list[pa.Array]]:
        mine = part.ours(part.lo, part.hi)
        ends = part.lo[mine], part.hi[mine]
        there, x = part.values(*ends)
        yield [keys_of(*(part.ids[v[there]] for v in ends)), *x]

    return gathered(edges, nodes.select("node"), 2, run, "cell array<long>, first double, second double", False, nodes.select("node", "x"))


def closed_paths(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, degree, t): the neighbours and the triangles of each node that has an edge."""
    made = graph_of(edges, ids).on_nodes(lambda on, _, __: (np.ones_like(on), on), ["degree", "twice"], False)
    return made.select("node", "degree", F.expr("twice div 2").alias("t"))


def curvature(edges: DataFrame | Graph, ids: DataFrame, rank: int) -> DataFrame:
    """(key, curvature) of rank 0, 1 or 2 of the clique complex, as simplicial_curvature has them; nodes without an edge
    have no row."""

    def bent(on: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        return 4 - dx - dy + 3 * on

    def two(a: np.ndarray, b: np.ndarray, link: Three) -> Iterator[list[pa.Array]]:
        first, second = b[link.lo], b[link.hi]
        first, second = np.minimum(first, second), np.maximum(first, second)
        own = np.flatnonzero(a[link.lo] < first)
        value = 3.0 + 4 * link.on() - (link.more - 3)
        yield [keys_of(a[link.lo[own]], first[own], second[own]), pa.array(value[own])]

    graph = graph_of(edges, ids)
    if rank == 2:
        return graph.linked(two, "key array<long>, curvature double", True, graph.with_counts())
    if rank == 0:
        made = graph.on_nodes(lambda *x: (bent(*x),), ["curvature"], True)
        return made.select(F.array("node").alias("key"), F.col("curvature").cast("double").alias("curvature"))
    n, buckets = graph.n, graph.buckets

    def one(block: int, x: np.ndarray, y: np.ndarray, *of: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = (buckets.named(f, v) for f, v in zip(divmod(block, n), (x, y), strict=True))
        value = bent(*of).astype(np.float64)
        for i in range(0, len(a), 100_000):
            j = i + 100_000
            yield pa.RecordBatch.from_arrays([keys_of(np.minimum(a, b)[i:j], np.maximum(a, b)[i:j]), pa.array(value[i:j])], ["key", "curvature"])

    return graph.on_blocks(one, "key array<long>, curvature double", True)
