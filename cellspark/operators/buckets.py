"""Triangles of graphs with whole numbers as ids.

Nodes fall into buckets by ranges of ids. Edges are written once, packed, as a block for each two buckets. Buckets form
classes, so many that the edges between any three fit a task; a block goes to the task of each three classes that hold its
two and have edges between every two, and that task finds the triangles with a node in each of the three. So an edge is sent as
often as there are classes at most, which grow with the root of the edges, and once or a few times where neighbours have near
ids. Where ranges would give a task too many edges, as when few ids have most, buckets are those of a hash. Counts on
edges come back to the blocks as packed vectors, those on nodes to their buckets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .packing import as_batch, pack, unpack

#: Edges that a task packs at once; edges of a task of three classes; paths of two edges that are tried at once; places of
#: the table of marks that they are held against.
EDGES, HELD, PATHS, MARKS = 2_000_000, 5_500_000, 100_000, 1 << 24
#: Buckets at most, as blocks grow with their square; classes at most where more of them cost no disk.
BUCKETS, CLASSES = 128, 64
#: Tasks of a bucket's nodes and the triangles at them.
SPLIT = 4
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bits, those of numbers that nothing computes, for a value that is null and for a node that has no value.
NULL, NONE = 0x7FF8DEAD00000001, 0x7FF8DEAD00000002
PARTS = "task long, block long, data binary"


def places(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place) of ids among n buckets: places are as near as ids are, buckets are any."""
    at = ids // n
    shift = ((at.astype(np.uint64) * _SPREAD) >> np.uint64(33)).astype(np.int64)
    return (ids - at * n + shift) % n, at


def named(bucket: int, at: np.ndarray, n: int) -> np.ndarray:
    """The ids at places of a bucket."""
    shift = ((at.astype(np.uint64) * _SPREAD) >> np.uint64(33)).astype(np.int64)
    return at * n + (bucket - shift) % n


class Buckets:
    """n buckets of ids: by ranges that begin at `starts`, ascending, the first one anywhere; by a hash without them."""

    def __init__(self, n: int, starts: np.ndarray | None):
        self.n, self.starts = n, starts

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return places(ids, self.n)
        bucket = np.searchsorted(self.starts[1:], ids, "right")
        return bucket, ids - self.starts[bucket]

    def named(self, bucket: int, at: np.ndarray) -> np.ndarray:
        return named(bucket, at, self.n) if self.starts is None else at + self.starts[bucket]


def range_starts(ids: DataFrame, found: int, n: int) -> np.ndarray:
    """Where n ranges of about as many ids begin; ids is a table of one column with found rows."""
    name = ids.columns[0]
    low, high = ids.agg(F.min(name), F.max(name)).first()
    if low is None:
        return np.zeros(n, np.int64)
    if high - low < 2 * found:
        return np.array([low + (high - low + 1) * i // n for i in range(n)], np.int64)
    cuts = ids.agg(F.percentile_approx(name, [i / n for i in range(1, n)], 100_000)).first()[0] if n > 1 else []
    return np.array([low, *cuts], np.int64)


def classes_of(sizes: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Of c classes of consecutive buckets with about as many ends of edges: each bucket's class, which two have edges, how many
    edges are sent and how many a task gets at most. sizes: edges of blocks (p, q), p <= q."""
    ends = sizes.sum(0) + sizes.sum(1)
    middle = np.cumsum(ends) - ends / 2
    of = np.minimum((middle * c / max(ends.sum(), 1)).astype(np.int64), c - 1)
    between = np.zeros((c, c))
    np.add.at(between, (of[:, None], of[None, :]), sizes)
    between = np.triu(between + between.T, 1) + np.diag(np.diag(between))
    both = between + np.triu(between, 1).T
    met = both > 0
    sent = float((between * (met.astype(np.int64) @ met)).sum())
    most = 0.0
    for i in range(c):
        for j in np.flatnonzero(met[i, i:]) + i:
            k = np.flatnonzero(met[i] & met[j])
            k = k[k >= j]
            if len(k):
                load = both[i, j] + np.where(k != j, both[i, k] if i != j else 0 * both[i, k], 0) + np.where(k != i, both[j, k], 0)
                most = max(most, float(np.max(load)))
    return of, met, sent, most


def ordered(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of columns, ascending."""
    lows = [int(c.min()) if len(c) else 0 for c in columns]
    spans = [int(c.max()) - low + 1 if len(c) else 1 for c, low in zip(columns, lows, strict=True)]
    if np.prod([float(s) for s in spans]) < 2**62:
        code = columns[0] - lows[0]
        for c, low, span in zip(columns[1:], lows[1:], spans[1:], strict=True):
            code = code * span + (c - low)
        code.sort()
        code = code[np.diff(code, prepend=-1) != 0]
        out = []
        for low, span in zip(lows[:0:-1], spans[:0:-1], strict=True):
            code, rest = np.divmod(code, span)
            out.append(rest + low)
        return [code + lows[0], *out[::-1]]
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([np.diff(c) != 0 for c in rows])
    return [c[new] for c in rows]


class Names:
    """Distinct numbers, ascending, and the ranks of numbers among them."""

    def __init__(self, seen: list[np.ndarray]):
        low, span = min(int(s.min()) for s in seen), max(int(s.max()) for s in seen)
        span = span - low + 1
        self.low, self.table = low, None
        if span > 4 * sum(map(len, seen)) + 1_000:
            self.all = np.unique(np.concatenate(seen))
            return
        there = np.zeros(span, bool)
        for s in seen:
            there[s - low] = True
        self.all = np.flatnonzero(there) + low
        self.table = np.cumsum(there, dtype=np.int32) - np.int32(1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.all, x).astype(np.int32) if self.table is None else self.table[x - self.low]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The parts (block, data) of each task of a partition."""
    held: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for batch in batches:
        for task, block, data in zip(*(batch.column(c).to_pylist() for c in ("task", "block", "data")), strict=True):
            held[task].append((block, data))
    while held:
        yield held.popitem()


def dealt(df: DataFrame, tasks: int = 0) -> DataFrame:
    """df with the rows of a task together, in as many partitions as the session says or as there are tasks."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tasks, 2_000)), "task")


def summed(packed: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Places and columns of numbers of a bucket's parts, a place's numbers added up."""
    names = Names([p[0] for p in packed])
    out = [np.zeros(len(names.all), np.int64) for _ in packed[0][1:]]
    for at, *columns in packed:
        rank = names.rank(at)
        for total, c in zip(out, columns, strict=True):
            np.add.at(total, rank, c)
    return [names.all, *out]


class Part:
    """What the task of three classes knows: ids of nodes, in the order of their buckets and so of their classes; edges
    (lo, hi), lo < hi as places in ids, in the order of their blocks."""

    def __init__(self, three: tuple[int, int, int], buckets: Buckets, of: np.ndarray, data: list[tuple[int, bytes]]):
        blobs, seen, n, extra = [], defaultdict(list), buckets.n, []
        self.given: dict[int, list[list[np.ndarray]]] = defaultdict(list)
        for block, d in data:
            if block < 0:  # values of nodes
                self.given[-1 - block].append(unpack(d))
                continue
            x, y, *more = unpack(d)
            extra += more
            p, q = divmod(block, n)
            x = np.cumsum(x)
            blobs.append((block, p, q, x, y))
            seen[p].append(x)
            seen[q].append(y)
        self.names, self.first, count = {}, {}, 0
        for f in sorted(seen):
            self.names[f], self.first[f] = Names(seen[f]), count
            count += len(self.names[f].all)
        seen.clear()
        self.n = count
        self.ids = np.concatenate([buckets.named(f, s.all) for f, s in self.names.items()]) if count else np.zeros(0, np.int64)
        kinds = sorted(set(three))
        self.kinds, self.three = len(kinds), tuple(kinds.index(c) for c in three)
        self.kind = np.concatenate([np.full(len(s.all), kinds.index(of[f]), np.int8) for f, s in self.names.items()]) if count else np.zeros(0, np.int8)
        self.blocks = [(block, len(x)) for block, _, _, x, _ in blobs]
        size = sum(k for _, k in self.blocks)
        self.lo, self.hi = np.empty(size, np.int32), np.empty(size, np.int32)
        at = 0
        while blobs:
            _, p, q, x, y = blobs.pop(0)
            self.lo[at : at + len(x)] = self.names[p].rank(x) + np.int32(self.first[p])
            self.hi[at : at + len(x)] = self.names[q].rank(y) + np.int32(self.first[q])
            at += len(x)
        self.more = np.concatenate(extra) if extra else None

    @classmethod
    def plain(cls, n: int, lo: np.ndarray, hi: np.ndarray) -> Part:
        """A part of one class, of nodes 0 to n - 1."""
        part = cls.__new__(cls)
        part.more = None
        part.n, part.lo, part.hi, part.kind, part.kinds, part.three = n, lo.astype(np.int32), hi.astype(np.int32), np.zeros(n, np.int8), 1, (0, 0, 0)
        return part

    def directed(self) -> np.ndarray:
        """Codes start * n + end of the edges, from the end of less degree, so a hub starts few."""
        n = self.n
        degree = np.bincount(self.lo, minlength=n) + np.bincount(self.hi, minlength=n)
        turn = degree[self.lo] > degree[self.hi]
        return np.where(turn, self.hi, self.lo).astype(np.int64) * n + np.where(turn, self.lo, self.hi)

    def triangles(self, key: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Places (u, x, y) of the triangles with a node in each of the three classes, and those of the edges from u to x, x to y
        and u to y in key, the directed edges, ascending. For rows of a few u, the ends of their edges are marked in a
        table; paths from u over x to y are held against that."""
        n, kinds = self.n, self.kinds
        if not len(key):
            return
        start = (key // n).astype(np.int32)
        end = (key - start.astype(np.int64) * n).astype(np.int32)
        size = np.bincount(start.astype(np.int64) * kinds + self.kind[end], minlength=n * kinds)
        bound = np.cumsum(size) - size
        third = np.full(kinds * kinds, -1, np.int64)
        for i in range(3):
            for j in range(3):
                if i != j:
                    third[self.three[i] * kinds + self.three[j]] = self.three[3 - i - j]
        last = third[self.kind[start].astype(np.int64) * kinds + self.kind[end]]
        at = end.astype(np.int64) * kinds + last
        count = np.where(last >= 0, size[at], 0)
        begin = bound[at]
        del last, at, size, bound
        edge = np.flatnonzero(count)
        count, begin = count[edge], begin[edge]
        total = np.cumsum(count)
        # Rows: starts with a path; all their edges are marked.
        row = start[edge]
        first = np.flatnonzero(np.diff(row, prepend=-1))  # in edge
        rows = row[first]
        left, right = np.searchsorted(start, rows), np.searchsorted(start, rows, "right")  # in key
        low, high = end[left], end[right - 1]
        first = np.append(first, len(edge))
        table, r, some = np.zeros(0, bool), 0, 64
        while r < len(rows):
            some = min(2 * some, len(rows) - r, 1 << 14)
            while True:
                base = int(low[r : r + some].min())
                wide = int(high[r : r + some].max()) - base + 1
                if some == 1 or some * wide <= MARKS:
                    break
                some = max(1, some // 2)
            if len(table) < some * wide:
                table = np.zeros(max(some * wide, min(MARKS, 2 * len(table))), bool)
            of = right[r : r + some] - left[r : r + some]
            inside = np.repeat(left[r : r + some] - (np.cumsum(of) - of), of)
            inside += np.arange(len(inside))
            marks = end[inside] + np.repeat(np.arange(some, dtype=np.int64) * wide - base, of)
            table[marks] = True
            p, stop = int(first[r]), int(first[r + some])
            shift = np.repeat(np.arange(some, dtype=np.int64) * wide - base, np.diff(first[r : r + some + 1]))
            while p < stop:
                q = min(stop, max(p + 1, int(np.searchsorted(total, (total[p - 1] if p else 0) + PATHS, "right"))))
                k = count[p:q]
                before = np.cumsum(k) - k
                then = np.repeat(begin[p:q] - before, k)
                then += np.arange(len(then))
                spot = np.repeat(shift[p - first[r] : q - first[r]], k)
                spot += end.take(then)
                hit = np.flatnonzero(table.take(spot, mode="clip"))
                if len(hit):
                    then = then[hit]
                    by = edge[p:q][np.searchsorted(before, hit, "right") - 1]
                    code = start[by].astype(np.int64) * n + end[then]
                    over = np.minimum(np.searchsorted(key, code), len(key) - 1)
                    same = np.flatnonzero(key[over] == code)  # a place beyond the row's is another's
                    if len(same):
                        by, then, over = by[same], then[same], over[same]
                        yield start[by], end[by], end[then], by, then, over
                p = q
            table[marks] = False
            r += some

    def all_triangles(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Of the triangles, places (a, b, c) in ascending order of their ids; with numbers of edges, the sums of the sides' too."""
        key = self.directed()
        if self.more is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, more = key[order], self.more[order]
        for u, x, y, *sides in self.triangles(key):
            a, b, c = u, x, y
            for _ in range(2):
                turn = self.ids[a] > self.ids[b]
                a, b = np.where(turn, b, a), np.where(turn, a, b)
                turn = self.ids[b] > self.ids[c]
                b, c = np.where(turn, c, b), np.where(turn, b, c)
            yield (a, b, c) if self.more is None else (a, b, c, sum(more[s] for s in sides))

    def on(self) -> np.ndarray:
        """How many of the triangles each edge has."""
        key = self.directed()
        order = np.argsort(key)
        key = key[order]
        on = np.zeros(len(key), np.int64)
        for _, _, _, *sides in self.triangles(key):
            for s in sides:
                np.add.at(on, s, 1)
        back = np.empty_like(on)
        back[order] = on
        return back

    def values(self) -> np.ndarray:
        """The bits given for each node, NONE where there are none."""
        out = np.full(self.n, NONE, np.int64)
        for f, parts in self.given.items():
            if f in self.names:
                own = self.names[f].all
                for at, bits in parts:
                    rank = np.minimum(np.searchsorted(own, at), len(own) - 1)
                    hit = own[rank] == at
                    out[self.first[f] + rank[hit]] = bits[hit]
        return out


class Graph:
    """The edges (src, dst) of a graph, once in either direction, without loops and nulls, written as packed blocks; ids is a
    table of one column, the nodes or any ids like theirs, and `nodes` of them make a bucket."""

    def __init__(self, edges: DataFrame, ids: DataFrame, nodes: int):
        found = ids.count()
        n = self.n = min(BUCKETS, max(1, -(-found // nodes), found // 500 if found < 8_000 else 16))

        self.buckets = Buckets(n, range_starts(ids, found, n))
        m, sizes = self.pack(edges)
        # Three of c classes hold 9 / c^2 of the edges at most where neighbours lie anywhere.
        least = min(n, max(1, int(np.ceil((9 * m / HELD) ** 0.5)), min(4, int((m / 50_000) ** 0.5))))
        tried = {c: classes_of(sizes, c) for c in range(least, max(least, min(n, CLASSES)) + 1)}
        fit = [c for c, (*_, most) in tried.items() if most <= 1.2 * HELD]
        if not fit and n > 1:
            self.buckets = Buckets(n, None)
            m, sizes = self.pack(edges)
            tried = {least: classes_of(sizes, least)}
        self.classes = c = min(fit or [least], key=lambda c: (tried[c][2], tried[c][3]))
        self.of, self.met = tried[c][:2]
        #: Whether neighbours have near ids, so that the nodes of a triangle mostly are of one bucket.
        self.near = self.buckets.starts is not None and tried[c][2] <= 4 * m
        i, j, k = np.ogrid[:c, :c, :c]
        self.tasks = int((self.met[:, :, None] & self.met[:, None, :] & self.met[None, :, :] & (i <= j) & (j <= k)).sum())

    def pack(self, edges: DataFrame) -> tuple[int, np.ndarray]:
        """Writes the blocks; how many edges there are, and in each block."""
        n, buckets = self.n, self.buckets

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def rows() -> pa.RecordBatch:
                src, dst = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                held.clear()
                (p, x), (q, y) = buckets.places(src), buckets.places(dst)
                turn = (p > q) | ((p == q) & (x > y))
                block = np.where(turn, q * n + p, p * n + q)
                block, x, y = ordered(block, np.where(turn, y, x), np.where(turn, x, y))
                cut = np.flatnonzero(np.diff(block)) + 1
                return as_batch([(int(block[i]), int(block[i]), pack(np.diff(x[i:j], prepend=0), y[i:j])) for i, j in zip([0, *cut], [*cut, len(x)], strict=True) if i < j])

            for batch in batches:
                src, dst = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("src", "dst"))
                keep = src != dst
                held.append((src[keep], dst[keep]))
                size += len(held[-1][0])
                if size >= EDGES:
                    yield rows()
                    size = 0
            if size:
                yield rows()

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, data in grouped(batches):
                pairs = [unpack(d) for _, d in data]
                x, y = ordered(np.concatenate([np.cumsum(p[0]) for p in pairs]), np.concatenate([p[1] for p in pairs]))
                yield as_batch([(len(x), block, pack(np.diff(x, prepend=0), y))])

        packed = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").mapInArrow(sent, PARTS)
        self.blocks = written(dealt(packed).mapInArrow(merged, PARTS), "blocks").withColumnRenamed("task", "size")
        sizes = np.zeros((n, n), np.int64)
        for r in self.blocks.select("block", "size").collect():
            sizes[divmod(r["block"], n)] += r["size"]
        return int(sizes.sum()), sizes

    def class_of(self, bucket: Column) -> Column:
        return F.element_at(F.array(*(F.lit(int(c)).cast("long") for c in self.of)), bucket.cast("int") + 1)

    def bucket_tasks(self, *of: Column) -> Column:
        """The tasks that hold all these classes, one or two, and have edges between every two of theirs."""
        c = self.classes
        every = F.sequence(F.lit(0), F.lit(c - 1)).cast("array<long>")
        table = F.lit(self.met.astype(np.uint8).tobytes())

        def met(i: Column, j: Column) -> Column:
            return F.substring(table, (i * c + j + 1).cast("int"), F.lit(1)) == F.lit(b"\1")

        def near(own: Column) -> Column:
            return F.filter(every, lambda k: met(own, k))

        sets = F.transform(F.filter(every, lambda k: met(of[0], k) & met(of[1], k)), lambda k: F.array_sort(F.array(*of, k))) if len(of) == 2 else F.flatten(F.transform(near(of[0]), lambda j: F.transform(F.filter(near(of[0]), lambda k: met(j, k)), lambda k: F.array_sort(F.array(*of, j, k)))))
        return F.array_distinct(F.transform(sets, lambda s: (s[0] * c + s[1]) * c + s[2]))

    def worked(self, run: Callable[[Part], Iterator[list[pa.Array]]], schema: str, values: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
        """What `run` makes of each three classes; values is (node, value), a number or null; blocks are those of the graph
        with a number for each edge, or without."""
        n, c, buckets, of = self.n, self.classes, self.buckets, self.of
        names = [f.strip().split(" ")[0] for f in schema.split(",")]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for task, data in grouped(batches):
                for columns in run(Part((task // (c * c), task // c % c, task % c), buckets, of, data)):
                    for i in range(0, len(columns[0]), 50_000):
                        yield pa.RecordBatch.from_arrays([x.slice(i, 50_000) for x in columns], names)

        def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = []
            for batch in batches:
                value = batch.column("value")
                bits = value.to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
                held.append((batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64), np.where(value.is_null().to_numpy(zero_copy_only=False), NULL, bits)))
            if held:
                ids, bits = (np.concatenate(h) for h in zip(*held, strict=True))
                bucket, at = buckets.places(ids)
                order = np.lexsort((at, bucket))
                bucket, at, bits = bucket[order], at[order], bits[order]
                cut = np.flatnonzero(np.diff(bucket)) + 1
                yield as_batch([(int(bucket[i]), -1 - int(bucket[i]), pack(at[i:j], bits[i:j])) for i, j in zip([0, *cut], [*cut, len(at)], strict=True) if i < j])

        p, q = (self.class_of(F.call_function("div", F.col("block"), F.lit(n))), self.class_of(F.col("block") % n))
        sent = (self.blocks if blocks is None else blocks).select(F.explode(self.bucket_tasks(p, q)).alias("task"), "block", "data")
        if values is not None:
            given = values.toDF("node", "value").where("node IS NOT NULL").mapInArrow(valued, PARTS)
            sent = sent.union(given.select(F.explode(self.bucket_tasks(self.class_of(F.col("task")))).alias("task"), "block", "data"))
        return dealt(sent, self.tasks).mapInArrow(work, schema)

    def degrees(self) -> DataFrame:
        """(task, block, data): of each bucket, its number twice, and its places and their degrees, packed."""
        n = self.n

        def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    x, y = unpack(data)
                    yield as_batch([(f, f, pack(*np.unique(v, return_counts=True))) for f, v in zip(divmod(block, n), (np.cumsum(x), y), strict=True)])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, data in grouped(batches):
                yield as_batch([(bucket, bucket, pack(*summed([unpack(d) for _, d in data])))])

        return dealt(self.blocks.select("block", "data").mapInArrow(halves, PARTS)).mapInArrow(whole, PARTS)

    def on_blocks(self, run: Callable[..., Iterator[pa.RecordBatch]], schema: str, degrees: bool) -> DataFrame:
        """What run(block, x, y, on, dx, dy) makes of each block: places of its edges' ends, how many triangles an edge has,
        and the ends' degrees."""
        n = self.n

        def counted(part: Part) -> Iterator[list[pa.Array]]:
            on, at = part.on(), 0
            for block, k in part.blocks:
                if on[at : at + k].any():
                    yield [pa.array([block]), pa.array([1]), pa.array([pack(on[at : at + k])], pa.binary())]
                at += k

        def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, data in grouped(batches):
                own = [d for kind, d in data if kind == 0]
                if not own:
                    continue
                x, y = unpack(own[0])
                x, on = np.cumsum(x), np.zeros(len(x), np.int64)
                of = {}
                for kind, d in data:
                    if kind == 1:
                        on += unpack(d)[0]
                    elif kind >= 2:
                        of[kind - 2] = unpack(d)
                p, q = divmod(block, n)
                ends = [of[f][1][np.searchsorted(of[f][0], v)] for f, v in ((p, x), (q, y))] if degrees else [None, None]
                yield from run(block, x, y, on, *ends)

        every = self.blocks.select(F.col("block").alias("task"), F.lit(0).cast("long").alias("block"), "data").union(self.worked(counted, PARTS))
        if degrees:
            other, own = F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"), F.col("block")
            block = F.transform(other, lambda o: F.least(own, o) * n + F.greatest(own, o))
            sent = self.degrees().select(F.explode(block).alias("task"), (own + 2).alias("block"), "data")
            every = every.union(sent)
        return dealt(every).mapInArrow(finished, schema)

    def with_counts(self) -> DataFrame:
        """The blocks, with the triangles of each edge, written."""

        def run(block: int, x: np.ndarray, y: np.ndarray, on: np.ndarray, *_: None) -> Iterator[pa.RecordBatch]:
            yield as_batch([(len(x), block, pack(np.diff(x, prepend=0), y, on))])

        return written(self.on_blocks(run, PARTS, False), "counts")

    def on_nodes(self, run: Callable[..., tuple[np.ndarray, ...]], names: list[str], degrees: bool) -> DataFrame:
        """(node, names..): sums over each node's edges of the numbers that run(on, dx, dy) gives for edges."""
        n, buckets = self.n, self.buckets

        def ends(block: int, x: np.ndarray, y: np.ndarray, on: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = run(on, dx, dy)
            yield as_batch([(f, f, pack(*summed([[v, *columns]]))) for f, v in zip(divmod(block, n), (x, y), strict=True)])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, data in grouped(batches):
                at, *columns = summed([unpack(d) for _, d in data])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (buckets.named(bucket, at), *columns)], ["node", *names])

        return dealt(self.on_blocks(ends, PARTS, degrees)).mapInArrow(whole, ", ".join(f"{c} long" for c in ("node", *names)))

    def linked(self, run: Callable[[np.ndarray, np.ndarray, Part], Iterator[list[pa.Array]]], schema: str, every: bool, blocks: DataFrame | None = None) -> DataFrame:
        """What run(a, b, link) makes of nodes and the triangles at them, with `every` all of them, else those whose least node
        it is. The link's nodes are edges, from a to b; two are joined where a triangle at a has both as sides. So a
        triangle of the link stands for four nodes of which every two are joined. With blocks that have numbers of edges, the link
        has for each of its edges, a triangle, the sum of its sides' (`more`)."""
        n, near, buckets = self.n, self.near, self.buckets
        names = [f.strip().split(" ")[0] for f in schema.split(",")]

        def found(part: Part) -> Iterator[list[pa.Array]]:
            made = list(part.all_triangles())
            if not made:
                return
            abc = [part.ids[np.concatenate([m[i] for m in made])] for i in range(3)]
            more = [] if part.more is None else [np.concatenate([m[3] for m in made])]
            made.clear()
            before = None
            for i in range(3 if every else 1):
                if near:  # once to the bucket of several of its nodes, which ascend
                    group, at = buckets.places(abc[i])[0], abc[0]
                    order = np.lexsort((at, group))
                    order = order if before is None else order[group[order] != before[order]]
                    before = group
                else:
                    bucket, at = places(abc[i], n)
                    group = bucket * SPLIT + at % SPLIT
                    order = np.lexsort((at, group))
                if not len(order):
                    continue
                group, at = group[order], at[order]
                ends = [v[order] for v in (*(abc[1:] if near else (abc[(i + 1) % 3], abc[(i + 2) % 3])), *more)]
                cut = np.flatnonzero(np.diff(group)) + 1
                rows = [(int(group[p]), 0, pack(np.diff(at[p:q], prepend=0), *(v[p:q] for v in ends))) for p, q in zip([0, *cut], [*cut, len(group)], strict=True)]
                yield list(as_batch(rows).columns)

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group, data in grouped(batches):
                columns = [np.concatenate(c) for c in zip(*([np.cumsum(at), *rest] for at, *rest in (unpack(d) for _, d in data)), strict=True)]
                if not near:
                    yield from linking(named(group // SPLIT, columns[0], n), *columns[1:])
                    continue
                abc, more = columns[:3], columns[3:]
                ours = [buckets.places(v)[0] == group for v in abc] if every else [np.ones(len(abc[0]), bool)]
                for part in range(SPLIT):
                    picked = [np.flatnonzero(o & (v % SPLIT == part)) for o, v in zip(ours, abc, strict=False)]
                    parts = [[v[at] for v in (abc[i], abc[(i + 1) % 3], abc[(i + 2) % 3], *more)] for i, at in enumerate(picked)]
                    if sum(map(len, picked)):
                        yield from linking(*map(np.concatenate, zip(*parts, strict=True)))

        def linking(a: np.ndarray, b: np.ndarray, c: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
            own, other = Names([a]), Names([b, c])
            wide = len(other.all)
            codes = [own.rank(a).astype(np.int64) * wide + other.rank(v) for v in (b, c)]
            nodes = np.unique(np.concatenate(codes))
            lo, hi = (np.searchsorted(nodes, x) for x in codes)
            del codes, a, b, c
            part = Part.plain(len(nodes), np.minimum(lo, hi), np.maximum(lo, hi))
            part.more = more[0] if more else None
            del lo, hi
            for out in run(own.all[nodes // wide], other.all[nodes % wide], part):
                for i in range(0, len(out[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 50_000) for x in out], names)

        return dealt(self.worked(found, PARTS, blocks=blocks), n * SPLIT).mapInArrow(link, schema)
