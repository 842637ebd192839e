"""Exact Jaccard join of word n-gram sets, by prefixes of token combinations, and its components.

A token is a shingle hash. How often it occurs is estimated for all rows in a table of fixed size, as a rank; by rank,
tokens are rare (class 1), frequent (2) or very frequent (3). Tokens are ordered by rank, then hash. A
set's prefix is extended until removing any `slack` tokens (all that two linked sets can differ by on one side) must leave
k tokens of some group of class k; class-k tokens fall into small groups, class 1 into groups of its own tokens. So two
linked sets share a single rare token, or a pair or triple of frequent tokens of one group, within both prefixes. Those
are the signatures.

Of a signature's nodes, those stay for which sizes and parities of hashes allow a link with another one. They form a
cell: each set x is replaced by its difference E(x) from what most of a few members of the cell have. |x - y| + |y - x| is
the same for the sets and for their differences, whatever the centre. A hub, the member nearest the centre, links to all
that the triangle inequality lets it; every other link of the cell has a token in both differences, which are short, and
whose first common token stands early in both. So rows grow with the edits that copies share and not with the number of
pairs of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import pieces, released, texts, written
from .components import connected
from .shingles import mixed, shingle_hashes

#: Bits of the filter that tells which rows' sets are to be made again.
FILTER_BITS = 23
#: Cells of the parities that bound from below how many tokens two sets don't share.
PARITIES = 512
#: Nodes of a signature that are held against each other by parities (of more, all stay); members from which a cell's
#: centre is drawn.
CROWD, DRAWN = 512, 15
#: Sets with a token's cell in more sets than this, beyond what chance gives, have a frequent, a very frequent token.
FREQUENT, VERY_FREQUENT = 16, 256
#: Stands for a null id where ids are keys.
NO_ID = -(1 << 63)


def groups_of(at: int, percent: int) -> int:
    return max(1, (1 << at) * (100 - percent) // 200)


def level(n: int, percent: int) -> int:
    """Sets of one level share the number of groups: the power of two below n, or -1 where so few tokens might stand alone
    in their groups (three a group) before the prefix is long enough."""
    at = n.bit_length() - 1
    return at if at >= 0 and (1 << at) * percent - 100 >= 300 * groups_of(at, percent) else -1


def combos(tokens: np.ndarray, group: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of all k-token combinations within each group."""
    order = np.lexsort((tokens, group))
    tokens, group = tokens[order], group[order]
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    picks = [np.array(list(combinations(range(s, e), k)), np.int64) for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s >= k]
    if not picks:
        return np.zeros(0, np.uint64)
    chosen = np.concatenate(picks)
    h = np.full(len(chosen), salt, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(0x100000001B3) + tokens[chosen[:, i]])
    return h


def signatures(tokens: np.ndarray, ranks: np.ndarray, bounds: tuple[int, int], percent: int) -> np.ndarray:
    """The signatures of one set, given its distinct tokens and the rank of each; bounds are the least ranks of
    classes 2 and 3."""
    n = len(tokens)
    need = n * (100 - percent) // 100 + 1
    order = np.lexsort((tokens, ranks))
    tokens, ranks = tokens[order], ranks[order]
    n_rare = int(np.searchsorted(ranks, bounds[0]))
    if n_rare >= need:
        return mixed(tokens[:need])
    out = [mixed(tokens[:n_rare])]
    for at in {level(n, percent), level(-(-n * percent // 100), percent)}:
        if at < 0:
            out.append(mixed(tokens[:need]))
            continue
        groups = groups_of(at, percent)
        rest, kind = tokens[n_rare:], 1 + (ranks[n_rare:] >= bounds[1]).astype(np.int64)
        group = (mixed(rest ^ np.uint64(at + 7)) % np.uint64(groups)).astype(np.int64) + kind * groups
        by = np.argsort(group, kind="stable")
        begin = np.concatenate([[True], group[by][1:] != group[by][:-1]])
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(begin, np.arange(len(by)), 0))
        reached = np.cumsum(place >= kind)  # a group of class k gives what it has beyond k - 1 tokens
        stop = int(np.searchsorted(reached, need - n_rare)) + 1
        for k in (1, 2):
            own = kind[:stop] == k
            out.append(combos(rest[:stop][own], group[:stop][own], k + 1, at * 4 + k))
    return np.unique(np.concatenate(out))


def token_ranks(docs: DataFrame, width: int, bits: int) -> tuple[np.ndarray, tuple[int, int]]:
    """For each of the 2**bits hash cells, the rank (8 * log2 of the count, rounded down) of the sets that hold a token of
    the cell, over all rows; and the least ranks of the frequent and the very frequent. Each task sends 2**bits counts,
    packed, which tasks by slice of cells add up as they stream in; 2**bits bytes go to the driver and the workers."""
    slices = 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for part in pieces(batches):
            cell = (shingle_hashes(part.column("text"), width)[0] >> np.uint64(64 - bits)).astype(np.int64)
            total += np.bincount(cell, minlength=1 << bits).astype(np.uint32)
        if total.any():
            for i, some in enumerate(np.split(total, slices)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(some)])], ["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, n in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total[i] = total.get(i, 0) + unpack(n)[0]
        for i, n in total.items():
            rank = np.floor(8 * np.log2(1.0 + n)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([rank]), pa.array([int(n.sum())])], ["slice", "n", "total"])

    parts = docs.select("text").mapInArrow(released(count), "slice int, n binary").repartition(slices, "slice")
    ranks, total = np.zeros((slices, (1 << bits) // slices), np.uint8), 0
    for row in parts.mapInArrow(released(add), "slice int, n binary, total long").collect():
        ranks[row["slice"]] = np.frombuffer(row["n"], np.uint8)
        total += row["total"]
    chance = total / (1 << bits)
    chance += 4 * chance**0.5  # what other tokens of its cell may add to a token's count
    return ranks.reshape(-1), (int(8 * np.log2(chance + FREQUENT)), int(8 * np.log2(chance + VERY_FREQUENT)))


def parities(tokens: np.ndarray, cells: int = PARITIES) -> bytes:
    """For each of some hash cells, a power of two, whether an odd number of tokens falls into it, as bits."""
    odd = np.bincount(((tokens >> np.uint64(8)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def wide(n: int) -> int:
    """So many cells that sets of n tokens that have little in common differ in more of them than linked ones may."""
    return max(PARITIES, 1 << max(0, n.bit_length() - 1))


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def set_rows(docs: DataFrame, width: int, percent: int, ranks: np.ndarray, bounds: tuple[int, int]) -> DataFrame:
    """Per row: doc_id, text_hash, n (size of its set), node (a 128-bit digest of the set), sigs, odd and wide (parities of its hashes)."""
    bits = len(ranks).bit_length() - 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            tokens, first = shingle_hashes(part.column("text"), width)
            rank = ranks[(tokens >> np.uint64(64 - bits)).astype(np.int64)]
            sets = [(tokens[s:e], rank[s:e]) for s, e in zip(first[:-1], first[1:], strict=True)]
            sigs = long_lists([signatures(*x, bounds, percent) if len(x[0]) else x[0] for x in sets])
            nodes, odd, more = [digest(x) for x, _ in sets], [parities(x) for x, _ in sets], [parities(x, wide(len(x))) for x, _ in sets]
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(first)), pa.array(nodes, pa.binary()), sigs, pa.array(odd, pa.binary()), pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "node", "sigs", "odd", "wide"])

    return docs.mapInArrow(released(make), "doc_id long, text_hash long, n long, node binary, sigs array<long>, odd binary, wide binary")


def id_bit(ids: pa.Array) -> np.ndarray:
    ids = np.ascontiguousarray(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False))
    return mixed(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(k, n, tokens) for `wanted` (doc_id, node, k; one row of each node). A filter of fixed size (1 MB) spares most other
    rows the work; where it is full, all rows are made and the join alone selects. Rows are matched by id and digest, so
    rows that share an id, or have none, cannot lend their tokens to each other."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = id_bit(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["word", "bits"])

    words = wanted.select("doc_id").mapInArrow(released(place), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    held = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for row in words:
        held[row["word"]] = row["bits"] % (1 << 64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            bit = id_bit(part.column("doc_id"))
            part = part.filter(pa.array((held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1))
            tokens, first = shingle_hashes(part.column("text"), width)
            sets = [tokens[s:e] for s, e in zip(first[:-1], first[1:], strict=True)]
            columns = [part.column("doc_id").fill_null(NO_ID), pa.array([digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), long_lists(sets)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "tokens"])

    made = docs.mapInArrow(released(make), "doc_id long, node binary, n long, tokens array<long>")
    wanted = wanted.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "node", "k")
    # Repeated rows of one id and text are alike; as the join, this is dealt by (doc_id, node).
    return made.join(wanted.hint("merge"), ["doc_id", "node"]).dropDuplicates(["doc_id", "node"]).select("k", "n", "tokens")


def far_apart(unlike: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m tokens, of which `unlike` are in one only, do not link."""
    return unlike * (100 + percent) > (n + m) * (100 - percent)


def folded(odd: list[bytes], size: int) -> np.ndarray:
    """Parities over `size` bytes of cells, from those over as many or more."""
    out = []
    for x in odd:
        v = np.frombuffer(x, np.uint8)
        while len(v) > size:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out.append(v)
    return np.stack(out).view(np.uint64)


def hopeful(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Of (key, k, n, odd, size), the (key, k) whose sizes and parities allow a link with another node of the key: a cell of
    unequal parity holds a token that one set lacks. A key of more than CROWD nodes keeps all, and a task holds no more
    rows of one than that."""

    def near(n: np.ndarray, odd: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
        unlike = np.bitwise_count(odd ^ other).sum(-1, dtype=np.int64)
        return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (unlike * (100 + percent) <= (n + m) * (100 - percent))

    def any_near(n: np.ndarray, odd: list[bytes]) -> np.ndarray:
        keep, sizes = np.zeros(len(n), bool), np.array([len(x) for x in odd])
        for size in np.unique(sizes):  # pairs of which the lesser has parities of that size
            at = np.flatnonzero(sizes >= size)
            cells = folded([odd[i] for i in at], size)
            own = np.flatnonzero(sizes[at] == size)
            for i in own.tolist():
                hits = near(n[at[i]], cells[i], n[at], cells)
                hits[i] = False
                keep[at[hits]] = True
                keep[at[i]] |= hits.any()
        return keep

    def chosen(of: np.ndarray, n: np.ndarray, odd: list[bytes]) -> np.ndarray:
        keep = np.zeros(len(of), bool)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        size = np.diff(np.append(starts, len(of)))
        alike = np.array([len(x) for x in odd]) == PARITIES // 8
        two = starts[size == 2]
        two = two[alike[two] & alike[two + 1]]
        if len(two):
            a, b = (np.frombuffer(b"".join([odd[i] for i in at]), np.uint64).reshape(len(at), -1) for at in (two, two + 1))
            keep[two] = keep[two + 1] = near(n[two], a, n[two + 1], b)
        done = np.zeros(len(of), bool)
        done[two] = True
        for s, g in zip(starts.tolist(), size.tolist(), strict=True):
            if g > 1 and not done[s]:
                keep[s : s + g] = any_near(n[s : s + g], odd[s : s + g])
        return keep

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = chosen(batch.column(key).to_numpy(), batch.column("n").to_numpy(), batch.column("odd").to_pylist())
        return batch.select([key, "k"]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            of = rest.column(key).to_numpy()
            whole = int(np.searchsorted(of, of[-1]))  # the last key may go on
            yield kept(rest.slice(0, whole))
            rest = rest.slice(whole)
        if rest is not None:
            yield kept(rest)

    some = rows.where(F.col("size") <= CROWD).select(key, "k", "n", "odd").repartition(key).sortWithinPartitions(key)
    return some.mapInArrow(released(run), f"{key} long, k long").union(rows.where(F.col("size") > CROWD).select(key, "k"))


def centres(samples: DataFrame) -> DataFrame:
    """Per cell of (cell, tokens), at most DRAWN rows a cell, the tokens that more than half of its rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def row() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.ListArray.from_arrays([0, int((2 * n > len(held)).sum())], pa.array(tokens[2 * n > len(held)]))], ["cell", "centre"])

        for batch in batches:
            for one, tokens in zip(batch.column("cell").to_pylist(), batch.column("tokens"), strict=True):
                if one != cell and held:
                    yield row()
                    held = []
                cell = one
                held.append(tokens.values.to_numpy())
        if held:
            yield row()

    return samples.repartition("cell").sortWithinPartitions("cell").mapInArrow(released(run), "cell long, centre array<long>")


def differences(members: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(cell, k, n, tokens, centre) with e, the tokens that only one of both has, rare ones first, in place of both."""
    bits = len(ranks).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens, centre in zip(batch.column("tokens"), batch.column("centre"), strict=True):
                e = np.setxor1d(tokens.values.to_numpy(), centre.values.to_numpy(), assume_unique=True).view(np.uint64)
                out.append(e[np.lexsort((e, ranks[(e >> np.uint64(64 - bits)).astype(np.int64)]))])
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("k"), batch.column("n"), pa.array([len(e) for e in out], pa.int64()), long_lists(out)], ["cell", "k", "n", "m", "e"])

    return members.mapInArrow(released(run), "cell long, k long, n long, m long, e array<long>")


def cell_links(members: DataFrame, ranks: np.ndarray, percent: int) -> DataFrame:
    """The links (a, b) within cells, but for those between members that link to the hub of their cell anyway."""
    some = F.col("m") * -(100 + percent) + F.col("n") * (100 - percent)
    rows = written(differences(members, ranks).withColumn("r", F.monotonically_increasing_id()), "differences").withColumn("score", some)
    # x and the hub differ in at most m + m(hub) tokens; of two members that are so near, both link to the hub.
    hubs = written(rows.groupBy("cell").agg(F.max(F.struct("score", "k")).alias("hub")), "hubs")
    near = rows.select("cell", "k", "score").join(hubs.hint("merge"), "cell").where((F.col("score") + F.col("hub.score") >= 0) & (F.col("k") != F.col("hub.k")))
    near = near.select(F.col("hub.k").alias("a"), F.col("k").alias("b"))
    # All before the first common token, on both sides, is in one set only, as is what the longer rest has more.
    most = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent)).cast("int")
    marks = rows.select("cell", "r", "n", "m", "score", F.posexplode(F.slice("e", F.lit(1), most + 1)).alias("i", "token"))
    marks = marks.select(F.xxhash64("cell", "token").alias("mark"), "r", F.col("n").cast("int"), F.col("m").cast("int"), F.col("i").cast("int"), "score")
    a, b = marks.toDF("mark", "ra", "na", "ma", "ia", "sa"), marks.toDF("mark", "rb", "nb", "mb", "ib", "sb")
    least = F.col("ia") + F.col("ib") + F.abs(F.col("ma") - F.col("ia") - F.col("mb") + F.col("ib"))
    fits = (F.col("ra") < F.col("rb")) & (F.col("sa") + F.col("sb") < 0) & ~far_apart(least, F.col("na"), F.col("nb"), percent)
    pairs = a.join(b.hint("merge"), "mark").where(fits).select("ra", "rb").distinct()
    own = rows.select("r", "cell", "k", "n", "m", "e")
    both = pairs.join(own.toDF("ra", "ca", "a", "na", "ma", "ea"), "ra").join(own.toDF("rb", "cb", "b", "nb", "mb", "eb"), "rb")
    unlike = F.col("ma") + F.col("mb") - 2 * F.size(F.array_intersect("ea", "eb"))
    return near.union(both.where((F.col("ca") == F.col("cb")) & ~far_apart(unlike, F.col("na"), F.col("nb"), percent)).select("a", "b"))


def ngram_jaccard_join(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    cell_bits: int = 22,
) -> DataFrame:
    """Returns doc_id, n_shingles and component_id, the least id that links reach; exact. Besides, component is a number that
    each component has alone, also where ids repeat (null for an empty set), and text_hash the xxhash64 of the text.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a set holds the distinct `width`-word shingles,
    of a shorter text the whole sequence. Two rows link when 100 * intersection >= percent * union. Null and empty texts
    have the empty set, n_shingles 0 and their own id as component. Rows with equal ids and texts stay rows; rows with one
    id and different texts are different documents. A null id reaches others and is reached, but is never the least one;
    where no other is reached, component_id is null. An empty table gives no rows; other columns are not carried.

    Equal sets are one node, so copies cost one row each. The nodes of a signature form a cell (see above), named by that of
    them with the most signatures, so that the signatures of a group of copies name one cell. Nothing is capped.
    """
    docs = texts(df, id_col, text_col)
    ranks, bounds = token_ranks(docs, width, cell_bits)
    rows = written(set_rows(docs.withColumn("text_hash", F.xxhash64("text")), width, percent, ranks, bounds), "sets")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.any_value(c).alias(c) for c in ("n", "odd", "wide", "sigs")))
    nodes = written(nodes.withColumn("k", F.monotonically_increasing_id()), "nodes")  # from here on, k names a node
    marks = nodes.select("k", F.explode("sigs").alias("sig"))
    sizes = marks.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    marks = marks.join(sizes.hint("merge"), "sig").select("k", "sig", "size").join(nodes.select("k", "n", "odd").hint("merge"), "k")
    crowds = written(hopeful(marks, "sig", percent), "marks")
    weights = crowds.groupBy("k").agg(F.count(F.lit(1)).alias("weight"))
    crowds = written(crowds.join(weights, "k"), "crowds")
    leaders = written(crowds.groupBy("sig").agg(F.max(F.struct("weight", "k")).getField("k").alias("cell")), "leaders")
    cells = written(crowds.join(leaders.hint("merge"), "sig").select("cell", "k").distinct(), "named-cells")
    members = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    members = cells.join(members.hint("merge"), "cell").join(nodes.select("k", "n", F.col("wide").alias("odd")).hint("merge"), "k")
    cells = written(hopeful(members, "cell", percent), "cells")
    sets = written(sets_of(docs, nodes.select("doc_id", "node", "k").join(cells.select("k").distinct(), "k"), width), "tokens")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("k"), "k"))  # any members, lest they share an odd token
    drawn = cells.withColumn("place", place).where(F.col("place") <= DRAWN).select("cell", "k")
    centre = written(centres(drawn.join(sets, "k").select("cell", "tokens")), "centres")
    members = cells.select("cell", "k").join(sets, "k").join(centre.hint("merge"), "cell")
    links = written(cell_links(members, ranks, percent), "links")

    comps = connected(links).withColumnRenamed("node", "k")
    comps = nodes.select("k", "node", "doc_id").join(comps, "k", "left").select("node", "doc_id", F.coalesce("comp", "k").alias("comp"))
    least = written(comps.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    named = written(comps.join(least.hint("merge"), "comp").select("node", "component_id", F.col("comp").alias("component")), "named")
    every = rows.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named.hint("merge"), "node", "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), "component", "text_hash")
