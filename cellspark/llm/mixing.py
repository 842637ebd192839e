"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written


def shares(weights: list[float], period: int | None = None) -> list[int]:
    """Whole numbers in exactly the proportions of the weights, the least such.

    With a period, whole parts of it by largest remainder instead, at least 1 each.
    """
    if period is None:
        exact = [Fraction(w) for w in weights]
        scale = lcm(*(e.denominator for e in exact))
        parts = [int(e * scale) for e in exact]
        common = gcd(*parts)
        return [part // common for part in parts]
    period = max(period, len(weights))
    total = sum(weights)
    exact = [w / total * (period - len(weights)) for w in weights]
    parts = [1 + int(e) for e in exact]
    order = sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))
    for i in order[: period - sum(parts)]:
        parts[i] += 1
    return parts


def pfair(parts: list[int]) -> Iterator[int]:
    """Which source each slot serves, without end. Block j of a source of weight w = part / sum of parts is released at
    floor(j / w) and due at ceil((j + 1) / w); each slot serves the released block due first, of equals the source first
    in order. Every block is served within its window, so each source stays less than one block from its share."""
    period = sum(parts)
    waiting = [(0, i, 0) for i in range(len(parts))]  # (release, source, block)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[i]), i, j))
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        yield i
        heapq.heappush(waiting, ((j + 1) * period // parts[i], i, j + 1))
        slot += 1


def pfair_period(parts: list[int]) -> list[int]:
    """The slots of pfair until it repeats."""
    return list(islice(pfair(parts), sum(parts)))


def schedule(blocks: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The source of every slot, and the slots with which phases end. A phase ends when a source has nothing left; the
    next one shares the slots among the rest by their weights, exactly."""
    left, turns, ends = list(blocks), [], []
    alive = [i for i, b in enumerate(blocks) if b]
    parts = shares(weights) if weights else []
    while alive:
        for k in pfair([parts[i] for i in alive]):
            i = alive[k]
            turns.append(i)
            left[i] -= 1
            if not left[i]:
                break
        ends.append(len(turns) - 1)
        alive = [i for i in alive if left[i]]
    return np.array(turns, np.int64), np.array(ends, np.int64)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    block_rows: int = 64,
    most_sources: int | None = None,
    bucket_rows: int = 1024,
) -> DataFrame:
    """Interleave the blocks of all sources to target weights; returns doc_id, source, block, slot, place and text_hash (the text's xxhash64).

    weights gives each source's target, 1 where it says nothing; without it, a source's number of rows to the power of
    temperature. A source's rows are ordered by their hashed id and cut into blocks of block_rows; place is the row's
    place in the mixture, 0 .. without gaps. Within a phase each source is less than one block from its target share; a
    phase ends when a source is used up, and every row is placed. A null source is a source of its own; rows with equal
    ids and texts each get a place; an empty table gives an empty result; other columns are not carried.

    Skew: a source's rows are ranked within hashed buckets of about bucket_rows rows, and buckets by running sums, so a
    source that holds a third of all rows is ranked by many tasks. The driver has a count per source (with most_sources,
    more than these are an error) and makes the schedule from them, some 50 bytes a block; rows find their slots by a join.
    """
    rows = texts(df, id_col, text_col, F.col(source_col).cast("string").alias("source"))
    rows = rows.select("doc_id", "source", F.xxhash64("doc_id").alias("turn"), F.xxhash64("text").alias("tie"))
    counts = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()]
    if most_sources is not None and len(counts) > most_sources:
        raise ValueError(f"more than {most_sources} sources; give their groups as source column")
    counts.sort(key=lambda c: (c[0] is not None, c[0] or ""))
    blocks = [-(-n // block_rows) for _, n in counts]
    targets = [float(n) ** temperature if weights is None else float(weights.get(s, 1.0)) for s, n in counts]
    if any(t <= 0 for t in targets):
        raise ValueError("weights must be positive")

    spark = df.sparkSession
    total = sum(n for _, n in counts)
    buckets = max(1, 1 << max(0, (total // bucket_rows).bit_length()))
    number = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(counts)], "source string, k int")
    rows = rows.join(F.broadcast(number), rows["source"].eqNullSafe(number["source"])).select("doc_id", rows["source"], "turn", "tie", "k")
    rows = rows.withColumn("bucket", F.shiftrightunsigned(F.col("turn").bitwiseXOR(F.lit(-(1 << 63))), 64 - (buckets.bit_length() - 1)) if buckets > 1 else F.lit(0).cast("long"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("k", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("k", "bucket").orderBy("turn", "doc_id", "tie")
    ranked = rows.withColumn("at", F.row_number().over(inside) - 1).join(sums, ["k", "bucket"])
    rank = F.col("start") + F.col("at")
    ranked = ranked.select("doc_id", "source", "tie", "k", F.floor(rank / block_rows).alias("block"), (rank % block_rows).alias("in_block"))

    turns, ends = schedule(blocks, targets)
    # A source's blocks take its slots in order. All blocks but a source's last, which ends a phase, are full, so a slot's
    # first place follows from the phases before it.
    order = np.argsort(turns, kind="stable")
    starts = np.cumsum([0, *blocks])[:-1]
    block = np.arange(len(turns)) - np.repeat(starts, blocks)
    rows_of, blocks_of = np.array([n for _, n in counts], np.int64), np.array(blocks, np.int64)
    lost = np.cumsum(np.concatenate([[0], (blocks_of * block_rows - rows_of)[turns[ends]]])) if len(ends) else np.zeros(1, np.int64)
    first = order * block_rows - lost[np.searchsorted(ends, order)]
    when = pa.table({"k": pa.array(turns[order], pa.int32()), "block": pa.array(block, pa.int64()), "slot": pa.array(order, pa.int64()), "first": pa.array(first, pa.int64())})
    when = written(spark.createDataFrame(when), "schedule")
    # By sorting at all sizes: a key has at most block_rows rows.
    placed = ranked.join(when.hint("merge"), ["k", "block"])
    return placed.select("doc_id", "source", "block", "slot", (F.col("first") + F.col("in_block")).cast("long").alias("place"), F.col("tie").alias("text_hash"))


def deviation(parts: list[int], turn: list[int]) -> Fraction:
    """The greatest distance, in blocks, between what a source got and its share, over all slots of a period."""
    worst, got, period = Fraction(0), [0] * len(parts), lcm(sum(parts), 1)
    for slot, i in enumerate(turn, 1):
        got[i] += 1
        worst = max(worst, *(abs(Fraction(part * slot, period) - g) for part, g in zip(parts, got, strict=True)))
    return worst
