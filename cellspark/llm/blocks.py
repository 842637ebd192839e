"""Blocks of texts ask for what all blocks together know of their keys.

A task cuts its texts into blocks and lists each block's distinct keys, packed, by the part that a key's hash falls into.
One task gathers what all blocks ask of a part, works each key out once, and answers every block in the order it asked.
The answers then meet the block's own rows, made a second time. So no text is shuffled with its keys, and neither a key
nor an answer is a row: rows between the passes are as many as blocks times parts. A block is named by its texts' digest:
if a task that runs again made other blocks, their answers would be missing, which is an error and never a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, utf8_buffer, written

#: Bytes of text in a block, and the square of the bytes of text in a part: parts grow with the root of the input.
BLOCK, PART = 8_000_000, 1 << 16
#: In place of a part, a block's own rows; they sort after its answers.
OWN = 1 << 30
PARTS = "part int, block binary, payload binary"
_CODEC = pa.Codec("zstd", 1)


def steady(df: DataFrame) -> DataFrame:
    """df, or a written copy if its rows pass an exchange, which may deal and order them otherwise when it runs again."""
    return written(df, "rows") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def part_count(docs: DataFrame, text_col: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(8, round((size / PART) ** 0.5))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of about `most` bytes of text, a longer text alone counting as whole."""
    held, size = [], 0
    for batch in batches:
        start = 0
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, before + most - size, "left")) + 1)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def name_of(column: pa.Array) -> bytes:
    raw, ends = utf8_buffer(column.fill_null(""))
    return hashlib.blake2b(raw.tobytes(), digest_size=16, key=hashlib.blake2b(ends.tobytes(), digest_size=16).digest()).digest()


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, none negative; each array's low bytes before its high ones, as these are mostly zero."""
    out = []
    for a in arrays:
        planes = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out += [np.array([len(a), planes], np.int64).tobytes(), np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()]
    return packed(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    body, at, out = unpacked(data), 0, []
    while at < len(body):
        n, planes = np.frombuffer(body, np.int64, 2, at).tolist()
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :planes] = np.frombuffer(body, np.uint8, n * planes, at + 16).reshape(planes, n).T
        out.append(wide.reshape(-1).view(np.uint64))
        at += 16 + n * planes
    return out


def packed(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def as_rows(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    part, block, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.binary()), pa.array(payload, pa.binary())], ["part", "block", "payload"])


def batched(rows: Iterator[tuple[int, bytes, bytes]], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size >= most:
            yield as_rows(held)
            held, size = [], 0
    if held:
        yield as_rows(held)


def by_part(asked: DataFrame, parts: int) -> DataFrame:
    """All that is asked of a part in one task, one part after the other."""
    return asked.repartition(parts, "part").sortWithinPartitions("part", "block")


def grouped(batches: Iterator[pa.RecordBatch], key: str, others: list[str]) -> Iterator[tuple]:
    """(key, lists of the other columns) of batches that are sorted by key."""
    last, held = None, [[] for _ in others]
    for batch in batches:
        for at, one in enumerate(batch.column(key).to_pylist()):
            if one != last and held[0]:
                yield last, held
                held = [[] for _ in others]
            last = one
            for out, c in zip(held, others, strict=True):
                out.append(batch.column(c)[at].as_py())
    if held[0]:
        yield last, held


def returned(answers: DataFrame, own: DataFrame, finish: Callable[[list[bytes], bytes], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """finish(answers in the order of parts, payload) for each of the blocks' own rows, where its answers meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, answered, last = None, [], -1
        for batch in batches:
            for at, (part, name) in enumerate(zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if name != block:
                    block, answered, last = name, [], -1
                payload = batch.column("payload")[at].as_py()
                if part < OWN:
                    if part != last:  # equal blocks ask alike and are answered alike
                        answered.append(payload)
                        last = part
                    continue
                if int.from_bytes(payload[:4], "little") != len(answered):
                    raise RuntimeError("a block was cut in another way when it was made again; give rows that a scan or a written table yields")
                yield from finish(answered, payload[4:])

    return answers.select("part", "block", "payload").union(own).repartition("block").sortWithinPartitions("block", "part").mapInArrow(released(run), schema)


def own_row(block: bytes, answers: int, payload: bytes) -> tuple[int, bytes, bytes]:
    """A block's own rows, which come after the answers that it expects."""
    return OWN, block, answers.to_bytes(4, "little") + payload
