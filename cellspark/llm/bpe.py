"""Byte-level BPE: Spark's higher-order functions fold ranked merges over the bytes of distinct words.

The tokenizer's ranks are scalar subqueries over local rows, so no plan's text holds them. Within the fold, a word is an
array of its adjacent pairs of tokens, one long each: the rank of what the pair merges into, room for a place, then both
token ids. A step takes the first pair of least rank, puts the merged token in its place and looks up the two new pairs.
Around a word stand edges that merge with nothing.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .blocks import pack, unpack
from .common import pieces, released, small_batches

#: Token ids, ranks among them, are below the edge; a pair that merges into nothing has the rank NO_RANK.
EDGE, NO_RANK = 0xFFFE, 0xFFFF
#: Of a pair's long: bits below its rank, and bits below its place, which the fold fills in to find the first of least rank.
RANK_AT, PLACE_AT = 47, 32
#: Longest window, in bytes: its pairs' places, edges included, have room.
LONGEST = (1 << (RANK_AT - PLACE_AT)) - 2
#: Of the table of pairs: multiplier of a key of 32 bits, whose product stays a long, and bits of its buckets, of which
#: each has a shift of its own.
SPREAD, BUCKET_BITS = 0x5851F42D, 16
#: Columns of tables, of names that no other column has.
SHIFTS, ENTRIES, TOKENS = "\tshifts", "\tentries", "\ttokens"
#: Texts are cut into blocks of so many bytes; a worker forgets its words beyond so many.
BLOCK, KNOWN = 500_000, 1_200_000
#: Patterns and others that match the same in less time: one alternative for all that begin with an apostrophe.
SAME = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}
#: Input partitions that one task may take, where there are more than cores: it meets more words again.
TOGETHER = 8


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if max(ranks.values()) >= EDGE:
        raise ValueError("ranks must fit in two bytes")
    return ranks


def merged(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging alone makes of a token's bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=4)
def unmerged(path: str) -> dict[bytes, int]:
    """Tokens that merging alone doesn't reach; a word that is one of them is that token nevertheless."""
    ranks = load_ranks(path)
    return {token: rank for token, rank in ranks.items() if len(merged(token, ranks)) > 1}


@lru_cache(maxsize=2)
def pair_table(path: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The pairs of tokens that merge, as a hash table without collisions: the multiplier, shifts by bucket, and entries
    rank << RANK_AT | left << 16 | right, -1 where free. The multiplier is the first that parts the keys of each bucket; buckets
    are placed from the fullest on, each at the first shift that finds all its places free."""
    ranks = load_ranks(path)
    keys, values = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 16 | right)
                values.append(rank << RANK_AT | left << 16 | right)
    size = 1 << max(8, (2 * len(keys)).bit_length())
    for spread in range(SPREAD, 1 << 31, 2):
        h = np.array(keys, np.int64) * np.int64(spread)
        bucket, at = (h >> 31) & ((1 << BUCKET_BITS) - 1), (h >> 13) & (size - 1)
        if len(np.unique(bucket * size + at)) == len(keys):
            break
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if keys else []
    shifts, entries = np.zeros(1 << BUCKET_BITS, np.int64), np.full(size, -1, np.int64)
    value = np.array(values, np.int64)
    for group in sorted(groups, key=len, reverse=True):
        own = at[group]
        shift = next(s for s in range(size) if len(set(((own ^ s * 7919) & (size - 1)).tolist())) == len(own) and (entries[(own ^ s * 7919) & (size - 1)] < 0).all())
        shifts[int(bucket[group[0]])] = shift * 7919 & (size - 1)
        entries[(own ^ shift * 7919) & (size - 1)] = value[group]
    return spread, shifts, entries


def with_constants(df: DataFrame, **arrays: pa.Array) -> DataFrame:
    """df with the arrays as columns, the same in each row. A literal would be written out in every text of the plan that the
    driver keeps; the value of a subquery is in none. Binary values become strings, which may hold any bytes."""
    for name, a in arrays.items():
        table = df.sparkSession.createDataFrame(pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)}))
        df = df.withColumn(name, table.select(F.col(name).cast("array<string>") if a.type == pa.binary() else name).scalar())
    return df


def fold(df: DataFrame, path: str, words: str) -> DataFrame:
    """df with its column words array<array<long>>, the pairs of each word's bytes as rank << RANK_AT | left << 16 | right
    with 0 between, after all merges."""
    spread, shifts, entries = pair_table(path)
    size, none = len(entries), NO_RANK << RANK_AT

    def encode(tables: Column) -> Column:
        def ranked(keys: Column) -> Column:
            def found(key: Column) -> Column:
                h = key * F.lit(spread)
                shift = F.get(tables["shifts"], F.shiftright(h, 31).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int"))
                return F.get(tables["entries"], F.shiftright(h, 13).bitwiseXOR(shift).bitwiseAND(F.lit(size - 1)).cast("int"))

            return F.zip_with(keys, F.transform(keys, found), lambda key, entry: F.when(entry.bitwiseAND(F.lit(0xFFFFFFFF)) == key, entry).otherwise(key + F.lit(none)))

        def step(pairs: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                def at(k: Column) -> Column:
                    token = F.shiftright(least, RANK_AT)
                    left = F.get(pairs, k - 1).bitwiseAND(F.lit(0xFFFF0000))
                    right = F.get(pairs, k + 1).bitwiseAND(F.lit(0xFFFF))
                    new = ranked(F.array(left.bitwiseOR(token), F.shiftleft(token, 16).bitwiseOR(right)))
                    return F.flatten(F.array(F.slice(pairs, F.lit(1), k - 1), new, F.slice(pairs, k + 3, F.size(pairs))))

                return F.when(least >= F.lit(none), pairs).otherwise(bound(F.shiftright(least, PLACE_AT).bitwiseAND(F.lit(LONGEST + 1)).cast("int"), at))

            # array_position would end its search by an exception, which costs more than all the rest of a step.
            placed = F.transform(pairs, lambda pair, k: pair + F.shiftleft(k.cast("long"), PLACE_AT))
            return bound(F.array_min(placed), merge)

        return F.transform(F.col(words), lambda pairs: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(pairs) - 2, F.lit(1))), pairs, step))

    both = with_constants(df, **{SHIFTS: pa.array(shifts), ENTRIES: pa.array(entries)})
    return both.withColumn(words, bound(F.struct(F.col(SHIFTS).alias("shifts"), F.col(ENTRIES).alias("entries")), encode)).drop(SHIFTS, ENTRIES)


def window_starts(n: int, window: int) -> list[int]:
    """Where the windows of a word of n bytes begin: each half a window after the one before; the last ends the word."""
    return [*range(0, n - window, window // 2), n - window] if n > window else [0]


def merged_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What merging makes of a word, in about n log n steps, by a queue of pairs over linked pieces."""
    stop = list(range(1, len(word) + 1))  # of the piece that starts here
    back = list(range(-1, len(word) - 1))
    queue = [(ranks[word[i : i + 2]], i, i + 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(queue)
    gone = bytearray(len(word))
    while queue:
        _, i, end = heapq.heappop(queue)
        middle = stop[i]
        if gone[i] or middle >= len(word) or stop[middle] != end or gone[middle]:
            continue
        gone[middle], stop[i] = 1, end
        if end < len(word):
            back[end] = i
            if (pair := word[i : stop[end]]) in ranks:
                heapq.heappush(queue, (ranks[pair], i, stop[end]))
        if (j := back[i]) >= 0 and (pair := word[j:end]) in ranks:
            heapq.heappush(queue, (ranks[pair], j, end))
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : stop[i]]])
        i = stop[i]
    return out


def spliced(parts: list[np.ndarray], starts: list[int], sizes: np.ndarray) -> np.ndarray | None:
    """The ids of a word from those of its windows, None where two neighbours have no token in common at one place.

    A list of tokens is a word's encoding if every two neighbours in it are the encoding of their bytes. Those of a window
    are; a token that two windows share has its left neighbour in one and its right one in the other.
    """
    edges = [start + np.concatenate([[0], np.cumsum(sizes[ids])]) for ids, start in zip(parts, starts, strict=True)]
    out, begin = [], 0
    for i in range(len(parts) - 1):
        common = np.intersect1d(edges[i], edges[i + 1], assume_unique=True)
        left, right = np.searchsorted(edges[i], common), np.searchsorted(edges[i + 1], common)
        shared = np.flatnonzero((np.diff(left) == 1) & (np.diff(right) == 1) & (left[:-1] >= begin))
        if not len(shared):
            return None
        at = shared[len(shared) // 2]
        out.append(parts[i][begin : left[at]])
        begin = int(right[at])
    return np.concatenate([*out, parts[-1][begin:]])


def byte_table(path: str) -> np.ndarray:
    """rank << RANK_AT | left << 16 | right of each pair of bytes, at 257 * left + right; 256 stands for an edge."""
    ranks = load_ranks(path)
    ids = np.array([*(ranks[bytes([b])] for b in range(256)), EDGE], np.int64)
    merges = np.full((257, 257), NO_RANK, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            merges[token[0], token[1]] = rank
    return (merges << RANK_AT | ids[:, None] << 16 | ids[None, :]).reshape(-1)


def byte_pairs(words: list[bytes], table: np.ndarray) -> pa.ListArray:
    """Per word, its pairs of byte tokens with their ranks, from an edge to an edge."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes + 2)
    flat = np.full(int(ends[-1]) if len(words) else 0, 256, np.int64)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = inner[ends - 2 - sizes] = False
    flat[inner] = np.frombuffer(b"".join(words), np.uint8)
    pairs = table[flat[:-1] * 257 + flat[1:]]
    pairs = np.delete(pairs, ends[:-1] - 1) if len(words) else pairs[:0]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)), pa.array(pairs, pa.int64()))


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a copy of twice its length or more, with room for n."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(len(a), n - len(a)), a.dtype)])


class Numbers(dict):
    """Words and their numbers, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def packed_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
    keep: list[str] | None = None,
    window: int | None = None,
    block_bytes: int = BLOCK,
    known_words: int = KNOWN,
) -> DataFrame:
    """The columns `keep` of df (None: all) and ids_col array<int>: the ids of each match of `pattern` in the text, encoded
    on its own; no special tokens.

    A null or empty text gives no ids; null ids, repeated rows and other columns stay as they are; a column of the name
    ids_col is replaced; an empty table gives no rows. Nothing is shuffled, but up to TOGETHER input partitions are one
    task: a pass in Python splits blocks of texts into words and lists each block's words that its task has not met before;
    the fold encodes those; another pass in Python, in the same task, puts the ids of the texts together. Lists are bounded
    by the block and known_words; whole texts count, a text longer than a block is one block. A word longer than `window` bytes (None: 256, or four times the
    longest token if that is more) is folded in windows that overlap by half and are joined where two share a token; where
    two share none, as in one letter written over and over, a queue of pairs merges the word in Python.
    """
    ranks, whole = load_ranks(ranks_path), unmerged(ranks_path)
    kept = [c for c in (df.columns if keep is None else keep) if c != ids_col]
    schema = small_batches(df).select(*kept).schema
    window = min(window or max(256, 4 * max(map(len, ranks))), LONGEST)
    held = df.sparkSession.sparkContext.broadcast(ranks)  # read only where windows share no token
    lengths = np.zeros(max(ranks.values()) + 1, np.int32)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    table = byte_table(ranks_path)
    text = "\ttext"  # apart from the columns kept

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(SAME.get(pattern, pattern)).findall
        number = Numbers()
        for part in pieces(batches, text, block_bytes):
            afresh = len(number) > known_words
            if afresh:
                number.clear()
            before = len(number)
            places, ends = [], [0]
            for t in part.column(text).to_pylist():
                places.extend(map(number.__getitem__, find(t) if t else []))
                ends.append(len(places))
            new = [w.encode() for w in islice(reversed(number), len(number) - before)][::-1]
            long = [(i, w) for i, w in enumerate(new) if len(w) > window]
            given = [(i, whole[w]) for i, w in enumerate(new) if w in whole] if whole else []
            short = [w if len(w) <= window else b"" for w in new]
            short += [w[s : s + window] for _, w in long for s in window_starts(len(w), window)]
            columns = [
                pa.array([[int(afresh), len(new)]], pa.list_(pa.int64())),
                pa.array([[x for i, w in long for x in (i, len(w))] + [x for i, rank in given for x in (i, -1 - rank)]], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), byte_pairs(short, table)),
                *(pa.array([x], pa.binary()) for x in (pack(np.array(places, np.int64)), np.array(ends, np.int64).tobytes(), packed_rows(part.select(kept)))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["head", "long", "words", "places", "ends", "rows"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends_of, known, used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                afresh, new = batch.column("head")[i].as_py()
                if afresh:
                    known = used = 0
                lists = batch.column("words").slice(i, 1).flatten()
                pairs = lists.flatten().to_numpy(zero_copy_only=False)
                count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                inner = np.ones(len(pairs), bool)
                inner[np.cumsum(count) - count] = False  # the pair of the edge and the first token
                values, count = ((pairs >> 16) & 0xFFFF)[inner].astype(np.int32), count - 1
                long = batch.column("long")[i].as_py()
                if long:
                    each = np.split(values, np.cumsum(count)[:-1]) if len(count) else []
                    at = new
                    for k, size in zip(long[::2], long[1::2], strict=True):
                        if size < 0:
                            each[k] = np.array([-1 - size], np.int32)
                            continue
                        starts = window_starts(size, window)
                        each[k] = joined(each[at : at + len(starts)], starts, size)
                        at += len(starts)
                    each = each[:new]
                    values, count = np.concatenate(each) if each else values[:0], np.array([len(x) for x in each], np.int64)
                ids, ends_of = grown(ids, used + len(values)), grown(ends_of, known + new)
                ids[used : used + len(values)] = values
                ends_of[known : known + new] = used + np.cumsum(count)
                known, used = known + new, used + len(values)
                places = unpack(batch.column("places")[i].as_py())[0].astype(np.int64)
                ends = np.frombuffer(batch.column("ends")[i].as_py(), np.int64)
                start = np.where(places > 0, ends_of[places - 1], 0)
                count = ends_of[places] - start
                stop = np.concatenate([[0], np.cumsum(count)])
                out = ids[np.arange(stop[-1]) - np.repeat(stop[:-1] - start, count)]
                rows = pa.ipc.open_stream(batch.column("rows")[i].as_py()).read_next_batch()
                lists = pa.ListArray.from_arrays(pa.array(stop[ends].astype(np.int32)), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), lists], [*kept, ids_col])

    def joined(parts: list[np.ndarray], starts: list[int], size: int) -> np.ndarray:
        word = spliced(parts, starts, lengths)
        if word is not None:
            return word
        token = {rank: t for t, rank in held.value.items()}
        cuts = zip(parts, np.diff([*starts, size]).tolist(), strict=True)
        return np.array(merged_word(b"".join(b"".join(map(token.__getitem__, x.tolist()))[:step] for x, step in cuts), held.value), np.int32)

    rows = df.select(*kept, F.col(text_col).alias(text))
    # A word is folded once in a task, so a task of more input folds fewer words in all.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // TOGETHER))
    blocks = rows.coalesce(tasks).mapInArrow(released(split), "head array<long>, long array<long>, words array<array<long>>, places binary, ends binary, rows binary")
    return fold(blocks, ranks_path, "words").mapInArrow(released(join), schema.add(ids_col, ArrayType(IntegerType())))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col binary: the bytes of the ids' tokens, one after the other; a null list gives null."""
    ranks = load_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    joined = bound(F.col(TOKENS), lambda t: F.array_join(F.transform(F.col(ids_col), lambda i: F.get(t, i)), "").cast("binary"))
    return with_constants(df, **{TOKENS: pa.array(tokens, pa.binary())}).withColumn(out_col, F.when(F.col(ids_col).isNotNull(), joined)).drop(TOKENS)
