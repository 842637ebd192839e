"""Cross-entropy difference: a target and a background n-gram model over one vocabulary score every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, PARTS, as_rows, batched, blocks, by_part, grouped, name_of, own_row, pack, packed, part_count, returned, steady, unpack, unpacked
from .common import pieces, released, texts, written
from .shingles import mixed, word_hashes

#: Hashes that stand for a text's start and its end, which are no words.
START, END = np.uint64(0x9B1D5E2F7C3A4860), np.uint64(0x51A7C0FFEE12D3B5)
#: So many ids of target rows (8 bytes each) may go to every task; more are joined.
MOST_IDS = 1 << 22
#: Rows are counted in both models, in the background only, or in none.
BOTH, BACKGROUND, NEITHER = 2, 1, 0


def texts_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of few MB at a time, as it needs many bytes for each of the text."""
    some = [word_hashes(part.column(0)) for part in pieces([pa.RecordBatch.from_arrays([column], ["text"])], most=1_500_000)]
    first = np.concatenate([[0], *(f[1:] - f[:-1] for _, f in some)]) if some else np.zeros(1, np.int64)
    return np.concatenate([w for w, _ in some]) if some else np.zeros(0, np.uint64), np.cumsum(first)


def bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, one after another: the distinct keys of words and of word pairs, ascending; where among them each
    token's pair, its own word and the word before it are; and the first token of each text. A key is a 64-bit hash, odd
    for words. A text's last token is END; the word before its first one is START, whose count is that of END."""
    words, first = texts_hashes(column)
    n = len(first) - 1
    ends = first[1:] + np.arange(n)  # each text gets one token more
    then = np.insert(words, first[1:], END)
    before = np.concatenate([np.zeros(1, np.uint64), then[:-1]])
    starts = np.concatenate([[0], ends[:-1] + 1]) if n else np.zeros(0, np.int64)
    before[starts] = START
    pair = mixed(mixed(before) * np.uint64(0x9E3779B97F4A7C15) + then) & ~np.uint64(1)
    own = mixed(then) | np.uint64(1)
    keys, at = np.unique(np.concatenate([pair, own]), return_inverse=True)
    pair_at, own_at = at[: len(pair)], at[len(pair) :]
    context = np.concatenate([own_at[:1], own_at[:-1]])
    context[starts] = own_at[ends]
    return keys, pair_at, own_at, context, np.append(starts, len(then))


def smoothed(pair: np.ndarray, own: np.ndarray, context: np.ndarray, total: int, types: int, strength: float) -> np.ndarray:
    """The loss of a word after another from counts: the pair's, with `strength` counts spread as the words' own, those
    with one count added to each type and to the one type for all others. Over all types, probabilities sum to 1."""
    return np.log(context + strength) - np.log(pair + strength * (own + 1) / (total + types + 1))


def marked(docs: DataFrame, target: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """docs with `side`, and target ids that the tasks look up themselves (None: side says it all)."""
    ids = target.where("doc_id IS NOT NULL").distinct()
    if ids.count() <= MOST_IDS:
        return docs, np.sort(ids.toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64))
    chosen = ids.select("doc_id", F.lit(0).alias("deal"), F.lit(True).alias("of_target"))
    # Null ids are of no target; `deal` spreads them over the tasks.
    dealt = docs.withColumn("deal", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 16)).cast("int")).otherwise(0))
    joined = dealt.join(chosen.hint("merge"), ["doc_id", "deal"], "left")
    side = F.when((F.col("side") == BACKGROUND) & F.coalesce("of_target", F.lit(False)), F.lit(BOTH)).otherwise(F.col("side"))
    return written(joined.select("doc_id", "text", side.alias("side")), "lm-marked"), None


def cross_entropy_difference(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    uncounted: DataFrame | None = None,
    strength: float = 16.0,
    block_bytes: int = BLOCK,
) -> DataFrame:
    """Returns doc_id, n_tokens, target_loss, background_loss and score, one row per row of df and of `uncounted`.

    Two bigram models of one order, one smoothing and one vocabulary, all words of df: the background counts every row of
    df, the target those whose id is in `target` (null and repeated ids there count nothing more). Rows of `uncounted` are
    scored, not counted; their unknown words share one type. Words are as the tokens of shingles: white space parts them,
    A-Z is lower-cased. Each word and each pair has its own count, under a 64-bit hash.

    Losses are nats per token of the whole text, its end included, so an empty or null text has one token. The score is
    the mean over tokens of target loss less background loss: the lower, the more like the target. Null ids are scored and
    of no target; repeated rows are counted each and get equal scores; an empty table gives no rows; other columns are not
    carried.

    Blocks of texts list their pairs and words; each part of the keys is added up once and sent back to the blocks, whose
    texts are read again to meet them. Keys, counts and texts move packed. Counts grow with the input, without a cap.
    """
    docs = texts(df, id_col, text_col, F.lit(BACKGROUND).alias("side"))
    if uncounted is not None:
        docs = docs.union(texts(uncounted, id_col, text_col, F.lit(NEITHER).alias("side")))
    docs, held = marked(docs, target.select(F.col(id_col).cast("long").alias("doc_id")))
    ids = df.sparkSession.sparkContext.broadcast(held)  # of checked size
    docs = steady(docs)
    parts = part_count(docs)
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)

    def sides(batch: pa.RecordBatch) -> np.ndarray:
        side = batch.column("side").to_numpy()
        if ids.value is None or not len(ids.value):
            return side
        known = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids.value, known), len(ids.value) - 1)
        of_target = (ids.value[at] == known) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        return np.where((side == BACKGROUND) & of_target, BOTH, side)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes, bytes]]:
            for batch in blocks(batches, "text", block_bytes):
                keys, pair, own, _, starts = bigrams(batch.column("text"))
                side = np.repeat(sides(batch), np.diff(starts))
                t, g = (sum(np.bincount(x, side >= least, len(keys)) for x in (pair, own)) for least in (BOTH, BACKGROUND))
                cut, name = [0, *np.searchsorted(keys, edges).tolist(), len(keys)], name_of(batch.column("text"))
                for p in range(parts):
                    s = slice(cut[p], cut[p + 1])
                    yield p, name, pack(np.diff(keys[s], prepend=np.uint64(0)), t[s], g[s])

        yield from batched(rows())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes, bytes]]:
            for p, (names, payloads) in grouped(batches, "part", ["block", "payload"]):
                asked = [unpack(x) for x in payloads]
                keys, at = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in asked]), return_inverse=True)
                t, g = (np.bincount(at, np.concatenate([x[i] for x in asked]), len(keys)).astype(np.int64) for i in (1, 2))
                words = (keys & np.uint64(1)).astype(bool)
                yield p, b"", np.array([t[words].sum(), g[words].sum(), (words & (g > 0)).sum()], np.int64).tobytes()
                stop = np.cumsum([0, *(len(k) for k, _, _ in asked)])
                for i, name in enumerate(names):
                    own = at[stop[i] : stop[i + 1]]
                    yield p, name, pack(t[own], g[own])

        yield from batched(rows())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", block_bytes):
            rows = batch.select(["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            yield as_rows([own_row(name_of(batch.column("text")), parts, packed(sink.getvalue().to_pybytes()))])

    answers = written(by_part(docs.mapInArrow(released(ask), PARTS), parts).mapInArrow(released(answer), PARTS), "lm-counts")
    sums = np.zeros(3, np.int64)
    for row in answers.where(F.octet_length("block") == 0).select("payload").toLocalIterator():  # one a part
        sums += np.frombuffer(bytes(row["payload"]), np.int64)
    in_target, in_all, types = sums.tolist()

    def finish(answered: list[bytes], payload: bytes) -> Iterator[pa.RecordBatch]:
        rows = pa.ipc.open_stream(unpacked(payload)).read_next_batch()
        _, pair, own, context, starts = bigrams(rows.column("text"))
        n, counts = np.diff(starts), [unpack(x) for x in answered]
        losses = []
        for side, total in ((0, in_target), (1, in_all)):
            count = np.concatenate([c[side] for c in counts]).astype(float)
            each = smoothed(count[pair], count[own], count[context], total, types, strength)
            losses.append(np.add.reduceat(each, starts[:-1]) / n if len(n) else each)
        columns = [rows.column("doc_id"), pa.array(n.astype(np.int64)), *map(pa.array, losses), pa.array(losses[0] - losses[1])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return returned(answers.where(F.octet_length("block") > 0), docs.mapInArrow(released(keep), PARTS), finish, schema)
