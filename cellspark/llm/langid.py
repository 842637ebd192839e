"""Language identification by nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, released, small_batches, texts, utf8_buffer

#: Hash buckets of the byte trigrams; rows of a block of counts.
DIMS, ROWS = 8192, 256

_FOLD = np.full(256, 32, np.uint8)  # lower-case letters and bytes over 127 stand for themselves, the rest for a space
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class LanguageModel:
    """Unit centroids (rows), the language and the least similarity of each, and the inverse document frequencies."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def trigram_counts(column: pa.Array) -> np.ndarray:
    """Per text, how often each hashed trigram of its folded UTF-8 bytes occurs; whole texts, one array pass."""
    raw, ends = utf8_buffer(column)
    n = len(ends) - 1
    if len(raw) < 3:
        return np.zeros((n, DIMS), np.float32)
    data = _FOLD[raw]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] <= 0x9E)) + 1  # Latin capitals with accents
    data[upper] |= 0x20
    wide = data.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    cell = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    sizes = np.diff(ends)
    row = np.repeat(np.arange(n), sizes)[: len(cell)]
    last = np.repeat(ends[1:], sizes)[: len(cell)] - 2  # a trigram must end within its text
    inside = (np.arange(len(cell)) < last) & (code != 0x202020)
    counts = np.bincount(row[inside] * DIMS + cell[inside], minlength=n * DIMS)
    return counts.reshape(n, DIMS).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def for_length(similar: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Similarity over what the text's length lets expect: below 200 trigrams it falls with the root of their number."""
    return similar / np.sqrt(np.clip(counts.sum(1), 1, 200) / 200)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first centres."""
    picked = [int(np.argmax(rows @ rows.mean(0)))]
    while len(picked) < min(k, len(rows)):
        near = (rows @ rows[picked].T).max(1)
        if near.min() > 0.9999:
            break
        picked.append(int(np.argmin(near)))
    centres = rows[picked]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(1)
        sums = np.stack([rows[own == i].sum(0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = unit(sums)
    return centres


def fit_languages(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    centroids: int = 4,
    margin: float = 0.5,
) -> LanguageModel:
    """Learn from at most per_language texts of each language, those whose hashed id is least; their trigram
    counts (some kB each) go to the driver. Texts without a language, or without text, don't count. A language rejects what is
    less similar to its nearest centroid, for its length, than `margin` times its least similar training text."""
    rows = texts(labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col, F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel((), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0), np.ones(DIMS, np.float32))
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in counts.items():  # twice the share, as a hash doesn't hit it exactly
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * per_language / n + 20 / n))).otherwise(share)
    few = rows.withColumn("turn", turn).where(F.col("turn") <= share)
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc_id", F.xxhash64("text"))))
    few = few.where(F.col("place") <= per_language).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                counted = trigram_counts(part.column("text"))
                cells = [np.flatnonzero(v) for v in counted]
                columns = [part.column("lang"), *(pa.array([x.tobytes() for x in out], pa.binary()) for out in ([c.astype(np.uint16) for c in cells], [v[c] for v, c in zip(counted, cells, strict=True)]))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "cells", "n"])

    got = sorted((r["lang"], bytes(r["cells"]), bytes(r["n"])) for r in few.mapInArrow(released(vectors), "lang string, cells binary, n binary").collect() if r["cells"])
    seen = np.zeros(DIMS)
    for _, cells, _ in got:
        seen[np.frombuffer(cells, np.uint16)] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 0.1).astype(np.float32)
    languages = tuple(sorted(counts))
    centres, owner, least = [np.zeros((0, DIMS), np.float32)], [np.zeros(0, int)], [np.zeros(0)]
    for i, lang in enumerate(languages):  # dense for one language at a time
        own = [x for x in got if x[0] == lang]
        if not own:
            continue
        tf = np.zeros((len(own), DIMS), np.float32)
        for row, (_, cells, n) in zip(tf, own, strict=True):
            row[np.frombuffer(cells, np.uint16)] = np.frombuffer(n, np.float32)
        vec = unit(np.sqrt(tf) * idf)
        centres.append(cluster(vec, centroids).astype(np.float32))
        owner.append(np.full(len(centres[-1]), i))
        least.append(np.full(len(centres[-1]), margin * for_length((vec @ centres[-1].T).max(1), tf).min()))
    return LanguageModel(languages, np.concatenate(centres), np.concatenate(owner), np.concatenate(least), idf)


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text (no nulls): the language (`und` without a letter), the cosine with the nearest centroid, whether rejected."""
    n = len(column)
    letters = np.array([has_letter(t) for t in column.to_pylist()], bool) if n else np.zeros(0, bool)
    if not len(model.centroids):
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    counts = trigram_counts(column)
    like = unit(np.sqrt(counts) * model.idf) @ model.centroids.T
    best = like.argmax(1)
    near = like[np.arange(n), best].astype(float)
    lang = [model.languages[model.owner[b]] if ok else "und" for b, ok in zip(best, letters, strict=True)]
    return lang, np.clip(near, 0, 1) * letters, ~letters | (for_length(near, counts) < model.least[best])


def identify_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected, one row per row of df.

    Only the text decides. A null text, an empty one or one without a letter is `und`, 0 and rejected. Equal
    similarities go to the language first in order. Repeated rows get equal results; other columns are not carried.
    Without any labelled text the model knows no language and all is `und`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces([batch], rows=ROWS):
                lang, score, no = predict(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(no)], ["doc_id", "lang_pred", "score", "rejected"])

    return texts(df, id_col, text_col).mapInArrow(released(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that the model doesn't reject; no shuffle. A model without languages keeps all."""
    if not len(model.centroids):
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces([batch], text_col, rows=ROWS):
                column = part.column(text_col).fill_null("")
                yield part.filter(pa.array(~predict(model, column)[2]))

    return small_batches(df).mapInArrow(released(run), df.schema)
