"""Word shingles of whole batches of texts as 64-bit hashes, by array passes over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import utf8_buffer

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20240229)
_OF_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) of all texts in order, and the first word of each text.

    A word's hash is a polynomial over random 64-bit values of its bytes, read off running sums, then mixed.
    """
    raw, ends = utf8_buffer(column)
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True  # a text's start also ends the word before it
    starts = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])[: len(raw)]))
    edge[:-1] |= space
    edges = np.flatnonzero(edge)
    stops = edges[np.searchsorted(edges, starts, "right")]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_OF_BYTE[_FOLD[raw]] * powers(_BASE, len(raw))[:-1], out=sums[1:])
    words = (sums[stops] - sums[starts]) * powers(_INVERSE, len(raw))[starts]
    words = mixed(words ^ ((stops - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
    return words, np.searchsorted(starts, ends)


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and where each text's begin.

    A text with fewer than `width` words, but at least one, has its whole word sequence as its one shingle.
    """
    words, first = word_hashes(column)
    count = np.diff(first)
    n = len(count)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(n), made)
    begin = np.repeat(first[:-1], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    left = np.repeat(np.minimum(count, width), made)
    h = np.zeros(len(begin), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        h = np.where(k < left, mixed(h * np.uint64(0x100000001B3) + padded[begin + k] + np.uint64(k + 1)), h)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(n + 1))
