import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellspark.llm import jaccard
from cellspark.llm.components import connected
from cellspark.llm.shingles import shingle_hashes

COLUMNS = ["doc_id", "n_shingles", "component_id"]


def word_sets(rows, width):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        yield i, {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute_force(rows, width, percent):
    sets = list(word_sets(rows, width))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_matches_brute_force(docs, plain, width, percent):
    got = jaccard.ngram_jaccard_join(docs, width=width, percent=percent, cell_bits=12).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute_force(plain, width, percent)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nAbcdé", max_size=40), min_size=1, max_size=6), st.integers(1, 5))
def test_shingle_counts(texts, width):
    hashes, first = shingle_hashes(pa.array(texts, pa.string()), width)
    assert list(np.diff(first)) == [len(s) for _, s in word_sets(enumerate(texts), width)]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(20, 400), st.integers(50, 95))
def test_linked_sets_share_a_signature(seed, n, percent):
    """Whatever the ranks, two sets that are alike enough have a signature in common."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    free = n * (100 - percent) // percent
    extra = rng.integers(0, 1 << 63, int(rng.integers(0, free + 1)), dtype=np.uint64)
    at = int(rng.integers(0, len(extra) + 1))
    a, b = np.unique(np.concatenate([common, extra[:at]])), np.unique(np.concatenate([common, extra[at:]]))
    ranks = rng.integers(0, 60, 4096).astype(np.uint8)
    signs = [set(jaccard.signatures(x, ranks[(x >> np.uint64(51)).astype(int)], (20, 40), percent).tolist()) for x in (a, b)]
    assert 100 * len(set(a.tolist()) & set(b.tolist())) < percent * len(set(a.tolist()) | set(b.tolist())) or signs[0] & signs[1]


def edited(words, rng, edits):
    out = list(words)
    for _ in range(edits):
        out[int(rng.integers(len(out)))] = f"w{rng.integers(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def crowded(spark):
    """Near copies with 0 to 5 edits, near both sides of the threshold; ids that repeat with other texts, and null ids."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(4):
        words = [f"g{g}x{rng.integers(10**6)}" for _ in range(60 + 40 * g)]
        rows += [(1000 * g + i, edited(words, rng, i % 6)) for i in range(60)]
        rows += [(1000 * g + 7, edited(words, rng, 30)), (None, edited(words, rng, 2)), (None, edited(words, rng, 40))]
    rows += [(5, "a text that is nothing like the other one of its id " * 3), (5, rows[70][1]), (7000, rows[5][1]), (None, rows[5][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_near_copies_and_shared_ids(crowded, width, percent, monkeypatch):
    rows, frame = crowded
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "VERY_FREQUENT", 30)
    expected = brute_force(list(enumerate(t for _, t in rows)), width, percent)
    least = {}
    for (at, _, comp), (i, _) in zip(expected, rows, strict=True):
        least[comp] = min((x for x in (least.get(comp), i) if x is not None), default=None)
    wanted = sorted(((rows[at][0], n, least[comp]) for at, n, comp in expected), key=str)
    got = jaccard.ngram_jaccard_join(frame, width=width, percent=percent, cell_bits=16).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == wanted


def test_combinations_carry_links():
    """Of linked near copies of a large group, some share no rare token, only combinations of frequent ones."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    ranks = np.full(len(base), 50, np.uint8)
    signs = []
    for _ in range(20):
        kept = rng.permutation(len(base))[: len(base) - 8]
        new = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
        signs.append(set(jaccard.signatures(np.concatenate([base[kept], new]), np.concatenate([ranks[kept], np.full(8, 8, np.uint8)]), (20, 60), 85).tolist()))
    single = set(jaccard.mixed(base).tolist())
    assert all(a & b and not (a & b & single) for a in signs for b in signs if a is not b)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (300, 300)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected(edges).collect()}
    assert got == {**dict.fromkeys(range(71), 0), 200: 200, 201: 200, 300: 300}


def test_empty(no_docs):
    assert jaccard.ngram_jaccard_join(no_docs).count() == 0
