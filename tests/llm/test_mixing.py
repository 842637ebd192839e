from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellspark.llm import mixing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.01, 50), min_size=1, max_size=12))
def test_less_than_one_block_from_the_target(weights):
    parts = mixing.shares(weights, 64)
    assert sum(parts) == max(64, len(weights)) and min(parts) >= 1
    assert mixing.deviation(parts, mixing.pfair_period(parts)) < 1


def brute_force(blocks, weights):
    """Slot by slot, starting a new schedule whenever a source ends."""
    served, out = [0] * len(blocks), []
    while any(s < b for s, b in zip(served, blocks)):
        alive = [i for i in range(len(blocks)) if served[i] < blocks[i]]
        turn = mixing.pfair_period(mixing.shares([weights[i] for i in alive]))
        slot = 0
        while all(served[i] < blocks[i] for i in alive):
            i = alive[turn[slot % len(turn)]]
            out.append((i, served[i]))
            served[i] += 1
            slot += 1
    return out


def test_mixture_matches_brute_force(docs):
    got = mixing.mix_sources(docs, block_rows=3, weights={"hot": 2.0, "s1": 5.0}, bucket_rows=8).collect()
    assert sorted(r["place"] for r in got) == list(range(docs.count()))
    counts = {}
    for r in got:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    want = brute_force([-(-counts[s] // 3) for s in names], [{"hot": 2.0, "s1": 5.0}.get(s, 1.0) for s in names])
    slots = sorted({(r["slot"], r["source"], r["block"]) for r in got}, key=lambda x: x[0])
    assert [(names.index(s), b) for _, s, b in slots] == want
    assert [r["slot"] for r in sorted(got, key=lambda r: r["place"])] == sorted(r["slot"] for r in got)


def test_empty(no_docs):
    assert mixing.mix_sources(no_docs).count() == 0


def worst(weights, turns):
    """The greatest distance of a source, in blocks, from its share by the weights given, over all slots."""
    total, got, out = sum(map(Fraction, weights)), [0] * len(weights), Fraction(0)
    for slot, i in enumerate(turns, 1):
        # Between its own slots a source falls back steadily, so the slots before and of each service bound it.
        share = Fraction(weights[i]) / total
        out = max(out, abs(share * (slot - 1) - got[i]), abs(share * slot - got[i] - 1))
        got[i] += 1
    return max(out, *(abs(Fraction(w) / total * len(turns) - g) for w, g in zip(weights, got)))


@pytest.mark.parametrize("weights", [[0.999, 0.001], [0.5] + [0.025] * 20, [0.5] + [0.5 / 1499] * 1499, [1e-9, 1.0, 2**0.5]])
def test_less_than_one_block_from_the_weights_given(weights):
    blocks = [60_000 // len(weights)] * len(weights)
    turns, ends = mixing.schedule(blocks, weights)
    assert len(turns) == sum(blocks) and len(ends) == len(weights)
    assert worst(weights, turns[: ends[0] + 1].tolist()) < 1


def test_many_sources_keep_their_weights(spark):
    rows = [(i, "x", "big") for i in range(1200)] + [(2000 + 2 * i + c, "x", f"s{i:04}") for i in range(1200) for c in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, block_rows=1, weights={"big": 1200.0}).collect()
    assert sorted(r["place"] for r in got) == sorted(r["slot"] for r in got) == list(range(len(rows)))
    assert abs(sum(r["source"] == "big" for r in got if r["place"] < 1000) - 500) < 1
