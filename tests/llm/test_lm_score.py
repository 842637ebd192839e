import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellspark.llm import blocks, lm_score

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TARGET = [1, 2, 4, 4, None, 999]


def tokens(text):
    return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), "</s>"]


def counted(rows):
    one, two = Counter(), Counter()
    for _, t in rows:
        one.update(tokens(t)[1:])
        two.update(zip(tokens(t), tokens(t)[1:]))
    one["<s>"] = one["</s>"]
    return one, two


def probability(a, b, side, types, strength):
    one, two = side
    total = sum(one.values()) - one["<s>"]
    return (two[a, b] + strength * (one[b] + 1) / (total + types + 1)) / (one[a] + strength)


def brute_force(plain, scored, strength):
    sides = [counted([x for x in plain if x[0] in (1, 2, 4)]), counted(plain)]
    types = len(sides[1][0]) - ("<s>" in sides[1][0])
    out = Counter()
    for d, t in scored:
        x = tokens(t)
        loss = [sum(-math.log(probability(a, b, s, types, strength)) for a, b in zip(x, x[1:])) / (len(x) - 1) for s in sides]
        out[d, len(x) - 1, round(loss[0], 6), round(loss[1], 6)] += 1
    return out, sides, types


def losses(frame):
    return Counter((r["doc_id"], r["n_tokens"], round(r["target_loss"], 6), round(r["background_loss"], 6)) for r in frame.collect())


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(i,) for i in TARGET], "doc_id long")


def test_losses_match_brute_force(docs, plain, target, monkeypatch):
    got = losses(lm_score.cross_entropy_difference(docs, target, strength=3.0))
    want, _, _ = brute_force(plain, plain, 3.0)
    assert got == want
    monkeypatch.setattr(lm_score, "MOST_IDS", 0)  # the target is joined instead
    assert losses(lm_score.cross_entropy_difference(docs, target, strength=3.0)) == want


def test_many_small_blocks_and_rows_not_counted(spark, docs, plain, target):
    more = [(9000, "the of never seen words"), (9001, None), (None, "and to in")]
    frame = spark.createDataFrame(more, "doc_id long, text string")
    got = losses(lm_score.cross_entropy_difference(docs, target, uncounted=frame, block_bytes=300))
    assert got == brute_force(plain, plain + more, 16.0)[0]


def test_probabilities_sum_to_one(plain):
    _, sides, types = brute_force(plain, [], 16.0)
    words = [w for w in sides[1][0] if w != "<s>"] + ["a word that no text has"]
    for side in sides:
        for a in ["<s>", "the", "der", "of", "a word that no text has"]:
            assert sum(probability(a, b, side, types, 16.0) for b in words) == pytest.approx(1.0)


def test_target_is_preferred(spark):
    rows = [(i, "apples and pears " * 5 if i % 2 else "stocks and bonds " * 5) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i,) for i in range(1, 20, 2)], "doc_id long")
    score = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(frame, chosen).collect()}
    assert max(score[i] for i in range(1, 40, 2)) < min(score[i] for i in range(0, 40, 2))


def test_empty(spark, no_docs):
    assert lm_score.cross_entropy_difference(no_docs, no_docs.select("doc_id")).count() == 0
    lone = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {(r["n_tokens"], r["score"] == r["score"]) for r in lm_score.cross_entropy_difference(lone, lone.select("doc_id")).collect()} == {(1, True)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1) | st.integers(0, 300), max_size=50))
def test_pack(values):
    a = np.array(values, np.uint64)
    assert [x.tolist() for x in blocks.unpack(blocks.pack(a, a[:3]))] == [values, values[:3]]


def test_blocks_keep_all_rows():
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(["x" * (i * 7 % 50) if i % 5 else None for i in range(k, k + 40)], pa.string())}) for k in (0, 40)]
    got = list(blocks.blocks(iter(batches), "text", 120))
    assert sum((b.column("text").to_pylist() for b in got), []) == sum((b.column("text").to_pylist() for b in batches), [])
    assert all(sum(len(t or "") for t in b.column("text").to_pylist()) < 120 + 50 for b in got) and len(got) > 5
