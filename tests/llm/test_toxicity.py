import dataclasses
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellspark.llm import common, toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(240):
        text, bad = prose(rng, "en", 40), i % 6 == 0
        if bad:
            words = text.split()
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(["idiot", "moron", "loser"])
            text = " ".join(words)
        rows.append((i, text, 1, 2))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int, turn int")
    labels = spark.createDataFrame([*marks, (0, 1), (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    return toxicity.fit_toxicity(docs, labels)


@pytest.mark.parametrize("said", ["what an idiot", "1d10t", "m o r o n", "i-d-i-o-t", "looooser!!", "l0s3r", "MORON.", "m.o.r.o.n", "id iot", "y o u i d i o t", "idiiot", "i d 1 o t", "los er", "l" + "o" * 90 + "ser"])
def test_disguised_words_are_caught(fitted, said):
    assert toxicity.score_text(f"they were there when {said} came", fitted) >= 0.5


@pytest.mark.parametrize("said", ["1d10t", "m o r o n", "i-d-i-o-t", "l0s3r", "id iot", "y o u i d i o t", "idiiot"])
def test_only_restoration_catches_disguises(fitted, said):
    """With restoration switched off, the same weights miss them."""
    plain = dataclasses.replace(fitted, restore=False, known={})
    text = f"they were there when {said} came"
    assert toxicity.score_text(text, fitted) >= 0.5 > toxicity.score_text(text, plain)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="idot10 !lx", min_size=1, max_size=7))
def test_viterbi_is_the_best_of_all_paths(fitted, token):
    def cost(said):
        words = said.split(" ")
        total = 0.0
        for i, w in enumerate(words):
            for x, y in zip("^" + w, w + "$" if w else "", strict=False):
                total += fitted.pairs.get(x + y, fitted.unseen)
        return total

    paths = [("", 0.0)]
    for place in toxicity.lattice(token):
        paths = [(said + x, charge + c) for said, charge in paths for x, c in place]
    best = min(charge + cost(said) for said, charge in paths)
    got = toxicity.restored(token, fitted)
    assert min(charge for said, charge in paths if said == got) + cost(got) == pytest.approx(best)


@pytest.mark.parametrize("said", ["", "the people of the water", "12 34 56", "a b c d e f", "it!!! was### the%%%", "x" * 5000, "did iota of it", "a l s o", "y" * 200_000])
def test_clean_text_is_left_alone(fitted, said):
    assert toxicity.score_text(said, fitted) < 0.5


def test_rows(fitted, docs, plain, no_docs):
    got = toxicity.score_toxicity(docs, fitted).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in plain)
    assert all(r["predicted"] == int(r["score"] >= 0.5) == 0 for r in got)
    assert toxicity.keep_civil(docs, fitted).count() == len(plain)
    assert toxicity.score_toxicity(no_docs, fitted).count() == 0


def test_without_labels(spark, docs, no_docs):
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()} == {0}


def own_word(i):
    """A word that no other number has."""
    return "".join("bdfgklmnprstvz"[i // 14**k % 14] + "aeiou"[i // 5**k % 5] for k in range(4))


@pytest.fixture(scope="module")
def many(spark):
    """More than 4,000 texts of each label, no two alike but for nine copies of one; ids on both sides of nought."""
    rng = random.Random(4)
    rows = []
    for i in range(9000):
        words = [own_word(9000 * k + i) for k in range(3)]
        if i < 4400:
            words += ["zonk"] * (i % 2) + ["wibble"] * (i % 500 == 0)
        else:
            words += ["wibble"] * (i % 900 == 0) + ["splat"] * (i % 3 == 0)
        rng.shuffle(words)
        rows.append((i - 4500, " ".join(words), int(i < 4400)))
    rows += [(9000 + i, "zonk and zonk of the same zonk once more", 1) for i in range(9)]
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in rows], (20_000, "without a label"), (None, "without an id")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, m) for i, _, m in rows], "doc_id long, toxic int"), rows


def test_the_model_comes_from_all_labelled_texts(many):
    """Weights and the bar are those of counting every text, with one reading of the rules and no tables of bits."""
    docs, labels, rows = many
    model = toxicity.fit_toxicity(docs, labels)
    plain = toxicity.ToxicityModel({}, model.pairs, model.unseen, 0.0)
    seen, total = (Counter(), Counter()), [0.0, 0.0]
    for i, text, mark in rows:
        share = 1 / 9 if i >= 9000 else 1.0
        total[mark] += share
        for f in toxicity.present(text, plain, {}, None):
            seen[mark][f] += share
    p, expected = total[1] / sum(total), {}
    for f, bad in seen[1].items():
        good = seen[0][f]
        q = bad / (bad + good)
        gain = bad * math.log(q / p) + (good * math.log((1 - q) / (1 - p)) if good else 0)
        ratio = math.log((bad + 0.5) / (total[1] + 1) / ((good + 0.5) / (total[0] + 1)))
        if bad >= 3 and gain > 12 and ratio > 2.5:
            expected[f] = ratio
    assert {"zonk"} < expected.keys() and "wibble" not in expected
    assert model.weights == pytest.approx(expected, rel=1e-4)
    pairs = Counter()
    for i, text, _ in rows:
        for w in set(text.split()):
            for x, y in zip("^" + w, w + "$", strict=True):
                pairs[x + y] += 1 / 9 if i >= 9000 else 1
    costs, unseen = toxicity.letter_pairs(pairs)
    assert model.pairs == pytest.approx(costs, rel=1e-4) and model.unseen == pytest.approx(unseen, rel=1e-4)
    reached = [(toxicity.evidence(t, model), (1 if m else -2) * (1 / 9 if i >= 9000 else 1)) for i, t, m in rows]
    caught = {b / 2: round(sum(n for z, n in reached if z >= b / 2), 3) for b in range(4, 17)}
    assert caught[-model.offset] == max(caught.values())


def test_no_labelled_text_is_left_out(many):
    """Copies share the count of one text, all other texts count whole."""
    docs, labels, rows = many
    marks = labels.select("doc_id", labels.toxic.alias("mark"))
    got = toxicity.labelled_texts(common.texts(docs, "doc_id", "text"), marks).collect()
    assert Counter((r["text"], r["mark"], r["units"]) for r in got) == Counter((t, m, toxicity.ONE // 9 if i >= 9000 else toxicity.ONE) for i, t, m in rows)


def test_pairs_of_all_letters_count():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab жб", "", "ab é"]), pa.array([2, 1, 3])], ["text", "units"])
    (got,) = toxicity.counted_pairs(iter([batch]))
    found = dict(zip(*(c.to_pylist() for c in got.columns), strict=True))
    other = toxicity.OTHER
    assert found == {"^a": 5, "ab": 5, "b$": 5, "^" + other: 2, other * 2: 2, other + "$": 2, "^é": 3, "é$": 3}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="idotlж", min_size=1, max_size=9))
def test_letters_alone_are_restored_as_viterbi_does(fitted, word):
    """The short way for words without signs against all paths."""
    paths = [("", 0.0)]
    for place in toxicity.lattice(word):
        paths = [(said + x, charge + c) for said, charge in paths for x, c in place]

    def cost(path):
        w = toxicity.latin(path[0])
        return path[1] + sum(fitted.pairs.get(x + y, fitted.unseen) for x, y in zip("^" + w, w + "$", strict=True))

    got = toxicity.restored(word, fitted)
    assert min(cost(p) for p in paths if p[0] == got) == pytest.approx(min(map(cost, paths)))
