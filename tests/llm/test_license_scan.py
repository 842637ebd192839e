import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest

from cellspark.llm import license_scan


@pytest.fixture(scope="module")
def model(docs):
    return license_scan.fit_licenses(docs)


def test_templates_and_others(spark, model):
    rows = [(f"{f}{i}", i, t) for f, ts in license_scan.TEMPLATES.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame([(k, "first line\n" + t.upper() + "\nlast") for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: [(x["paragraph"], x["family"]) for x in r["licenses"]] for r in license_scan.scan_licenses(df, model).collect()}
    assert got == {k: [(1, name.rstrip("0123456789"))] for k, (name, _, _) in enumerate(rows)}


def test_unknown_and_odd_rows(spark, model, docs, no_docs):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a driving license is needed to drive"), (4, "my license to sing")], "doc_id long, text string")
    assert all(not r["licenses"] for r in license_scan.scan_licenses(df, model).collect())
    assert sum(len(r["licenses"]) for r in license_scan.scan_licenses(docs, model).collect()) == 0
    assert license_scan.scan_licenses(docs, model).count() == docs.count()
    assert license_scan.scan_licenses(no_docs, model).count() == 0


def test_plan_has_no_python(docs, model):
    plan = license_scan.scan_licenses(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def judged(text, model):
    """The best family of a reading, its probability and overlap, by the definition."""
    present = license_scan.features(text.lower())
    z = np.array(model.bias) + sum((np.array(w) for f, w in model.weights.items() if f in present), np.zeros(len(model.bias)))
    p = license_scan.softmax(z[None] / model.temperature)[0]
    family = model.classes[int(p.argmax())]
    overlap = max((sum(v for g, v in pairs.items() if g in present) / sum(pairs.values()) for f, pairs in model.pairs if f == family), default=0.0)
    return family, float(p.max()), overlap


def brute_force(text, model):
    """All readings in order, of any words, each judged; of one family the first of those that share lines."""
    lines = (text or "").lower().split("\n")
    spans = [(i, i) for i in range(len(lines))]
    if len(lines) > 1:
        spans += [(i, min(i + license_scan.WINDOW, len(lines)) - 1) for i in range(max(0, len(lines) - license_scan.WINDOW) + 1)]
    blank = [-1, *(i for i, p in enumerate(lines) if not re.search("[a-z0-9]", p)), len(lines)]
    spans += [(a + 1, b - 1) for a, b in zip(blank, blank[1:]) if b - a > 2]
    out = []
    for first, last in spans:
        family, p, overlap = judged(" ".join(lines[first : last + 1]), model)
        if family != "unknown" and p >= 0.5 and overlap >= 0.3 and not any(f == family and a <= last and first <= b for a, b, f, _, _ in out):
            out.append((first, last, family, p, overlap))
    return sorted((a, f, round(p, 5), round(o, 5)) for a, _, f, p, o in out)


def test_matches_brute_force(spark, model, docs):
    rng = random.Random(8)
    parts = [t for ts in license_scan.TEMPLATES.values() for t in ts] + [*license_scan.NOT_LICENSES, "", "the of and", "12"]
    rows = [(i, "\n".join("\n".join(textwrap.wrap(rng.choice(parts), rng.choice([30, 70, 200]))) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(None, "Released under the MIT License."), (3, None), (3, rows[3][1])]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    found = Counter((r["doc_id"], tuple(sorted((x["paragraph"], x["family"], round(x["probability"], 5), round(x["overlap"], 5)) for x in r["licenses"]))) for r in got)
    assert found == Counter((d, tuple(brute_force(t, model))) for d, t in rows)


@pytest.mark.parametrize(
    ("said", "family"),
    [("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("Apache-2.0", "apache"), ("CC0 1.0 Universal", "public_domain"), ("distributed under the 2-clause BSD terms", "bsd"), ("under the terms of the Mozilla Public License 2.0", "mpl")],
)
def test_other_wordings(spark, model, said, family):
    got = license_scan.scan_licenses(spark.createDataFrame([(1, f"a line\n{said}\nanother")], "doc_id long, text string"), model).first()
    assert [x["family"] for x in got["licenses"]] == [family]


def test_calibration(model):
    """On templates, paragraphs and licences that training had not seen."""
    assert model.error < 0.25 and 2**-4 < model.temperature < 2**4


@pytest.mark.parametrize("width", [40, 72, 80])
def test_wrapped_headers(spark, model, width):
    mit, bsd, gpl = license_scan.TEMPLATES["mit"][2], license_scan.TEMPLATES["bsd"][1], license_scan.TEMPLATES["gpl"][1]
    rows = [("mit", mit), ("bsd", bsd), ("gpl", gpl)]
    texts = [(k, "a file\n\n" + "\n".join("# " + x for x in textwrap.wrap(t, width)) + "\n\nthe end") for k, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: {x["family"] for x in r["licenses"]} for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got == {k: {family} for k, (family, _) in enumerate(rows)}
