"""Licence scans: a logistic regression on word n-grams of paragraphs, confirmed by templates (DataFrame operations only)."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Wordings by which each family of licences is granted or named.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is distributed under the terms of the Apache License 2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "Use of this source code is governed by an MIT-style license.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Distributed under the terms of the 2-clause BSD license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GPL, version 2 or later.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "you can redistribute it under the terms of the GNU Affero General Public License",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "eclipse": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC License.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Licensed under the Boost Software License 1.0.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Available under a Creative Commons Attribution-ShareAlike licence.",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright (CC0 1.0 Universal).",
        "CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
        "The authors dedicate this work to the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright the author. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "This document is confidential and proprietary; all rights are reserved by the owner.",
    ],
}
#: Sentences that speak of licences, software or rights and grant nothing.
NOT_LICENSES = (
    *("The driving license of the driver was valid.", "A license fee is due each year.", "You need permission from the owner.", "The copyright debate went on for years."),
    *("The public library is open.", "The software was slow to start.", "A fishing licence costs little.", "Version 2.0 of the report came late.", "The rights of man were declared."),
    *("Please keep a copy of this file.", "She published a book on software licenses.", "The foundation gave a general account.", "Public transport is free of charge.", "The clause was struck from the contract."),
    *("The work is the author's own.", "He was granted a patent.", "Conditions were poor and the terms were harsh.", "The source of the river is in the hills.", "The form must be filled in twice.", "My license to sing has expired."),
)
#: Wordings of licences of none of the families; the calibration counts them as unknown.
STRANGERS = (
    *("This software is provided under the zlib license.", "SPDX-License-Identifier: WTFPL", "Licensed under the Academic Free License version 3.0.", "This file is part of the Artistic License 2.0 distribution."),
    *("Licensed under the PostgreSQL License.", "SPDX-License-Identifier: Zlib", "The fonts are under the SIL Open Font License, Version 1.1.", "Usage is subject to the Server Side Public License."),
)
#: Lines that are read together where a notice is wrapped.
WINDOW = 4
UNKNOWN = "unknown"
_WORD = "[a-z0-9]+"


def features(paragraph: str) -> set[str]:
    """The words and word pairs of a lower-cased paragraph."""
    words = re.findall(_WORD, paragraph)
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def shapes(text: str, others: list[str], rng: np.random.Generator) -> list[set[str]]:
    """A template's features whole, cut short at either end, and within other text."""
    words = re.findall(_WORD, text.lower())
    out = [words, *(words[: max(2, round(len(words) * f))] for f in (0.8, 0.9)), *(words[round(len(words) * f) :] for f in (0.1, 0.2))]
    for _ in range(4):
        near = re.findall(_WORD, str(rng.choice(others)))[: int(rng.integers(3, 25))]
        out.append(near + words if rng.random() < 0.5 else words + near)
    return [features(" ".join(w)) for w in out]


def trained(x: np.ndarray, y: np.ndarray, l1: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a logistic regression over classes, by proximal steps that set small weights to zero; each
    class has the same say."""
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    share = (y / np.maximum(y.sum(0), 1)).sum(1, keepdims=True) / y.shape[1]
    rate = 2.0 / max(1.0, np.square(x).sum(1).mean()) * y.shape[1]
    for _ in range(rounds):
        gap = (softmax(x @ w + b) - y) * share
        w -= rate * (x.T @ gap)
        b -= rate * gap.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


def calibration_error(p: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """The mean distance, over bins of confidence, between confidence and the share that is right."""
    at = np.minimum((p * bins).astype(int), bins - 1)
    return float(sum((at == i).mean() * abs(p[at == i].mean() - right[at == i].mean()) for i in np.unique(at)))


@dataclass(frozen=True)
class LicenseModel:
    """Classes (the unknown one last), weights per feature and class, biases, temperature, the words of all features, and
    the templates' word pairs with what each weighs: the less, the more families have it. error is the calibration error
    on examples that training had not seen."""

    classes: tuple[str, ...]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    words: tuple[str, ...]
    pairs: list[tuple[str, dict[str, float]]]
    error: float = 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 40, paragraphs: int = 300, l1: float = 5e-4, rounds: int = 600) -> LicenseModel:
    """Train on the templates, whole, cut short and within other text, against paragraphs of other text.

    Other text is that of at most `documents` documents, those whose hashed id is least, and at most `paragraphs` lines of
    it, but for those of which a template is the greater part; they alone go to the driver. With it go NOT_LICENSES,
    sentences about licences that grant none. Words that one in fifty of the other paragraphs has are no features, nor
    are pairs of such words. For the temperature, and the error that the model reports, weights are trained without the
    last template of each family that has three, without every fourth other paragraph, and without STRANGERS, wordings of
    licences of no family; on those the temperature and the unknown class's offset are fitted. The weights that are kept are trained on all.
    """
    few = texts(docs.where(F.col(text_col).isNotNull()), id_col, text_col).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(documents)
    lines = few.select(F.explode(F.split(F.lower("text"), "\n")).alias("p")).where(F.length("p").between(20, 600))
    templates = [(f, features(t.lower())) for f, ts in TEMPLATES.items() for t in ts]
    other = sorted({r["p"] for r in lines.limit(4 * paragraphs).collect()})
    other = [p for p in other if not any(2 * len(features(p) & t) > len(t) for _, t in templates)][:paragraphs]
    other += [*map(str.lower, NOT_LICENSES)]
    counts = Counter(w for p in other for w in set(re.findall(_WORD, p)))
    common = {w for w, n in counts.items() if 50 * n > len(other)}
    rng = np.random.default_rng(7)
    classes = (*TEMPLATES, UNKNOWN)
    rows: list[tuple[set[str], int, bool]] = []
    for k, family in enumerate(TEMPLATES):
        for i, text in enumerate(TEMPLATES[family]):
            held = i == len(TEMPLATES[family]) - 1 and i >= 2
            rows += [(x, k, held) for x in shapes(text, other, rng)]
    rows += [(features(p), len(TEMPLATES), i % 4 == 3) for i, p in enumerate(other)]
    rows += [(features(p.lower()), len(TEMPLATES), True) for p in STRANGERS]
    known = sorted(f for f in {f for x, k, _ in rows if k < len(TEMPLATES) for f in x} if not set(f.split()) <= common)
    at = {f: i for i, f in enumerate(known)}
    x = np.zeros((len(rows), len(known)))
    for i, (present, _, _) in enumerate(rows):
        x[i, [at[f] for f in present if f in at]] = 1
    y, held = np.eye(len(classes))[[k for _, k, _ in rows]], np.array([h for _, _, h in rows])
    w, b = trained(x[~held], y[~held], l1, rounds)
    z = x[held] @ w + b

    last = np.eye(len(classes))[-1]
    truth = y[held]

    def loss(scale: tuple[float, float]) -> float:
        heat, more = scale
        return float((-np.log(np.maximum((softmax((z + more * last) / heat) * truth).sum(1), 1e-12))).mean())

    temperature, more = min(((2 ** (i / 4), j / 4) for i in range(-16, 17) for j in range(-16, 17)), key=loss)
    p = softmax((z + more * last) / temperature)
    error = calibration_error(p.max(1), p.argmax(1) == y[held].argmax(1))
    w, b = trained(x, y, l1, rounds)
    b = b + more * last
    weights = {f: [round(float(v), 6) for v in w[i]] for f, i in at.items() if w[i].any()}
    shared = Counter(g for ts in TEMPLATES.values() for g in {g for t in ts for g in features(t.lower()) if " " in g})
    pairs = [(f, {g: round(1 / shared[g], 6) for g in sorted(t) if " " in g}) for f, t in templates]
    words = tuple(sorted({v for f in weights for v in f.split()} - common))
    return LicenseModel(classes, weights, [round(float(v), 6) for v in b], temperature, words, pairs, error)


def scan_licenses(df: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", least_probability: float = 0.5, least_overlap: float = 0.3) -> DataFrame:
    """Returns doc_id and licenses, an array of (paragraph, family, probability, overlap) in the order of paragraphs.

    Read are single lines, windows of WINDOW lines, and whole paragraphs (lines up to one without a word); paragraph is
    the number of the first line. The family is the class of the greatest probability; it counts if that isn't the unknown
    class, the probability is at least least_probability, and a template of the family shares least_overlap of the weight
    of its word pairs with the text. Of readings of one family that share lines, lines go before windows, windows before
    paragraphs. A reading without any word of the model's features has the biases alone, which say unknown, so it is not
    worked out. Null and empty texts have no paragraphs, so an empty array; null ids are kept; repeated rows get equal
    results; other columns are not carried; an empty table gives no rows. All within a row: no shuffle, and the model is a
    literal of the plan (some thousand numbers).
    """
    if max(range(len(model.classes)), key=model.bias.__getitem__) != len(model.classes) - 1:
        raise ValueError("the model's biases must favour the unknown class")
    literals = json.dumps(
        {
            "w": {f: v for f, v in model.weights.items()},
            "t": [{"f": f, "g": [*g], "v": [*g.values()], "s": sum(g.values())} for f, g in model.pairs],
            "b": model.bias,
            "c": list(model.classes),
            "k": list(model.weights),
            "p": sorted({g for _, pairs in model.pairs for g in pairs}),
        }
    )
    kind = "struct<w:map<string,array<double>>,t:array<struct<f:string,g:array<string>,v:array<double>,s:double>>,b:array<double>,c:array<string>,k:array<string>,p:array<string>>"
    held = F.from_json(F.lit(literals), kind)

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def known(line: Column) -> Column:
        return F.arrays_overlap(F.split(line, "[^a-z0-9]+"), F.array(*map(F.lit, model.words)))

    def judged(p: Column, i: Column, last: Column, m: Column) -> Column:
        def by_words(words: Column) -> Column:
            n = F.size(words)
            pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda k: F.concat_ws(" ", F.get(words, k), F.get(words, k + 1)))).otherwise(F.array().cast("array<string>"))

            def by_pairs(two: Column) -> Column:
                return let(F.array_intersect(two, m["p"]), lambda told: by_both(two, told))

            def by_both(two: Column, told: Column) -> Column:
                present = F.array_intersect(F.concat(words, two), m["k"])  # each once
                logits = F.aggregate(present, m["b"], lambda acc, f: F.coalesce(F.zip_with(acc, m["w"][f], lambda a, b: a + b), acc))

                def by_logits(z: Column) -> Column:
                    top = F.array_max(z)
                    total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / model.temperature))
                    family = F.get(m["c"], (F.array_position(z, top) - 1).cast("int"))
                    overlap = let(
                        family,
                        lambda f: F.array_max(F.transform(F.filter(m["t"], lambda t: t["f"] == f), lambda t: F.aggregate(F.zip_with(t["g"], t["v"], lambda g, v: F.when(F.array_contains(told, g), v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v) / t["s"])),
                    )
                    return F.struct(i.alias("paragraph"), last.alias("last"), family.alias("family"), (1 / total).alias("probability"), F.coalesce(overlap, F.lit(0.0)).alias("overlap"))

                return let(logits, by_logits)

            return let(pairs, by_pairs)

        return let(F.regexp_extract_all(p, F.lit(_WORD), F.lit(0)), by_words)

    def reading(p: Column, first: Column, last: Column) -> Column:
        return F.struct(p.alias("p"), first.alias("i"), last.alias("last"))

    def readings(lines: Column) -> Column:
        return let(F.transform(lines, known), lambda hits: of_hits(lines, hits))

    def of_hits(lines: Column, hits: Column) -> Column:
        """The readings with a line that has a known word."""
        n = F.size(lines)
        single = F.filter(F.transform(lines, lambda p, i: reading(p, i, i)), lambda x: F.get(hits, x["i"]))

        def any_hit(first: Column, size: Column) -> Column:
            return F.exists(F.slice(hits, first + 1, size), lambda h: h)

        def joined(first: Column, size: Column) -> Column:
            return reading(F.array_join(F.slice(lines, first + 1, size), " "), first, first + size - 1)

        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - WINDOW)), lambda i: any_hit(i, F.least(F.lit(WINDOW), n - i)))
        windows = F.when(n > 1, F.transform(starts, lambda i: joined(i, F.least(F.lit(WINDOW), n - i)))).otherwise(F.array().cast(single_kind))

        def by_breaks(breaks: Column) -> Column:
            spans = F.transform(breaks, lambda b, k: F.struct((b + 1).alias("i"), (F.coalesce(F.get(breaks, k + 1), n) - b - 1).alias("size")))
            return F.transform(F.filter(spans, lambda x: (x["size"] > 1) & any_hit(x["i"], x["size"])), lambda x: joined(x["i"], x["size"]))

        blank = F.filter(F.transform(lines, lambda p, i: F.when(p.rlike(_WORD), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        paragraphs = let(F.concat(F.array(F.lit(-1)), blank), by_breaks)
        return F.when(F.exists(hits, lambda h: h), F.concat(single, windows, paragraphs)).otherwise(F.array().cast(single_kind))

    def held_once(hits: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return F.when(F.exists(acc, lambda y: (y["family"] == x["family"]) & (y["paragraph"] <= x["last"]) & (x["paragraph"] <= y["last"])), acc).otherwise(F.concat(acc, F.array(x)))

        kept = F.aggregate(hits, F.array().cast("array<struct<paragraph:int,last:int,family:string,probability:double,overlap:double>>"), add)
        return F.array_sort(F.transform(kept, lambda y: F.struct(y["paragraph"], y["family"], y["probability"], y["overlap"])))

    single_kind = "array<struct<p:string,i:int,last:int>>"
    read = let(F.split("low", "\n"), readings)
    found = let(held, lambda m: held_once(F.filter(F.transform(read, lambda x: judged(x["p"], x["i"], x["last"], m)), lambda r: (r["family"] != UNKNOWN) & (r["probability"] >= least_probability) & (r["overlap"] >= least_overlap))))
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,overlap:double>>")
    low = texts(df, id_col, text_col).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.when(known(F.col("low")), found).otherwise(none).alias("licenses"))
