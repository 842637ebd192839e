from collections import Counter

import numpy as np

from cellspark.llm import langid


def test_held_out_texts_are_told_apart(docs, plain):
    model = langid.fit_languages(docs.where("doc_id % 2 = 0"), per_language=60)
    got = langid.identify_languages(docs, model).collect()
    assert len(got) == len(plain)
    longer = {d for d, t in plain if t and d < 120 and len(t) > 60 and d % 2}
    own = {d: "en" if d % 3 else "de" for d in longer}
    right = sum(r["lang_pred"] == own[r["doc_id"]] for r in got if r["doc_id"] in longer)
    assert right >= 0.98 * len(longer)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in dict(plain)[r["doc_id"]] or ""))
    assert not any(r["rejected"] for r in got if r["doc_id"] in longer)


def test_far_text_is_rejected(spark, docs):
    model = langid.fit_languages(docs)
    df = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5), (2, "the people of the water were there when we made it")], "doc_id long, text string")
    assert [r["rejected"] for r in langid.identify_languages(df, model).orderBy("doc_id").collect()] == [True, False]
    assert [r["doc_id"] for r in langid.keep_identified(df, model).collect()] == [2]


def test_empty_and_unlabelled(docs, no_docs):
    nothing = langid.fit_languages(no_docs)
    assert {r["lang_pred"] for r in langid.identify_languages(docs, nothing).collect()} == {"und"}
    assert langid.keep_identified(docs, nothing).count() == docs.count()
    assert langid.identify_languages(no_docs, langid.fit_languages(docs)).count() == 0


def brute_force(text, model):
    """The nearest centroid of one text, trigram by trigram."""
    raw = bytearray((text or "").encode())
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and raw[i] <= 0x9E:  # Latin capitals with accents
            raw[i] |= 0x20
    folded = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in raw)
    counts = np.zeros(langid.DIMS)
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        code = a << 16 | b << 8 | c
        if code != 0x202020:
            counts[(code * 2654435761 % (1 << 32)) >> 19] += 1
    vector = np.sqrt(counts) * model.idf
    norm = np.linalg.norm(vector)
    like = model.centroids @ (vector / norm if norm else vector)
    return model.languages[model.owner[int(like.argmax())]], float(like.max())


def test_matches_brute_force(docs, plain):
    model = langid.fit_languages(docs, per_language=50)
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in langid.identify_languages(docs, model).collect())
    want = Counter()
    for d, t in plain:
        lang, score = brute_force(t, model)
        letters = any(map(str.isalpha, t or ""))
        want[d, lang if letters else "und", round(min(max(score, 0), 1), 4) if letters else 0.0] += 1
    assert sum((got - want).values()) <= 2  # single precision may round the last digit the other way

