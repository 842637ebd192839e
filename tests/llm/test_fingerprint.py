import hashlib
import re

import pytest
import xxhash

from cellspark.llm import fingerprint, queries


def long_hash(raw, seed=42):
    h = xxhash.xxh64(raw, seed=seed).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute_force(text, width, share):
    words = [long_hash(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    if not words:
        return []
    if len(words) < width:
        hashes = {long_hash(" ".join(map(str, words)).encode())}
    else:
        hashes = set()
        for i in range(len(words) - width + 1):
            h = 42
            for w in words[i : i + width]:
                h = long_hash((w & ((1 << 64) - 1)).to_bytes(8, "little"), h & ((1 << 64) - 1))
            hashes.add(h)
    return sorted(h for h in hashes if h < fingerprint.LEAST + int(share * (1 << 64)))


def test_sketches_match_brute_force(docs, plain):
    got = sorted((r["doc_id"], r["sketch"]["below"]) for r in fingerprint.fingerprints(docs, width=3, share=0.25).collect())
    assert got == sorted((d, brute_force(t, 3, 0.25)) for d, t in plain)


def test_next_and_edited(spark):
    rows = [(5, "abcde"), (9, ""), (1 << 40, "héllo wörld"), (-3, "x"), (6, "yz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.with_next(df, "text").withColumn("edited", fingerprint.edited_text(fingerprint.F.col("text"), fingerprint.F.col("next_text"))).collect()
    order = sorted(rows)
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        (row,) = [r for r in got if r["doc_id"] == d]
        assert (row["next_text"], row["edited"]) == (after, t[: len(t) - half] + after[:half])


def test_empty(no_docs):
    assert fingerprint.fingerprints(no_docs).count() == 0
    assert fingerprint.with_next(no_docs.select("doc_id", "text"), "text").count() == 0


def test_passages_within_long_documents(spark, tmp_path):
    rows = []
    for i in range(60):  # of 16 to 30 words, each followed by a long document that holds it
        passage = " ".join(f"p{i}x{k}" for k in range(16 + i % 15))
        rows += [(2 * i, passage), (2 * i + 1, " ".join([*(f"a{i}x{k}" for k in range(150)), passage, *(f"b{i}x{k}" for k in range(150))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["near_next"] for r in queries.op9_fingerprint(spark, str(tmp_path)).collect()}
    assert [got[2 * i] for i in range(60)] == [1.0] * 60 and all(got[2 * i + 1] == 0 for i in range(60))


def plain_likeness(a, b, share):
    x, y = ({"below": set(brute_force(t, 5, share)), "least": min(brute_force(t, 5, 1), default=None)} for t in (a, b))
    if not x["below"] or not y["below"]:
        return float(x["least"] == y["least"])
    return len(x["below"] & y["below"]) / min(len(x["below"]), len(y["below"]))


def test_query_matches_brute_force(spark, tmp_path, docs):
    rows = sorted({r["doc_id"]: r["text"] for r in docs.collect()}.items())  # ids once each
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op9_fingerprint(spark, str(tmp_path)).collect()}
    for i, (d, t) in enumerate(rows):
        text, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(plain_likeness(text, edited, 0.5)) and r["near_next"] == pytest.approx(plain_likeness(text, after, 0.5))
        hashes = brute_force(text, 5, 0.5)
        least = min(brute_force(text, 5, 1), default=None)
        mask = (1 << 64) - 1
        assert r["fingerprint"] == ("".join(f"{h & mask:016x}" for h in hashes) or ("" if least is None else f"+{least & mask:016x}"))


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(80)]
    a, b = " ".join(words[:50]), " ".join(words[46:])  # each shingle of the whole is in one of them
    df = spark.createDataFrame([(1, a), (2, b), (3, " ".join(words))], "doc_id long, text string")
    got = {r["doc_id"]: r["sketch"] for r in fingerprint.fingerprints(df).collect()}
    pair = fingerprint.fingerprints(df)
    joined = pair.where("doc_id = 1").select(fingerprint.F.col("sketch").alias("a")).crossJoin(pair.where("doc_id = 2").select(fingerprint.F.col("sketch").alias("b")))
    made = joined.select(fingerprint.merged(fingerprint.F.col("a"), fingerprint.F.col("b")).alias("m")).first()["m"]
    assert made == got[3]


def test_plan_has_no_python(docs):
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
