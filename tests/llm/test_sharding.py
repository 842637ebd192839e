from collections import Counter

import hashlib
import zlib

from cellspark.llm.sharding import shard_by_bytes


def test_shards_are_contiguous_balanced_and_gapless(docs, plain):
    got = shard_by_bytes(docs, n_shards=4).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in plain)
    by_id = {d: t or "" for d, t in plain}
    sizes = [0] * 4
    for r in got:
        raw = by_id[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        sizes[r["shard"]] += r["size"]
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    most = max(len((t or "").encode()) for _, t in plain) + 8
    assert max(sizes) - min(sizes) <= 2 * most
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    digests = [hashlib.md5(by_id[r["doc_id"]].encode()).hexdigest() for r in order]
    assert digests == sorted(digests)  # equal texts stand together


def test_a_hot_text_spreads(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(300)] + [(300 + i, f"other {i}") for i in range(30)], "doc_id long, text string")
    got = shard_by_bytes(df, n_shards=6).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(6)]
    assert max(counts) - min(counts) <= 2


def test_empty(no_docs):
    assert shard_by_bytes(no_docs).count() == 0


def test_matches_a_plain_rerun(docs):
    """Shards and slots from the definition: rows in the order of digest, salt and id, cut where the middles fall."""
    from pyspark.sql import functions as F

    body = F.coalesce("text", F.lit(""))
    rows = [tuple(r) for r in docs.select(F.md5(F.encode(body, "UTF-8")), F.pmod(F.xxhash64("doc_id"), F.lit(1024)), "doc_id", F.octet_length(body) + 8).collect()]
    rows.sort()
    total = sum(r[3] for r in rows)
    start, at, expected, slots = 0, 0, [], Counter()
    while at < len(rows):
        group = [r for r in rows[at:] if r[0] == rows[at][0]]
        weight = sum(r[3] for r in group)
        for k, r in enumerate(group):
            twice = 2 * start + weight if weight * 5 <= total * 0.01 else 2 * (start + k * r[3]) + r[3]
            shard = min(4, twice * 5 // (2 * total))
            expected.append((r[2], r[3], shard, slots[shard]))
            slots[shard] += 1
        start, at = start + weight, at + len(group)
    got = shard_by_bytes(docs, n_shards=5).select("doc_id", "size", "shard", "slot").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_plan_has_no_python(docs):
    plan = shard_by_bytes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
