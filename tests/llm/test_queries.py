"""Each registered query over small tables: the columns, hold-outs and digests of its contract."""

import hashlib
import random
import zlib

import pytest
import tiktoken

import __spark_entry__
from cellspark.llm import bpe, queries
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute_force

ODD = [None, "", " ", "12 !!", "ß", "x" * 3000, "Released under the MIT License.", "A b C d e", "a B c d E"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, prose(rng, "en" if i % 3 else "de", rng.randint(5, 60)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(160)]
    out += [(200 + i, out[3][1] if i < 8 else prose(random.Random(1), "en", 60 - i % 3), "en", "s0") for i in range(20)]
    return out + [(300 + i, t, None, None) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], r[0] % 2, int(r[0] % 9 == 0)) for r in rows if r[0] % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def results(spark, sf_dir, name):
    return {r["doc_id"]: r for r in __spark_entry__.queries()[name](spark, sf_dir).collect()}


def crc_of(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_op1(spark, sf_dir, rows):
    got = results(spark, sf_dir, "op1_sharding")
    for d, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[d]["size"], got[d]["text_crc32"], got[d]["law"], got[d]["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert 0 <= got[d]["shard"] < 24
    for s in {r["shard"] for r in got.values()}:
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_op2(spark, sf_dir, rows):
    got = results(spark, sf_dir, "op2_media")
    for d, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64


def test_op3_and_op4_have_each_row(spark, sf_dir, rows):
    places = results(spark, sf_dir, "op3_mixing")
    assert sorted(r["place"] for r in places.values()) == list(range(len(rows)))
    scores = results(spark, sf_dir, "op4_lm_score")
    assert set(scores) == {r[0] for r in rows} and all(r["score"] == pytest.approx(r["target_loss"] - r["background_loss"]) for r in scores.values())


def test_op5(spark, sf_dir, rows):
    got = results(spark, sf_dir, "op5_ngram_jaccard")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.values()) == brute_force([r[:2] for r in rows], 4, 85)


def test_op6(spark, sf_dir, rows):
    got = results(spark, sf_dir, "op6_langid")
    for d, t, *_ in rows:
        assert got[d]["held_out"] == (crc_of(d) % 4 == 2) and 0 <= got[d]["score"] <= 1
        assert (got[d]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))


def test_op7(spark, sf_dir):
    got = results(spark, sf_dir, "op7_licenses")
    assert {d: list(r["families"]) for d, r in got.items() if r["n_found"]} == {306: ["mit"]}


def test_op8(spark, sf_dir, rows):
    got = results(spark, sf_dir, "op8_toxicity")
    for d, *_ in rows:
        assert got[d]["held_out"] == (crc_of(d) % 5 == 0) and 0 <= got[d]["score"] <= 1 and got[d]["predicted"] == int(got[d]["score"] >= 0.5)


def test_op10(spark, sf_dir, rows):
    own = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})
    got = results(spark, sf_dir, "op10_bpe")
    for d, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
