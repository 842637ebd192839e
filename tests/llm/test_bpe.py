import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cellspark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_ids_and_round_trip(docs, plain, own):
    got = bpe.decode(bpe.encode(docs.withColumnRenamed("node", "words"), PATH, PATTERN), PATH)
    assert got.columns == [*docs.withColumnRenamed("node", "words").columns, "token_ids", "decoded"]
    found = Counter((r["doc_id"], tuple(r["token_ids"]), bytes(r["decoded"])) for r in got.collect())
    assert found == Counter((d, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for d, t in plain)


def test_many_blocks_keep_and_repeats(spark, own):
    texts = [f"word{i % 7} straße {i} naïve-{i}ly  \n\tend" for i in range(60)] + ["same"] * 20
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = bpe.encode(df, PATH, PATTERN, keep=["doc_id"], block_bytes=40)
    assert got.columns == ["doc_id", "token_ids"]
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in got.collect()) == Counter((i // 2, tuple(own.encode_ordinary(t))) for i, t in enumerate(texts))


def test_words_are_forgotten_and_met_again(spark, own):
    texts = [f"word{i % 7} straße {i} naïve-{i}ly  \n\tend" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["token_ids"] for r in bpe.encode(df, PATH, PATTERN, block_bytes=40, known_words=9).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in enumerate(texts)}


def test_long_words(spark, own):
    rng = random.Random(3)
    letters = "etaoinshrdlu" * 3 + "bcfgjkmpqvwxyzéß"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (511, 512, 513, 700, 1025, 20_000)]
    texts += ["a" * 3000, "ab" * 1000 + "c", "x" + "ha" * 900, "=" * 5000, " " * 3000 + "end", "q" * 513 + " and " + "é" * 999]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["token_ids"] for r in bpe.encode(df, PATH, PATTERN).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in enumerate(texts)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abehnt ér", min_size=1, max_size=60).filter(str.strip))
def test_queue_of_pairs(text):
    ranks = bpe.load_ranks(PATH)
    word = text.encode()
    assert bpe.merged_word(word, ranks) == [ranks[t] for t in bpe.merged(word, ranks)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="stmdrevlaZé漢ß0٣²Ⅷ_-'\u0301 \t\n\r\x1c\x85\u3000\u200b😀", max_size=30))
def test_patterns_that_match_the_same(text):
    assert PATTERN in bpe.SAME
    for pattern, same in bpe.SAME.items():
        assert regex.findall(same, text) == regex.findall(pattern, text)


def test_plans_do_not_hold_the_tables(docs):
    """The driver keeps the text of each plan; the tokenizer's tables as literals made it 3 MB."""
    done = bpe.decode(bpe.encode(docs.select("doc_id", "text"), PATH, PATTERN), PATH)
    assert len(done._jdf.queryExecution().toString()) < 50_000


def test_windows_up_to_what_places_hold(spark, own):
    text = "".join(random.Random(4).choice("etaoinshrdlu") for _ in range(300)) + " end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for window in (220, bpe.LONGEST + 9):
        assert bpe.encode(df, PATH, PATTERN, window=window).first()["token_ids"] == own.encode_ordinary(text)


def test_too_many_ids(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 65534\n")
    with pytest.raises(ValueError, match="two bytes"):
        bpe.load_ranks(str(tmp_path / "ranks"))


def test_whole_words_that_merging_misses(spark, tmp_path):
    """`abc` is a token, but neither `ab` nor `bc` is, so merging alone cannot reach it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xy": 257}
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    df = spark.createDataFrame([(1, "abc abcd xyabc"), (2, "xy xyz abc")], "doc_id long, text string")
    got = {r["doc_id"]: r["token_ids"] for r in bpe.encode(df, str(tmp_path / "ranks"), r"\w+|\s+").collect()}
    library = tiktoken.Encoding("small", pat_str=r"\w+|\s+", mergeable_ranks=ranks, special_tokens={})
    assert got == {1: library.encode_ordinary("abc abcd xyabc"), 2: library.encode_ordinary("xy xyz abc")}


def test_empty(no_docs):
    assert bpe.decode(bpe.encode(no_docs, PATH, PATTERN), PATH).count() == 0
