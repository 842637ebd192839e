import random
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cellspark.llm import bpe, common
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute_force

KIND = "doc_id long, text string, lang string, source string, n_chars long, place long, copy_ long, component long"
RUSSIAN = "Съешь же ещё этих мягких французских булок, да выпей чаю, и приходи к нам завтра вечером. "


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = [(i, prose(rng, "en" if i % 3 else "de", rng.randint(20, 80)), "en" if i % 3 else "de", ["hot", "a", None][i % 7 % 3]) for i in range(240)]
    near = rows[4][1].split()
    rows += [(300 + i, " ".join([*near[: len(near) - i % 2]]), "en", "a") for i in range(30)]
    rows += [(400 + i, prose(rng, "en", 30) + " stupid idiot trash " + prose(rng, "en", 5), "en", "a") for i in range(60)]
    rows += [(500, RUSSIAN * 4, None, "a"), (501, None, "en", "a"), (502, "", "en", None), (503, "12 34 !!", None, "b")]
    rows += [(7, "another text under an id that is taken " + prose(rng, "en", 30), "en", "b"), (7, rows[7][1], "de", "b")]
    rows += [(None, prose(rng, "en", 40), "en", "b"), (None, prose(rng, "de", 40), "de", "b"), (None, rows[9][1], "de", "b")]
    return [(*r, len(r[1] or ""), 1, 2, 3) for r in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus, KIND).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int(400 <= (r[0] or 0) < 460)) for r in corpus if r[0] is not None and r[0] not in (7, 500) and r[0] % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], KIND).write.parquet(f"{path}/empty.parquet")
    return path


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bag(frame):
    return Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_the_driver_gives_memory_back(spark, documents, monkeypatch):
    assert common.trim(spark)
    asked = []
    monkeypatch.setattr(common, "trim", asked.append)
    assert bag(common.written(documents, "copy")) == bag(documents)
    assert asked == [spark]


def test_executors_give_memory_back_before_each_later_stage(spark, documents, sf_dir, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep", "Full"))]
    before = sum(b.getCollectionCount() for b in whole)
    common.rest(spark)  # in local mode the driver is the executor
    assert whole and sum(b.getCollectionCount() for b in whole) > before
    asked = []
    monkeypatch.setattr(pipeline, "rest", asked.append)
    for name, stage in pipeline.STAGES:
        asked.clear()
        stage(spark, documents, sf_dir)
        assert asked == [spark] * (name != "language")


def test_language_rejects_the_strange_and_keeps_the_rest(spark, documents, sf_dir, corpus):
    got = pipeline.language(spark, documents, sf_dir)
    assert got.columns == documents.columns
    assert bag(got) == Counter((r[0], r[1]) for r in corpus if r[0] not in (500, 501, 502, 503))


def test_toxicity_drops_the_toxic_only(spark, documents, sf_dir, corpus):
    got = pipeline.toxicity(spark, documents, sf_dir)
    assert got.columns == documents.columns
    assert bag(got) == Counter((r[0], r[1]) for r in corpus if not 400 <= (r[0] or 0) < 460)


def test_one_of_each_group_stays(spark, documents, sf_dir, corpus):
    got = pipeline.near_duplicates(spark, documents, sf_dir)
    assert got.columns == documents.columns
    order = sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0))
    groups = brute_force([(i, r[1]) for i, r in enumerate(order)], 5, 80)
    assert bag(got) == Counter((order[i][0], order[i][1]) for i, n, comp in groups if i == comp or not n)
    assert {r["source"] for r in got.where("doc_id = 7").collect()} >= {"b"}  # the other text of that id is no copy


def test_mixture_keeps_every_row(spark, documents, sf_dir, corpus):
    got = pipeline.mixture(spark, documents.union(documents.where("doc_id = 12")), sf_dir)
    assert got.columns == documents.columns
    assert bag(got) == Counter((r[0], r[1]) for r in corpus) + Counter((r[0], r[1]) for r in corpus if r[0] == 12)


def test_tokens_are_those_of_the_library(spark, documents, sf_dir, corpus):
    own = tiktoken.Encoding("own", pat_str=pipeline.PATTERN, mergeable_ranks=bpe.load_ranks(pipeline.RANKS), special_tokens={})
    got = pipeline.tokens(spark, documents, sf_dir).collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in got)
    assert Counter((r["doc_id"], r["source"], tuple(r["token_ids"])) for r in got) == Counter((r[0], r[3], tuple(own.encode_ordinary(r[1] or ""))) for r in corpus)


def test_empty_tables_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/empty.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_run_is_the_stages_in_order(spark, documents, sf_dir, corpus):
    got = pipeline.run(spark, sf_dir)
    ids = {r["doc_id"] for r in got.collect()}
    assert not ids & {500, 501, 502, 503, *range(400, 460)} and {0, 1, 7, None} <= ids
    assert got.where(~F.col("round_trip")).count() == 0 and len([i for i in ids if i in range(300, 330)]) == 0
