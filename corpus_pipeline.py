"""The document pipeline: each stage's rows are written as Parquet and read again as the next one's documents.

Languages that no model knows and toxic documents go, one document of each group of near copies stays, the sources are
mixed to their target weights, and the texts become token ids. Each stage works on all that the one before it kept. All
but the last return the columns of `documents`. All but the first begin with a collection of the executors' garbage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellspark.llm.bpe import decode, encode
from cellspark.llm.common import rest, written
from cellspark.llm.jaccard import ngram_jaccard_join
from cellspark.llm.langid import fit_languages, keep_identified
from cellspark.llm.mixing import mix_sources
from cellspark.llm.toxicity import fit_toxicity, keep_civil

#: A worker of the tokenizer forgets its words beyond so many: less than by itself, as the stages before leave it less memory.
KNOWN = 400_000
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


#: Stands for a null id in keys; names of columns that no table has.
NO_ID, ID, HASH, COPY, PLACE = -(1 << 63), "\tid", "\thash", "\tcopy", "\tplace"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with keys of a row: its id (null: the least long) and its text's hash. Rows with one id and other texts differ."""
    return docs.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(HASH, F.xxhash64(F.coalesce("text", F.lit(""))))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (so null and empty texts), and those too far, for their length, from every
    language's centroids. An empty table stays empty; where no document names its language, all stay."""
    return keep_identified(docs, fit_languages(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the model learns from the labels of the documents at hand. Null texts score
    as empty ones. Without labels, or labels of one kind only, nothing is told apart and the score of that kind holds."""
    rest(spark)
    return keep_civil(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id (null last), of each component of near copies (five words, Jaccard 0.8 or
    more). Texts without words are of no component and stay; rows with equal id and text become one."""
    rest(spark)
    rows = ngram_jaccard_join(docs, width=5, percent=80)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = rows.where("component IS NOT NULL").groupBy("component").agg(first).select("first.doc_id", "first.text_hash")
    kept = kept.union(rows.where("component IS NULL").select("doc_id", "text_hash").distinct())
    kept = written(kept.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(ID), F.col("text_hash").alias(HASH)), "kept")
    return keyed(docs).join(kept.hint("merge"), [ID, HASH], "left_semi").dropDuplicates([ID, HASH]).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, sources weighted by the root of their size. A null source is one of its
    own; rows that repeat each keep their place; an empty table stays empty."""
    rest(spark)
    places = mix_sources(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("\tid2"), F.col("text_hash").alias("\thash2"), F.col("place").alias(PLACE))
    places = places.withColumn("\tcopy2", F.row_number().over(Window.partitionBy("\tid2", "\thash2").orderBy(PLACE)))
    numbered = keyed(docs).withColumn(COPY, F.row_number().over(Window.partitionBy(ID, HASH).orderBy(F.lit(0))))
    # Copies are matched beside the keys, so that the join is dealt as the windows are and texts are shuffled once for both.
    same = (F.col(ID) == F.col("\tid2")) & (F.col(HASH) == F.col("\thash2")) & (F.col(COPY) - F.col("\tcopy2") == 0)
    both = numbered.join(places.hint("merge"), same)
    return both.repartitionByRange(PLACE).sortWithinPartitions(PLACE).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and whether decoding the ids gives the text's bytes again (null: none)."""
    rest(spark)
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    rows = docs.select("doc_id", "lang", "source", "text", digest.alias("digest"))
    done = decode(encode(rows, RANKS, PATTERN, keep=["doc_id", "lang", "source", "digest"], known_words=KNOWN), RANKS)
    same = F.sha2("decoded", 256) == F.col("digest")
    return done.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL cannot express trained models, components or merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
