"""The registered queries of the operators, over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .common import texts
from .fingerprint import add_sketch, as_text, edited_text, likeness, with_next
from .jaccard import ngram_jaccard_join
from .langid import fit_languages, identify_languages
from .license_scan import fit_licenses, scan_licenses
from .lm_score import cross_entropy_difference
from .media import text_media
from .mixing import mix_sources
from .sharding import shard_by_bytes
from .toxicity import fit_toxicity, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return cross_entropy_difference(docs, good)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def crc_of_id() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    model = fit_languages(docs.where(~held))
    return identify_languages(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_licenses(docs, fit_licenses(docs))
    return found.select("doc_id", F.size("licenses").alias("n_found"), F.array_sort(F.array_distinct("licenses.family")).alias("families"), "licenses")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_fingerprint(spark: SparkSession, sf_dir: str, width: int = 5, share: float = 0.5) -> DataFrame:
    pairs = with_next(texts(table(spark, sf_dir, "documents"), "doc_id", "text"), "text").withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    # Sketches outweigh their texts, so they are made after the shuffle, the next text's once more.
    for name, sketch in (("text", "sketch"), ("next_text", "next_sketch"), ("edited", "edited_sketch")):
        pairs = add_sketch(pairs, name, sketch, width, share)
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


#: The tokenizer's files, a parameter of the operator.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs, RANKS, PATTERN, keep=["doc_id"]), RANKS)
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("token_ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_media": op2_media,
    "op3_mixing": op3_mixing,
    "op4_lm_score": op4_lm_score,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_langid": op6_langid,
    "op7_licenses": op7_licenses,
    "op8_toxicity": op8_toxicity,
    "op9_fingerprint": op9_fingerprint,
    "op10_bpe": op10_bpe,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op5_ngram_jaccard": f"WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
    "s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS k FROM w), "
    "x AS (SELECT r, len(k) AS n, unnest(k) AS g FROM s), "
    "p AS (SELECT a.r AS i, b.r AS j FROM x a JOIN x b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))), "
    "c AS (SELECT r, r AS seen FROM s UNION SELECT c.r, p.j FROM c JOIN p ON p.i = c.seen), "
    "l AS (SELECT c.r, min(t.doc_id) AS component_id FROM c JOIN s t ON t.r = c.seen GROUP BY 1) "
    "SELECT doc_id, len(k) AS n_shingles, component_id FROM s JOIN l USING (r)",
}
