"""Contiguous shards of near equal bytes, by global prefix sums (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written


def shard_by_bytes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 24,
    row_overhead: int = 8,
    slack: float = 0.01,
    bucket_digits: int = 3,
    salts: int = 1024,
) -> DataFrame:
    """Put every row into one of n_shards contiguous shards of near equal bytes.

    The global order is (md5 of the text, salt of the id, id), so equal texts stand together. A row's place in it is
    the sum of three exclusive prefix sums: over the totals of 16**bucket_digits digest buckets, over the distinct texts
    of a bucket, and over the copies of a text. Cuts lie at multiples of total/n_shards. A group of equal texts that
    weighs at most `slack` of a shard goes whole to the shard of its middle; in a heavier one each row goes to the
    shard of its own middle, so that a text that makes up a third of the rows spreads over shards.

    Skew: rows are dealt by text and salt throughout, so the copies of one text spread over `salts` keys, and texts are
    counted with partial aggregation before any window; windows see a text once, or once a salt.

    Returns doc_id, size (UTF-8 bytes + row_overhead), text_crc32, text_md5, shard (0 ..), slot (0 .. without gaps in
    each shard). A null text counts as empty; a null id is kept, its salt is that of null; repeated rows each get a slot;
    an empty table gives an empty result; other columns are not carried.
    """
    body = F.encode("text", "UTF-8")
    rows = written(
        texts(df, id_col, text_col).select(
            "doc_id",
            (F.octet_length("text") + F.lit(row_overhead)).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.md5(body).alias("text_md5"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
        ),
        "shard-rows",
    )
    parts = rows.groupBy("text_md5", "salt").agg(F.count(F.lit(1)).alias("sn"), F.sum("size").alias("sb"))
    parts = written(parts, "shard-parts")  # a text has at most `salts` rows here
    groups = parts.groupBy("text_md5").agg(F.sum("sn").alias("n"), F.sum("sb").alias("bytes"))
    groups = groups.withColumn("bucket", F.substring("text_md5", 1, bucket_digits))

    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    buckets = groups.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("bytes").alias("bb"))
    buckets = buckets.select(  # at most 16**bucket_digits rows
        "bucket",
        F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bucket_rank"),
        F.coalesce(F.sum("bb").over(before), F.lit(0)).alias("bucket_start"),
        F.sum("bb").over(whole).alias("total"),
    )
    inside = Window.partitionBy("bucket").orderBy("text_md5").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns(
        {
            "in_rank": F.coalesce(F.sum("n").over(inside), F.lit(0)),
            "in_start": F.coalesce(F.sum("bytes").over(inside), F.lit(0)),
        }
    )
    groups = groups.join(F.broadcast(buckets), "bucket").select(
        "text_md5",
        "n",
        "bytes",
        "total",
        (F.col("in_rank") + F.col("bucket_rank")).alias("group_rank"),
        (F.col("in_start") + F.col("bucket_start")).alias("group_start"),
    )

    # Copies of a text: rank inside a salt, plus the rows of the salts before it.
    up_to = Window.partitionBy("text_md5").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("text_md5", "salt", F.coalesce(F.sum("sn").over(up_to), F.lit(0)).alias("salt_rank"))
    parts = written(parts.join(groups, "text_md5"), "shard-groups")
    in_salt = F.row_number().over(Window.partitionBy("text_md5", "salt").orderBy("doc_id")) - 1
    ranked = rows.join(parts.hint("merge"), ["text_md5", "salt"]).withColumn("in_salt", in_salt)
    rank = F.col("in_salt") + F.col("salt_rank")
    whole_group = F.col("bytes") * n_shards <= F.col("total") * slack
    twice_middle = F.when(whole_group, F.col("group_start") * 2 + F.col("bytes")).otherwise(
        (F.col("group_start") + rank * F.col("size")) * 2 + F.col("size")
    )
    placed = ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        "text_md5",
        F.least(F.lit(n_shards - 1), F.floor(twice_middle * n_shards / (F.col("total") * 2))).cast("int").alias("shard"),
        (F.col("group_rank") + rank).alias("place"),
    )
    placed = written(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "text_md5", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot")
    )
