"""Document fingerprints: every shingle hash below a fixed share of all hashes (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

#: Least value of a long; hashes are spread over all longs.
LEAST = -(1 << 63)
#: Most buckets of ids, and rows that a bucket aims at.
BUCKETS, BUCKET_ROWS = 1 << 16, 256


def word_hash_list(text: Column) -> Column:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of the lower-cased text, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, width: int, share: float) -> Column:
    """below: ascending distinct shingle hashes below `share` of the range, and no other; least: the least hash of all, null
    without words. Apart from it, a sketch says nothing of a text without a hash below the threshold.

    hashes must be a column of its own, since each shingle reads it `width` times.
    """
    n = F.size(hashes)
    shingles = F.when(
        n >= width,
        F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width)))),
    ).otherwise(F.when(n > 0, F.array(F.xxhash64(F.array_join(hashes.cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>")))
    below = F.lit(min(LEAST + int(share * (1 << 64)), -LEAST - 1))

    def both(s: Column) -> Column:
        kept = s if share >= 1 else F.filter(s, lambda h: h < below)
        return F.struct(F.array_sort(F.array_distinct(kept)).alias("below"), F.array_min(s).alias("least"))

    return F.get(F.transform(F.array(shingles), both), F.lit(0))


def add_sketch(df: DataFrame, text_col: str, out_col: str, width: int, share: float) -> DataFrame:
    return df.withColumn("__h", word_hash_list(F.col(text_col))).withColumn(out_col, sketch_of(F.col("__h"), width, share)).drop("__h")


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller text in the larger, 0 to 1, estimated as that of the smaller sketch in the larger. Where a
    sketch is empty, whether the least hashes are the same; two texts without words are alike, one is unlike others."""
    least = F.least(F.size(a["below"]), F.size(b["below"]))
    same = F.when(a["least"].eqNullSafe(b["least"]), 1.0).otherwise(0.0)
    return F.when(least == 0, same).otherwise(F.size(F.array_intersect(a["below"], b["below"])) / least)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches of one width and share."""
    return F.struct(F.array_sort(F.array_union(a["below"], b["below"])).alias("below"), F.least(a["least"], b["least"]).alias("least"))


def as_text(sketch: Column) -> Column:
    """The hashes as 16 hexadecimal digits each; of an empty sketch the least hash after a sign."""
    digits = F.lower(F.array_join(F.transform(sketch["below"], lambda h: F.lpad(F.hex(h), 16, "0")), ""))
    return F.when(F.size(sketch["below"]) > 0, digits).otherwise(F.coalesce(F.concat(F.lit("+"), F.lower(F.lpad(F.hex(sketch["least"]), 16, "0"))), F.lit("")))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: float = 0.5) -> DataFrame:
    """Returns doc_id and sketch (below: array of longs, least: long) for every row, of its whole text; no shuffle.

    Shingles are `width` words; a text with fewer words is one shingle. Null texts count as empty and have no hashes;
    null ids are kept; repeated rows get equal sketches; an empty table gives no rows; other columns are not carried.
    The threshold is the same for all texts, so sketches of one width and share merge by union into that of the joined
    shingles, and containment between very unequal texts is estimated by the share of the smaller one's hashes that the
    larger one has.
    """
    return add_sketch(texts(df, id_col, text_col), "text", "sketch", width, share).select("doc_id", "sketch")


def with_next(docs: DataFrame, *values: str) -> DataFrame:
    """docs (doc_id, and the columns named) with next_<name> of the row that follows by (doc_id, first value); the last is
    followed by the first.

    Ids are dealt into up to BUCKETS ranges of equal width. The first row of each range also goes, as a ghost, to the
    range before it, so one shuffle suffices and no range sees another's rows. A null id counts as the least.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(LEAST))
    at = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    low, high = (at["lo"], at["hi"]) if at["lo"] is not None else (0, 0)
    n = max(1, min(BUCKETS, -(-at["n"] // BUCKET_ROWS)))
    width = max(1, -(-(high - low + 1) // n))
    placed = docs.withColumn("bucket", F.greatest(F.lit(0), F.floor((F.coalesce("doc_id", F.lit(low)) - F.lit(low)) / width)).cast("long")).withColumn("key", key)
    firsts = placed.groupBy("bucket").agg(F.min("key").alias("first"))  # at most BUCKETS rows
    around = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    firsts = firsts.select("bucket", "first", F.coalesce(F.lag("bucket").over(around), last).alias("before"))
    placed = placed.join(F.broadcast(firsts), "bucket")
    copies = F.when(
        F.col("key") == F.col("first"),
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.struct(F.col("before").alias("b"), F.lit(1).alias("ghost"))),
    ).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))))
    placed = placed.select("key", "doc_id", *values, F.explode(copies).alias("to")).select("key", "doc_id", *values, "to.b", "to.ghost")
    order = Window.partitionBy("b").orderBy("ghost", "key", values[0])
    placed = placed.select("doc_id", *values, "ghost", *(F.lead(v).over(order).alias(f"next_{v}") for v in values))
    return placed.where("ghost = 0").drop("ghost")


def edited_text(text: Column, other: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many, or all, of other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
