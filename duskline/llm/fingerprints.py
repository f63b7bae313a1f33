"""Bottom-k sketches of five-word shingles, made of built-in functions alone.

A sketch is the sorted array of the K smallest distinct shingle hashes. The K smallest of two
sketches together are the sketch of both texts, which gives resemblance, containment and the number
of distinct shingles. A text of fewer words, but not none, has its whole sequence as one shingle.

Defined cases: a null text is empty and has the empty sketch; two empty sketches are alike (1), an
empty and another one are not (0); the text that follows the only document is its own; rows that
repeat a doc_id follow each other by their texts' digest; a null doc_id comes last; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 64
SHINGLE = 5
# Ids of one window group.
NEIGHBOURS = 1024


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def shingles(hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` words, from the words' hashes."""
    count = F.size(hashes)
    runs = F.transform(
        F.sequence(F.lit(0), count - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])
    )
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(count >= size, runs).when(count > 0, F.array(F.xxhash64(hashes))).otherwise(none)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two shingle sets."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def text_of(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Adds the sketch of a text column; each step is a column, so that none is computed twice."""
    hashed = df.withColumn("__words", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    return hashed.withColumn(name, bottom(shingles(F.col("__words")), k)).drop("__words")


def merged_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group; the parts are merged hash by hash, so that a large group is no task."""
    parts = df.select(*keys, F.explode(sketch).alias("h")).distinct()
    own = Window.partitionBy(*keys).orderBy("h")
    least = parts.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `next`, these columns of the row of the next smaller doc_id (of the largest at the end).

    Windows see groups of NEIGHBOURS ids; only one row per group meets in one task.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    grouped = df.withColumn("group", F.floor(key / NEIGHBOURS).cast("long"))
    down = Window.partitionBy("group").orderBy(F.desc_nulls_last("doc_id"), "digest")
    value = F.struct(*columns)
    placed = grouped.withColumn("next", F.lead(value).over(down)).withColumn("place", F.row_number().over(down))
    heads = grouped.groupBy("group").agg(F.max(F.struct(key.alias("k"))).alias("m"))
    order = Window.orderBy(F.desc("group"))
    around = Window.orderBy(F.desc("group")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = heads.select(
        "group", F.coalesce(F.lead("group").over(order), F.first("group").over(around)).alias("following")
    )
    top = placed.where("place = 1").select(F.col("group").alias("following"), value.alias("head"))
    ends = follow.join(top, "following").select("group", "head")
    return placed.join(ends, "group", "left").withColumn("next", F.coalesce("next", "head")).drop("head", "place", "group")


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketched = with_sketch(base, "text", "sketch", k).withColumn("digest", F.xxhash64("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = (
        with_next(sketched, ["text", "sketch"])
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .select(
            "doc_id",
            "n_chars",
            "sketch",
            F.col("next.sketch").alias("next_sketch"),
            F.concat(
                F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
                F.substring("next.text", F.lit(1), half),
            ).alias("edited"),
        )
    )
    return with_sketch(edited, "edited", "edited_sketch", k).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
