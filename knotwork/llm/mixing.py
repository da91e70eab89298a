"""Mixing sources to target weights: capped water-filling and seeded repetitions, all in DataFrame operations.

Let a source have weight w and size s, and let no source pass `epochs` times its size. Water-filling gives each source min(w * level, epochs * s). Sources reach their cap in the order of epochs * s / w, so with sources in that order the level follows from running sums; that is where the repeated clamping and sharing ends. The ratio target / s is then taken in whole repetitions, and the rest as one more copy of a part of the documents.

That part is shared out over classes of size, the largest first: each class takes the whole number of documents nearest to its share, and what this takes too much or too little is carried to the next class. So a source's words end within about a small document of the target, however few documents it has. A class has its documents in the order of a seeded hash and takes the first ones. Their running number is built in two steps, so that no task sees a whole class: counts of strata (source, class, bucket of the hash), then the number inside a stratum. Buckets have some hundred documents each, whatever the class's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm.common import WORD, stored, table, whole

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
SEED = 20260
#: Documents in a bucket of a stratum, about.
BUCKET = 256


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes under 16 by themselves, then eight classes for each doubling."""
    # Rounded, so that a power of two is in its class whatever the last bit of its logarithm.
    return F.when(size < 16, size).otherwise(F.floor(F.round(F.log2(size.cast("double")) * 8, 6)) - 16).cast("int")


def drawn(doc_id: Column, seed: int) -> Column:
    """A seeded number in [0, 1): 48 bits of the id's MD5."""
    text = F.concat_ws("#", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def water_fill(sources: DataFrame, total: Column | None = None, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) with a target for each source.

    Sources by code point, null last, weigh `weights` over and over. A source without words has target 0. Sources tie in the order of caps harmlessly: they fill at the same level."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.orderBy("fills_at", F.col("source").asc_nulls_last())
    before, after = every.rowsBetween(W.unboundedPreceding, -1), every.rowsBetween(0, W.unboundedFollowing)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("fills_at", F.lit(float(epochs)) * F.col("source_size") / F.col("weight"))
    whole_size = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    # If all sources before this one are at their caps, the others share what is left.
    ranked = ranked.withColumn("level", (whole_size - F.coalesce(F.sum(F.lit(float(epochs)) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source in this order that the level does not fill tells the level for all.
    level = F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "source", "level"))).over(W.partitionBy(F.lit(1)))["level"]
    target = F.least(F.col("weight") * F.coalesce(level, F.lit(float("inf"))), F.lit(float(epochs)) * F.col("source_size"))
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "target")


def mixed(docs: DataFrame, keep: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, copies, taken.

    Defined for all rows: a null source is a source of its own, a null or empty text has size 0 and takes 0 words, repeated rows are separate documents, an empty table gives an empty table. Ties in size and hash are broken by doc_id; rows that are alike in all of these are interchangeable. Other columns are not looked at."""
    names = ["doc_id", *(keep or [])]
    sized = stored(docs.select(*names, "source", n_words().alias("size")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(sources, weights=weights, epochs=epochs).select(F.col("source").alias("of"), "source_size", "target")
    plan = plan.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("times", F.floor(F.round("ratio", 9)).cast("long")).withColumn("part", F.greatest(F.col("ratio") - F.col("times"), F.lit(0.0)))

    classed = sized.withColumn("class", size_class(F.col("size"))).withColumn("u", drawn(F.col("doc_id"), seed))
    counts = classed.groupBy("source", "class").agg(F.count("*").alias("docs"), F.sum("size").alias("words"))
    parts = counts.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # A source has some hundred classes at most, however many documents.
    parts = parts.groupBy("source", "source_size", "target", "times", "part").agg(F.reverse(F.array_sort(F.collect_list(F.struct("class", "docs", "words")))).alias("classes"))
    parts = parts.select("source", "source_size", "target", "times", F.explode(picks(F.col("classes"), F.col("part"))).alias("pick"))
    parts = parts.select(F.col("source").alias("of_s"), F.col("pick.class").alias("of_c"), F.col("pick.k").alias("k"), F.ceil(F.col("pick.docs") / BUCKET).alias("buckets"), "source_size", "target", "times")
    # Joins by <=> keep the null source. The small side has a row for each source and class; Spark broadcasts it only where it is small.
    placed = classed.join(parts, F.col("source").eqNullSafe(F.col("of_s")) & (F.col("class") == F.col("of_c"))).drop("of_s", "of_c")
    placed = placed.withColumn("bucket", F.floor(F.col("u") * F.col("buckets")).cast("long")).drop("buckets")
    strata = placed.groupBy("source", "class", "bucket").agg(F.count("*").alias("docs"))
    running = W.partitionBy("source", "class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    strata = strata.select(F.col("source").alias("of_s"), F.col("class").alias("of_c"), F.col("bucket").alias("of_b"), F.coalesce(F.sum("docs").over(running), F.lit(0)).alias("before"))

    inside = W.partitionBy("source", "class", "bucket").orderBy("u", "doc_id", "size")
    numbered = placed.withColumn("n", F.row_number().over(inside))
    joined = numbered.join(strata, F.col("source").eqNullSafe(F.col("of_s")) & (F.col("class") == F.col("of_c")) & (F.col("bucket") == F.col("of_b")))
    more = (F.col("before") + F.col("n") <= F.col("k")).cast("long")
    copies = F.least(F.col("times") + more, F.lit(int(epochs)).cast("long"))
    return joined.select(*names, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def picks(classes: Column, part: Column) -> Column:
    """For classes (class, docs, words), the largest size first: how many documents k of each take one more copy."""

    def step(so_far: Column, c: Column) -> Column:
        due = part * c["words"] + so_far["carry"]
        k = F.when(c["words"] == 0, 0).otherwise(F.greatest(F.least(F.round(due * c["docs"] / F.greatest(c["words"], F.lit(1))), c["docs"].cast("double")), F.lit(0.0))).cast("long")
        left = due - k * (c["words"] / c["docs"])
        return F.struct(left.alias("carry"), F.concat(so_far["list"], F.array(F.struct(c["class"].alias("class"), c["docs"].alias("docs"), k.alias("k")))).alias("list"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<class:int,docs:bigint,k:bigint>>").alias("list"))
    return F.aggregate(classes, start, step, lambda x: x["list"])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))
