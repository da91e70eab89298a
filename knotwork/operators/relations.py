"""Small relational pieces: row numbers, validated and ordered joins, bins, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.operators.evaluation import bucket

#: Keys in a bucket of running_before.
BUCKET = 4096


def running_before(df: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """df with the sum of `value` over the rows before each one by a whole-number key. In two steps: the buckets' running sums, a row for BUCKET keys, then sums inside a bucket; so no task sorts all rows."""
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("__b", F.floor(F.col(key) / BUCKET))
    sums = rows.groupBy("__b").agg(F.sum(value).alias("__n"))
    starts = sums.select("__b", before(W.orderBy("__b"), "__n").alias("__at"))
    rows = rows.withColumn("__i", before(W.partitionBy("__b").orderBy(key), value))
    return rows.join(starts, "__b").withColumn(to, F.col("__at") + F.col("__i")).drop("__b", "__i", "__at")


def with_row_index(df: DataFrame, key: str, to: str = "index") -> DataFrame:
    """df with the place of each row by a whole-number key, from 0."""
    return running_before(df.withColumn("__one", F.lit(1)), key, "__one", to).drop("__one")


def place_by_hash(df: DataFrame, group: list[str], key: str, place: str, of: str) -> DataFrame:
    """df with the place of each row of a group, from 1, in the order of the MD5 of its key, and the group's number of rows. In two steps: running counts of 4096 hash buckets of a group, then places inside a bucket; so no task sorts a group."""
    hashed = F.md5(F.col(key).cast("string").cast("binary"))
    rows = df.withColumn("__h", hashed).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(c).alias(f"__{c}") for c in group), F.col("__b").alias("__c"), before.alias("__at"), F.sum("__n").over(W.partitionBy(*group)).alias(of))
    inside = rows.withColumn("__i", F.row_number().over(W.partitionBy(*group, "__b").orderBy("__h", key)))
    same = F.col("__b") == F.col("__c")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return inside.join(starts, same).select(*df.columns, (F.col("__at") + F.col("__i")).alias(place), of)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that fails where the right side has a key twice. The check is a part of the plan, not a job of its own."""
    counted = right.withColumn("__n", F.count("*").over(W.partitionBy(*on)))
    message = F.concat(F.lit("more than one row for "), F.concat_ws(", ", *(F.col(c).cast("string") for c in on)))
    single = counted.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(message).cast("long")).otherwise(F.col("__n")))
    return left.join(single.where("__n = 1").drop("__n"), on, how)


def join_in_order(left: DataFrame, right: DataFrame, on: list[str], index: str) -> DataFrame:
    """A left join whose rows come in the order of the left side's index."""
    return left.join(right, on, "left").orderBy(index)


def binned(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Labels of right-closed bins (a, b]; one label more than edges."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(x <= edge, label).otherwise(out)
    return F.when(x.isNull(), None).otherwise(out)


def sampled(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """The rows whose key's hash falls in the share; the same rows in every run."""
    return df.where(bucket(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))), 10_000) < int(share * 10_000))
