"""Vocabularies learned from linked records: how a token of one side is written on the other, and which tokens links differ in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def aligned(pairs: DataFrame, queries: DataFrame, catalog: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(a, b, n): in how many pairs (q_id, s_id) token a of the query stands where the entity has b, in names of equal length."""
    both = pairs.select("q_id", "s_id").join(queries.select(F.col("id").alias("q_id"), F.col(tokens).alias("x")), "q_id").join(catalog.select(F.col("id").alias("s_id"), F.col(tokens).alias("y")), "s_id").where(F.size("x") == F.size("y"))
    return both.select(F.explode(F.arrays_zip("x", "y")).alias("p")).groupBy(F.col("p.x").alias("a"), F.col("p.y").alias("b")).agg(F.count("*").alias("n"))


def learned(pairs: DataFrame, queries: DataFrame, catalog: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """(a, b, n): token a is written b, where another token stands in `share` of a's places and in `least` of them. Meant for true links of a training part and for queries that were made Latin from Indic script."""
    own = W.partitionBy("a")
    ranked = aligned(pairs, queries, catalog).withColumn("total", F.sum("n").over(own)).withColumn("r", F.row_number().over(own.orderBy(F.desc("n"), "b")))
    return ranked.where((F.col("r") == 1) & (F.col("a") != F.col("b")) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("a", "b", "n")


def applied(records: DataFrame, dictionary: DataFrame, only: Column | None = None) -> DataFrame:
    """(id, tokens) of the records with their tokens replaced by the dictionary, those that `only` holds for; from the tokens as they were read, so doing it twice changes nothing."""
    wanted = records if only is None else records.where(only)
    words = wanted.select("id", F.posexplode("tokens").alias("i", "w")).join(dictionary, F.col("w") == F.col("a"), "left")
    new = words.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("b", "w").alias("t")))), lambda x: x["t"]).alias("new"))
    return records.join(new, "id", "left").select("id", F.coalesce("new", "tokens").alias("tokens"))


def noise(pairs: DataFrame, queries: DataFrame, catalog: DataFrame, most: int = 28) -> DataFrame:
    """(field, side, country, token, n, rate): the tokens that sure links most often have on one side only, by country, with how many of its links have each."""
    side = lambda d, i, p: d.select(F.col("id").alias(i), F.col("tokens").alias(f"{p}name"), F.col("addr").alias(f"{p}addr"))
    d = pairs.select("q_id", "s_id").join(side(queries, "q_id", "q").join(queries.select(F.col("id").alias("q_id"), "country"), "q_id"), "q_id").join(side(catalog, "s_id", "s"), "s_id")
    parts = [F.struct(F.lit(f).alias("field"), F.lit(s).alias("side"), F.array_except(*((f"q{f}", f"s{f}") if s == "q_only" else (f"s{f}", f"q{f}"))).alias("tokens")) for f in ("name", "addr") for s in ("q_only", "s_only")]
    each = d.select("country", F.explode(F.array(*parts)).alias("p")).select("country", "p.field", "p.side", F.explode("p.tokens").alias("token"))
    counts = each.groupBy("field", "side", "country", "token").agg(F.count("*").alias("n"))
    totals = d.groupBy("country").agg(F.count("*").alias("links"))
    order = W.partitionBy("field", "side", "country").orderBy(F.desc("n"), "token")
    ranked = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return ranked.join(totals, "country").select("field", "side", "country", "token", "n", F.round(F.col("n") / F.col("links"), 6).alias("rate"))
