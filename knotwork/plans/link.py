"""Linkage from end to end on the record view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.operators import evaluation as E
from knotwork.operators import retrieval as R
from knotwork.operators.nearest import idf, nearest
from knotwork.plans.store import kept
from knotwork.sources.records import equal_records, er_records, sides

#: Limits of the fixture's vocabulary; the defaults of tfidf() are those for whole catalogs.
LIMITS = {"min_df": 1, "max_df": 0.3}
THRESHOLD = 0.7


def normalised(records: DataFrame) -> DataFrame:
    """id, country, name tokens and core, address tokens and numbers, and what is special about a record. Names and addresses are made Latin first."""
    name, address = X.latin("business_name"), X.latin("business_address")
    rows = records.select("src", F.col("doc_id").alias("id"), "country", "business_name", "business_address", X.is_domain("business_name").alias("is_domain"), X.has_indic("business_name").alias("has_indic"), (F.trim("business_address") == "").alias("addr_missing"), name.alias("__n"), address.alias("__a"))
    rows = rows.select("*", X.name_tokens("__n").alias("tokens"), X.address_tokens("__a").alias("addr")).drop("__n", "__a")
    return rows.withColumn("core", F.array_join(X.core(F.col("tokens")), " ")).withColumn("numbers", X.numbers(F.col("addr")))


def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of an input under their normal forms, worked out once in a run."""
    return kept(spark, sf_dir, "normalised", lambda: normalised(er_records(spark, sf_dir)))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of er_truth, from the records that a run has worked out; the texts aren't read again."""
    return equal_records(*sides(normalised_records(spark, sf_dir)), "id")


def candidates(spark: SparkSession, sf_dir: str, k: int = 10, limits: dict = LIMITS) -> DataFrame:
    """q_id, s_id, country, cos_name, cos_addr, cos_comb, rank; worked out once in a run."""

    def build() -> DataFrame:
        s1, q = sides(normalised_records(spark, sf_dir).withColumn("grams", R.name_grams(F.col("core"))))
        fields = {"cos_name": "grams", "cos_addr": "addr"}
        keep = lambda df, part: kept(spark, sf_dir, f"{name}-{part}", lambda: df)
        return nearest(s1, q, fields, idf(s1, fields, **limits), {"cos_name": 0.5, "cos_addr": 0.5}, k, "cos_comb", keep)

    name = f"candidates-{k}-{'-'.join(map(str, limits.values()))}"
    return kept(spark, sf_dir, name, build)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a fixed score p from 0.001 to 0.999; a fitted model of knotwork.operators.models takes its place where there are labels."""
    p = F.round(F.least(F.greatest(0.6 * F.col("cos_name") + 0.4 * F.col("cos_addr"), F.lit(0.001)), F.lit(0.999)), 6)
    return candidates(spark, sf_dir).withColumn("p", p)


def linked_pairs(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return E.top3(scored(spark, sf_dir)).where(F.col("p1") >= threshold).select("q_id", "s_id", "p1")
