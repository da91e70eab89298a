"""Record sources: tab-separated files without quoting, and the record view of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from knotwork.functions.text import words

RECORD = StructType([StructField(n, StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(n, StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: StructType = RECORD, quoted: bool = False) -> DataFrame:
    """All columns as text, quotes as characters (unless quoted), empty fields as ''."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE")
    return (reader if quoted else reader.option("quote", "")).csv(path).na.fill("")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRUTH)


def truth_links(truth: DataFrame) -> DataFrame:
    """One row for each matched id."""
    ids = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
    return truth.select("source1_entity_id", F.explode(ids).alias("entity_id"))


def grouped(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every catalog record with its ids sorted and joined by commas, '' without any. s1: entity_id; pairs: s1_id, q_id."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("q_id")), ",").alias("ids"))
    return s1.join(lists, F.col("entity_id") == F.col("s1_id"), "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def write_grouped(rows: DataFrame, path: str) -> None:
    """emptyValue keeps an empty list empty; Spark would write two quotes."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def er_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources of business records from `documents`: the id modulo 3 is the source, the language the country, words 1 to 4 the name, 5 to 12 the address."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("country"), words("text", 12).alias("t"))
    src = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"))
    return docs.select(src.alias("src"), F.concat_ws("-", src, F.col("doc_id").cast("string")).alias("entity_id"), "doc_id", "country", F.array_join(F.slice("t", 1, 4), " ").alias("business_name"), F.array_join(F.slice("t", 5, 8), " ").alias("business_address"))


def sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog, and the records to link."""
    return records.where("src = 'S1'"), records.where("src <> 'S1'")


def er_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, s_id): for each record the least catalog id with equal name, address and country."""
    return equal_records(*sides(er_records(spark, sf_dir)), "doc_id")


def equal_records(s1: DataFrame, q: DataFrame, id: str) -> DataFrame:
    key = ["country", "business_name", "business_address"]
    least = s1.groupBy(*key).agg(F.min(id).alias("s_id"))
    return q.join(least, key).select(F.col(id).alias("q_id"), "s_id")
