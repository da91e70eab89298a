"""From raw documents to token ids: quality, near duplicates, personal data, the mix of sources, byte-level BPE.

run(spark, sf_dir) applies STAGES to `documents`. Each stage reads what the one before wrote, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm import bpe, mixing, ngram_join, pii, quality
from knotwork.llm.common import fresh, remainder, small_batches, stored, table, without_ids

#: Documents from this score on stay. Lower than the classifier's own decision (0.7): a doubtful document is kept.
KEEP = 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. It learns from the labels of rows outside the held-out part; an id that isn't there, and a null, empty or very long text, are scored like any other. An empty table stays one."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    model = quality.fit_on(docs, labels)
    score = fresh(docs, "score")
    return quality.with_score(docs, model, score).where(F.col(score) >= KEEP).select(docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words from 0.8 on: of each group the document with the least id stays, of rows with one id one. Rows without an id and texts without words stay; texts of any length are compared whole; an empty table stays one."""
    found = stored(ngram_join.joined(docs), "groups")
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = without_ids(docs, gone)
    twice = stored(found.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 and doc_id is not null").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    n = fresh(docs, "n")
    first = W.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    again = kept.join(twice, "doc_id", "left_semi").withColumn(n, F.row_number().over(first)).where(F.col(n) == 1)
    return without_ids(kept, twice).unionByName(again.select(docs.columns))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: valid numbers, dates and addresses under pseudonyms of their format, n_chars set anew. Null, empty and very long texts, repeated rows and an empty table go through as they are."""
    out = pii.pseudonymised(docs, pii.key_of(spark))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix takes it, so with no, one or more rows. Texts without words, null ones too, weigh nothing and are taken as often as others of their source; a null source is one of its own; an empty table stays one. Of rows alike in all columns any may stand for another, but together they are taken as often as the mix says."""
    row, of, all_, alike, n = (fresh(docs, x) for x in ("row", "of", "all", "alike", "n"))
    rows = docs.withColumn(row, F.xxhash64(*docs.columns))
    copies = mixing.mixed(rows, keep=[row]).groupBy("doc_id", row).agg(F.sum("copies").alias(all_), F.count("*").alias(alike)).where(F.col(all_) > 0)
    joined = rows.join(copies.select(F.col(row).alias(of), F.col("doc_id").alias("same_id_" + of), all_, alike), (F.col(row) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col("same_id_" + of)))
    each = F.floor(F.col(all_) / F.col(alike))
    even = joined.where(F.col(all_) % F.col(alike) == 0).withColumn(n, each)
    # Only where alike rows differ in how often they are taken: the first ones take one more.
    odd = joined.where(F.col(all_) % F.col(alike) > 0)
    odd = odd.withColumn(n, each + (F.row_number().over(W.partitionBy("doc_id", row).orderBy(row)) <= F.col(all_) % F.col(alike)).cast("long"))
    copy = fresh(docs, "copy")
    return even.unionByName(odd).where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of each row's whole text, and that they decode to it. Null and empty texts have no ids; an empty table gives an empty one."""
    return bpe.round_trip(docs)


STAGES = [("quality", good), ("near duplicates", single), ("personal data", private), ("mix", mixed), ("tokens", encoded)]

#: Random features, hashes and a library's tokens are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
