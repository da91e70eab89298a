"""Rules for a file of grouped matches, as one table: rule, how many offenders, the least of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows: source1_entity_id, matched_entity_ids; records: entity_id, src. Every rule has a row, with n = 0 where it holds."""
    ids = rows.select(F.col("source1_entity_id").alias("s1"), F.filter(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: x != "").alias("ids"))
    each = ids.select("s1", F.explode("ids").alias("id"))
    s1, others = records.where("src = 'S1'").select(F.col("entity_id").alias("s1")), records.where("src <> 'S1'").select(F.col("entity_id").alias("id"))
    proper = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    found = {
        "repeated_row": ids.groupBy("s1").count().where("count > 1").select(F.col("s1").alias("x")),
        "repeated_id": ids.where(F.size("ids") > F.size(F.array_distinct("ids"))).select(F.col("s1").alias("x")),
        "self_match": each.where(F.col("id").startswith("S1-")).select(F.col("id").alias("x")),
        "wrong_prefix": each.where(~proper & ~F.col("id").startswith("S1-")).select(F.col("id").alias("x")),
        "unknown_id": each.where(proper).join(others, "id", "left_anti").select(F.col("id").alias("x")),
        "missing_entity": s1.join(ids, "s1", "left_anti").select(F.col("s1").alias("x")),
        "extra_entity": ids.join(s1, "s1", "left_anti").select(F.col("s1").alias("x")),
    }
    out = None
    for rule, bad in found.items():
        one = bad.distinct().agg(F.count("*").alias("n"), F.min("x").alias("example")).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out.select("rule", "n", "example")
