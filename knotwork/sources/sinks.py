"""What a run leaves behind: tables by country, reports, metrics, models and the archive of a submission."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_country(df: DataFrame, path: str, rows_a_file: int = 200_000) -> None:
    """A folder for each country, files of bounded size in it; a country that was written before is written anew, others stay."""
    before = df.sparkSession.conf.get("spark.sql.sources.partitionOverwriteMode")
    df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("country").parquet(path)
    finally:
        df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_report(df: DataFrame, path: str, sep: str = ",") -> None:
    """A small table as one text file with a head."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def write_metrics(df: DataFrame, path: str) -> dict:
    """The one row of a table of metrics as JSON; returns it."""
    found = df.limit(2).collect()
    if len(found) != 1:
        raise ValueError("metrics are one row")
    out = found[0].asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1, default=str, sort_keys=True)
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def grouped_counts(rows: DataFrame) -> tuple[int, int]:
    """How many rows a grouped output has, and how many aren't empty."""
    r = rows.agg(F.count("*").alias("n"), F.count_if(F.col("matched_entity_ids") != "").alias("filled")).first()
    return r["n"], r["filled"]


def write_archive(files: dict[str, str], path: str) -> list[str]:
    """A zip with a file under each name; returns the names in it. What isn't there is an error before anything is written."""
    if missing := [p for p in files.values() if not os.path.isfile(p)]:
        raise FileNotFoundError(missing[0])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, source in sorted(files.items()):
            z.write(source, name)
        return z.namelist()


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
