"""Tables that a run works out once: written as Parquet into the folder that driver and executors share, and read by every later step."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows, written once for a session and an input. Without spark.checkpoint.dir there is no shared folder, and they are worked out each time."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return build()
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select("path", "length", "modificationTime").collect()
    # Another state of the input has other files, or the same ones with other sizes or times.
    key = (spark.sparkContext.applicationId, name, hashlib.sha256(repr(sorted(map(tuple, files))).encode()).hexdigest())
    if key not in _KEPT:
        path = f"{folder.rstrip('/')}/knotwork/{name}-{uuid.uuid4().hex}"
        rows = build()
        rows.write.parquet(path)
        _KEPT[key] = spark.read.schema(rows.schema).parquet(path)
    return _KEPT[key]
