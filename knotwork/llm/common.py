"""What the training-data operators share: words, tables and files that outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space bytes; Java's and Python's regex read it alike.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space between words.
GAP = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z only.
LOWER_ASCII = str.maketrans(_UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to and from Python at once where whole texts do.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets the session send ROWS rows at once between Spark and Python at most, so that batches of long texts stay small on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ROWS:
        spark.conf.set(name, str(ROWS))


def whole(text: str | Column = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def refuse(df: DataFrame, *names: str) -> None:
    """An error where a column of such a name is there already."""
    if there := [n for n in names if n.lower() in {c.lower() for c in df.columns}]:
        raise ValueError(f"there is a column {there[0]} already")


def unit_hash(*columns: Column, seed: int) -> Column:
    """A seeded number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On a cluster spark.checkpoint.dir names it; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="knotwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: its lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/knotwork/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Bits of a filter of ids, whatever the corpus.
FILTER = 1 << 26


class IdFilter:
    """One bit for each hash of an id: rows whose bit isn't set have none of the ids; for the others a join decides. It keeps most texts out of a shuffle where the ids are few against FILTER, and lets more through where they aren't."""

    def __init__(self, ids: DataFrame, name: str = "doc_id"):
        at = self._at(name)
        got = ids.select(F.floor(at / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(FILTER // 32, np.uint32)
        bits[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
        self.shared = ids.sparkSession.sparkContext.broadcast(bits)

    @staticmethod
    def _at(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(FILTER))

    def maybe(self, df: DataFrame, name: str = "doc_id", there: bool = True) -> DataFrame:
        """The rows of df that may have one of the ids, or with `there` False all others. Rows without an id have none."""
        shared, columns = self.shared, df.columns

        def run(batches):
            bits = shared.value
            for batch in batches:
                h = batch.column(len(columns)).to_numpy()
                hit = (bits[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool) & batch.column(len(columns) + 1).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == there)).select(range(len(columns)))

        rows = df.select("*", self._at(name).alias(fresh(df, "h")), F.col(name).isNotNull().alias(fresh(df, "i")))
        return rows.mapInArrow(run, df._jdf.schema().toDDL())


def without_ids(df: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """df's rows whose id isn't among ids; only rows that the filter can't tell are shuffled."""
    found = IdFilter(ids, name)
    return found.maybe(df, name, there=False).unionByName(found.maybe(df, name).join(ids.select(name), name, "left_anti").select(df.columns))
