"""Each row between the rows before and after it in a total order, without a task that sees all rows.

Rows are dealt by ranges of the order and sorted inside a partition, so a row's neighbours stand beside it, but for the first and the last row of a partition. These rows, two for each partition, are completed by joins on the numbers of the partitions before and after that have rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm.bpe import slices
from knotwork.llm.common import stored

Rows = list[dict]


def with_neighbours(df: DataFrame, order: list[Column], text: str, make: Callable[[Rows, Rows, Rows], Rows], out: pa.Schema, ddl: str, ring: bool = False, dealt: int | None = None) -> DataFrame:
    """make(befores, rows, afters) for all rows in slices; a list has None where there is no such row.

    In a `ring` the first row comes after the last, and a single row is its own neighbour. `order` must decide between all rows that differ in what `make` reads; rows alike are interchangeable. Rows are dealt by the first `dealt` columns of the order only (all by default), whose values the driver samples. `text` is the string column by which slices are measured. `ddl` says what `out` says."""
    from pyspark.sql.pandas.types import to_arrow_schema

    row = pa.struct(list(to_arrow_schema(df.schema)))
    full = pa.schema([*out, pa.field("__part", pa.int32()), pa.field("__first", pa.bool_()), pa.field("__last", pa.bool_()), pa.field("__a", row), pa.field("__b", row), pa.field("__c", row)])
    blank = {f.name: None for f in out}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        for batch in batches:
            for part in slices(batch, text, 1 << 21):
                if part.num_rows:
                    yield part.to_pylist()

    def run(batches):
        part = TaskContext.get().partitionId()
        done = lambda made: pa.RecordBatch.from_pylist([m | {"__part": part} for m in made], schema=full)
        edge = lambda a, b, c, first, last: pa.RecordBatch.from_pylist([blank | {"__part": part, "__first": first, "__last": last, "__a": a, "__b": b, "__c": c}], schema=full)
        # held: the last two rows so far; the last one waits for the row after it.
        held: Rows = []
        seen = 0
        for rows in rows_of(batches):
            rows = held + rows
            first = 1 if seen else 0  # of `rows`, the first that hasn't been dealt with
            if not seen and len(rows) > 1:
                yield edge(None, rows[0], rows[1], True, False)
                first = 1
            if len(rows) > 2 or (seen and len(rows) > 1):
                b = rows[first:-1]
                if b:
                    yield done(make(rows[first - 1 : -2], b, rows[first + 1 :]))
            if len(rows) > 1:
                held, seen = rows[-2:], 1
            else:
                held = rows
        if len(held) == 1:
            yield edge(None, held[0], None, True, True)
        elif held:
            yield edge(held[0], held[1], None, False, True)

    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema)
    sorted_ = df.repartitionByRange(*order[:dealt]).sortWithinPartitions(*order)
    kept = stored(sorted_.mapInArrow(run, f"{ddl}, __part int, __first boolean, __last boolean, __a struct<{inner}>, __b struct<{inner}>, __c struct<{inner}>"), "neighbours")
    done = kept.where("__first is null").drop("__part", "__first", "__last", "__a", "__b", "__c")

    # Two rows at most for each partition that has rows.
    edges = kept.where("__first is not null").select("__part", "__first", "__last", "__a", "__b", "__c")
    every, all_ = W.orderBy("__of"), W.partitionBy(F.lit(1))
    before, after = F.lag("__of").over(every), F.lead("__of").over(every)
    if ring:
        before, after = F.coalesce(before, F.max("__of").over(all_)), F.coalesce(after, F.min("__of").over(all_))
    parts = edges.where("__last").select(F.col("__part").alias("__of")).select("__of", before.alias("__before"), after.alias("__after"))
    lasts = edges.where("__last").select(F.col("__part").alias("__p"), F.col("__b").alias("__l"))
    firsts = edges.where("__first").select(F.col("__part").alias("__n"), F.col("__b").alias("__f"))
    whole = edges.join(parts, F.col("__part") == F.col("__of")).join(lasts, F.col("__before") == F.col("__p"), "left").join(firsts, F.col("__after") == F.col("__n"), "left")
    triples = whole.select(F.when(F.col("__first"), F.col("__l")).otherwise(F.col("__a")).alias("a"), F.col("__b").alias("b"), F.when(F.col("__last"), F.col("__f")).otherwise(F.col("__c")).alias("c"))

    def finish(batches):
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                yield pa.RecordBatch.from_pylist(make([r["a"] for r in rows], [r["b"] for r in rows], [r["c"] for r in rows]), schema=out)

    return done.unionByName(triples.mapInArrow(finish, ddl))
