"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from knotwork.llm.common import refuse, table, whole

#: Texts longer than this many characters are split before they reach the library.
BLOCK = 1 << 16
_SPACES = frozenset(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Encodes and decodes with one rank file. The pattern is applied by the library; each match is encoded by itself."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = [""] * (max(ranks.values()) + 1)
        self.bytes = [b""] * len(self.words)
        for token, rank in ranks.items():
            self.words[rank], self.bytes[rank] = str(rank), token

    def encode(self, text: str, block: int = BLOCK) -> list[int]:
        if len(text) <= block:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in safe_parts(text, block):
            ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes: a cut character or a byte that is no UTF-8 stays as it is."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(" ".join(map(self.words.__getitem__, ids)).encode()).hexdigest()


def safe_parts(text: str, block: int) -> Iterator[str]:
    """Cuts before a single blank between two characters that are not white space. No match of the pattern crosses such a place: every alternative that takes characters other than white space ends there, and the blank begins the next match. A stretch without such a place stays whole."""
    start, n = 0, len(text)
    while n - start > block:
        at = text.find(" ", start + block)
        while at != -1 and (at + 1 >= n or text[at - 1] in _SPACES or text[at + 1] in _SPACES):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return pattern


def _mapped(df: DataFrame, column: str, kind: str, make, name: str) -> DataFrame:
    """df with one more column, made from the values of one column in slices of bounded size."""
    out_name, names = name, df.columns
    if name in names:
        raise ValueError(f"{name}: the table has such a column already")

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*part.columns, make(part.column(names.index(column)))], names=[*names, out_name])

    return df.mapInArrow(run, f"{df._jdf.schema().toDDL()}, `{name}` {kind}")


def slices(batch: pa.RecordBatch, column: str | int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in one string or binary column have about `most` bytes at most, one row at least."""
    import numpy as np

    col = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
    if col.nbytes <= most:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(col.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)) // most
    starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def encode(df: DataFrame, text: str = "text", to: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds `to`, the token ids of the whole text (array<int>); null text is empty."""
    path, pattern = path or default_ranks(), _pattern(pattern)
    return _mapped(df, text, "array<int>", lambda col: pa.array([codec(path, pattern).encode(t or "") for t in col.to_pylist()], pa.list_(pa.int32())), to)


def decode(df: DataFrame, ids: str = "ids", to: str = "bytes", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds `to`, the raw bytes that the ids stand for; null ids are no ids. A column of that name must not be there."""
    refuse(df, to)
    path, pattern = path or default_ranks(), _pattern(pattern)

    def make(col):
        return pa.array([codec(path, pattern).decode(x or []) for x in col.to_pylist()], pa.binary())

    names = df.columns

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch.column(names.index(ids)))], names=[*names, to])

    return df.mapInArrow(run, f"{df._jdf.schema().toDDL()}, `{to}` binary")


def round_trip(df: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes the whole text of (doc_id, text), decodes the ids and returns digests of both.

    One pass over the rows without a shuffle; a task holds one slice of a batch. Null text is empty: no tokens, the digests of nothing. Repeated rows give repeated results; other columns are not looked at."""
    path, pattern = path or default_ranks(), _pattern(pattern)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for t in part.column(1).to_pylist():
                    ids = c.encode(t)
                    rows.append((len(ids), c.digest(ids), hashlib.sha256(c.decode(ids)).hexdigest()))
                n, a, b = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", whole().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
