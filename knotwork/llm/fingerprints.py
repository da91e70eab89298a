"""Document fingerprints: one-permutation MinHash with optimal densification, b bits of each bin.

Every shingle is hashed once. The high bits choose one of BINS bins, the bin keeps its least hash. An empty bin borrows from the bins that a hash of (bin, attempt) names, the first that isn't empty; both documents of a pair try in the same order, which keeps the estimate unbiased. Of each bin the lowest BITS bits are stored, packed. Two bins agree by chance in one of 2**BITS cases; the likeness takes this out again.

Shingles are WORDS words in a row, by their hash; a text with fewer words is one shingle. Words are hashed by prefix sums of a polynomial over the bytes of a whole slice of documents, so a slice costs some array operations, however many documents it has.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import table, whole
from knotwork.llm.neighbours import with_neighbours

WORDS, BINS, BITS = 5, 256, 4
#: Attempts by hash to fill an empty bin; then all bins in a walk.
ATTEMPTS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _low_powers(base: int) -> np.ndarray:
    p = np.full(1 << 12, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, from the first 4096 and the powers of the 4096th; nothing large is kept."""
    low = _low_powers(base)
    high = np.full((n >> 12) + 1, pow(base, 1 << 12, 1 << 64), np.uint64)
    high[0] = 1
    return (np.multiply.accumulate(high)[:, None] * low).ravel()[:n]


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one string, where each word starts and ends in it, and how many words each text has."""
    raw = b" ".join(texts)
    codes = np.frombuffer(raw + b" ", np.uint8)
    gap = _SPACE[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else sizes
    return raw, starts, ends, np.diff(np.concatenate((np.searchsorted(starts, firsts), [len(starts)])))


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(raw, np.uint8)
    n = len(codes) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(int(_BASE), n)[:-1])))
    return mixed((sums[ends] - sums[starts]) * _powers(int(_INVERSE), n)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and how many words each text has."""
    raw, starts, ends, counts = word_spans(texts)
    return span_hashes(raw, starts, ends), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text (or of all its words, if it has fewer, but some), and the text of each."""
    runs = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    of = np.repeat(np.arange(len(counts)), runs)
    if not len(of):
        return np.zeros(0, np.uint64), of
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    at = np.arange(len(of)) - np.concatenate(([0], np.cumsum(runs)[:-1]))[of] + first[of]
    length = np.minimum(counts, size)[of]
    out = np.zeros(len(of), np.uint64)
    for k in range(size):
        there = k < length
        out = np.where(there, mixed(out + np.uint64(k + 1)) + words[np.minimum(at + k, len(words) - 1)], out)
    return mixed(out ^ length.astype(np.uint64)), of


@functools.lru_cache(maxsize=4)
def _attempts(bins: int) -> np.ndarray:
    """The bins that each empty bin asks, in order: by hash, then all in a walk from a hashed start."""
    at = np.arange(bins, dtype=np.uint64)[:, None]
    tries = mixed(at * np.uint64(1 << 20) + np.arange(ATTEMPTS, dtype=np.uint64) + np.uint64(77)) % np.uint64(bins)
    walk = (mixed(at + np.uint64(12345)) + np.arange(bins, dtype=np.uint64)) % np.uint64(bins)
    return np.hstack([tries, walk]).astype(np.int64)


def fingerprint_rows(texts: list[bytes], words: int = WORDS, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """The packed fingerprint of each text; no bytes for a text without words."""
    hashes, of = shingle_hashes(*word_hashes(texts), words)
    least = np.full((len(texts), bins), ~np.uint64(0))
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    flat = of * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(least.ravel(), flat, hashes)
    there = np.zeros((len(texts), bins), bool)
    there.ravel()[flat] = True
    some = there.any(1)
    rows, cols = np.nonzero(~there & some[:, None])
    tries, filled, k = _attempts(bins), least.copy(), 0
    while len(rows):
        ask = tries[cols, k]
        hit = there[rows, ask]
        filled[rows[hit], cols[hit]] = least[rows[hit], ask[hit]]
        rows, cols, k = rows[~hit], cols[~hit], k + 1
    low = (mixed(filled) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    packed = np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(texts), -1), axis=1) if len(texts) else np.zeros((0, 0), np.uint8)
    return [packed[i].tobytes() if some[i] else b"" for i in range(len(texts))]


def likeness(a: list[bytes], b: list[bytes], bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of pairs of fingerprints, from 0 to 1, less what chance agrees; two texts without words are alike, one without and one with are not."""
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(a, b)])
    both = np.array([bool(x) and bool(y) and x != y for x, y in zip(a, b)], bool)
    if both.any():
        bit = lambda rows: np.unpackbits(np.frombuffer(b"".join(r for r, k in zip(rows, both) if k), np.uint8).reshape(int(both.sum()), -1), axis=1)
        left, right = bit(a), bit(b)
        same = (left == right).reshape(len(left), -1, bits).all(2).mean(1)
        chance = 0.5**bits
        out[both] = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters of the next document's start, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(_: list[dict], rows: list[dict], nexts: list[dict]) -> list[dict]:
    texts = [r["text"] for r in rows]
    changed = [edited(t, n["text"]).encode() for t, n in zip(texts, nexts)]
    n = len(rows)
    # In a slice the next row's text is most often the row after it; it is hashed once.
    follow = [r["text"].encode() for r in nexts]
    own = [t.encode() for t in texts]
    distinct = list(dict.fromkeys([*own, *follow, *changed]))
    prints = dict(zip(distinct, fingerprint_rows(distinct)))
    mine, theirs, after = [prints[t] for t in own], [prints[t] for t in follow], [prints[t] for t in changed]
    near_edited, near_next = likeness(mine, after), likeness(mine, theirs)
    return [
        {"doc_id": rows[i]["doc_id"], "n_chars": len(texts[i]), "edited_sha256": hashlib.sha256(changed[i]).hexdigest(), "fingerprint": mine[i].hex(), "edited_fingerprint": after[i].hex(), "near_edited": float(near_edited[i]), "near_next": float(near_next[i])}
        for i in range(n)
    ]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and their edited texts, in the order of descending doc_id.

    Null texts are empty; an empty text has the empty fingerprint. Null ids come last, repeated ids in the order of their texts. An empty table gives an empty table. The texts are dealt by ranges of doc_id once; other columns are not looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return with_neighbours(rows, [F.col("doc_id").desc_nulls_last(), F.col("text").asc()], "text", compare, OUT, DDL, ring=True, dealt=1)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
