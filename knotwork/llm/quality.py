"""Quality classifier: random Fourier features over document statistics, ridge by partition-summed normal equations, isotonic calibration.

The cosines of random projections approximate a Gaussian kernel, so a linear ridge fit on them is a kernel ridge fit whose size doesn't depend on the rows. Each partition sums its outer products, for each fold apart; the driver adds these sums, which are as many as the fit has partitions (FIT_PARTS), solves for the weights with and without each fold, and fits the isotonic curve on the scores of the left-out folds.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.bpe import slices
from knotwork.llm.common import refuse, remainder, stored, table, unit_hash, whole

SEED = 8
#: Random features, ridge penalty, folds for calibration.
FEATURES, RIDGE, FOLDS = 256, 1e-3, 4
#: The fit uses this many labelled rows at most, by a hash of the id; all rows are scored.
MOST_LABELS = 200_000
#: Partitions of the fit, so of the sums that reach the driver.
FIT_PARTS = 8
#: Bins of the left-out scores on which the isotonic curve is fitted.
BINS = 1024
STATS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "long_words", "short_words", "upper", "digits", "symbols", "bars", "spaces", "non_ascii", "distinct_words", "top_word", "bang_words",
    "log_lines", "line_length", "repeated_lines", "ended_lines", "commas", "stops", "capital_words", "repeated_trigrams", "run",
)

_KIND = np.zeros(256, np.int8)  # 0 other
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!@#$%^&*_=+~<>{}[]\\/`", b"|", b" \t\n\r\x0b\x0c", b",", b".?!;:"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 8


def statistics(text: str) -> list[float]:
    """STATS of one whole text; all of them finite, for the empty text too."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(STATS)
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_KIND[codes], minlength=9) / n
    words = text.split()
    lines = text.split("\n")
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    full = [x for x in (y.strip() for y in lines) if x]
    m = max(1, len(full))
    trigrams = len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 1
    same = np.flatnonzero(np.diff(codes)) if n > 1 else np.zeros(0, int)
    longest = int(np.max(np.diff(np.concatenate(([-1], same, [n - 1]))))) if n > 1 else 1
    return [
        math.log1p(len(text)), math.log1p(len(words)), min(float(sizes.mean()), 50.0), min(float(sizes.std()), 50.0), float((sizes > 12).mean()), float((sizes < 4).mean()), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[8], len(counts) / w, max(counts.values(), default=0) / w, sum(x[-1] in "!$%&*#" for x in words) / w,
        math.log1p(len(full)), math.log1p(len(text) / m), 1 - len(set(full)) / m if full else 0.0, sum(x[-1] in ".?!" for x in full) / m, kinds[6], kinds[7], sum(x[:1].isupper() for x in words) / w, 1 - trigrams / max(1, len(words) - 2), math.log1p(longest),
    ]


def statistics_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(len(texts), len(STATS))


@dataclass
class Model:
    """What is broadcast: its size depends on FEATURES, STATS and BINS only."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    beta: np.ndarray
    steps: np.ndarray
    values: np.ndarray
    prior: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        raw = features(self.mean, self.scale, self.weights, stats) @ self.beta
        return np.clip(np.interp(raw, self.steps, self.values), 0.0, 1.0) if len(self.steps) else np.full(len(stats), self.prior)


def projections(seed: int = SEED, n: int = FEATURES) -> np.ndarray:
    """Frequencies of a Gaussian kernel whose width is the square root of the number of statistics; the last row is the phase."""
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=(len(STATS), n)) / math.sqrt(len(STATS)), rng.uniform(0, 2 * math.pi, n)])


def features(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, stats: np.ndarray) -> np.ndarray:
    z = np.clip((stats - mean) / scale, -8, 8)
    cosines = np.cos(z @ weights[:-1] + weights[-1]) * math.sqrt(2 / weights.shape[1])
    return np.hstack([np.ones((len(stats), 1)), cosines])


def isotonic(at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over increasing `at`: the middles of the blocks and their values."""
    blocks: list[list[float]] = []
    for x, v, w in zip(at, y, weight):
        blocks.append([x * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                stats = statistics_of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(STATS)).cast(pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return docs.select("doc_id", whole().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELS, seed: int = SEED) -> Model:
    """Fits on the rows of `stats` (doc_id, stats) that `labels` (doc_id, label) marks. Several labels of one id count by their mean; null labels and ids don't count. Without two different labels the score is the labels' mean, 0.5 without any."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    rows = stats.join(marked, "doc_id").select("doc_id", "stats", "y", unit_hash("doc_id", seed=seed).alias("u"))
    rows = stored(rows, "labelled")
    n = rows.count()
    used = rows.where(F.col("u") < most / n) if n > most else rows
    weights = projections(seed)
    few = used.coalesce(FIT_PARTS)
    d = len(STATS)

    def moments(batches):
        total = np.zeros(2 * d + 3)
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
                total += np.concatenate([[len(x), y.sum(), (y * y).sum()], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    first = sum((np.frombuffer(r[0]) for r in few.select("stats", "y").mapInArrow(moments, "part binary").collect()), np.zeros(2 * d + 3))
    count, ysum = first[0], first[1]
    if not count or first[2] / count - (ysum / count) ** 2 < 1e-12:
        return Model(np.zeros(d), np.ones(d), weights, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0), float(ysum / count) if count else 0.5)
    mean = first[3 : 3 + d] / count
    scale = np.sqrt(np.maximum(first[3 + d :] / count - mean**2, 1e-12)) + 1e-3
    k = FEATURES + 1

    def sums(batches):
        gram, right = np.zeros((FOLDS, k, k)), np.zeros((FOLDS, k))
        for b in batches:
            if b.num_rows:
                x, y, u = features(mean, scale, weights, _matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                f = (u * (1 << 20)).astype(np.int64) % FOLDS
                for i in range(FOLDS):
                    gram[i] += x[f == i].T @ x[f == i]
                    right[i] += x[f == i].T @ y[f == i]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    gram, right = np.zeros((FOLDS, k, k)), np.zeros((FOLDS, k))
    for r in few.select("stats", "y", "u").mapInArrow(sums, "gram binary, right binary").toLocalIterator():
        gram += np.frombuffer(r[0]).reshape(gram.shape)
        right += np.frombuffer(r[1]).reshape(right.shape)
    solve = lambda g, r: np.linalg.solve(g + RIDGE * max(1.0, g[0, 0]) / k * np.eye(k), r)
    beta = solve(gram.sum(0), right.sum(0))
    others = np.stack([solve(gram.sum(0) - gram[i], right.sum(0) - right[i]) for i in range(FOLDS)])
    low, high = -0.5, 1.5

    def left_out(batches):
        seen = np.zeros((3, BINS))
        for b in batches:
            if b.num_rows:
                x, y, u = features(mean, scale, weights, _matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                raw = (x * others[(u * (1 << 20)).astype(np.int64) % FOLDS]).sum(1)
                at = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
                for i, v in enumerate((np.ones(len(y)), y, raw)):
                    seen[i] += np.bincount(at, v, BINS)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], names=["part"])

    seen = sum((np.frombuffer(r[0]).reshape(3, BINS) for r in few.select("stats", "y", "u").mapInArrow(left_out, "part binary").collect()), np.zeros((3, BINS)))
    there = seen[0] > 0
    steps, values = isotonic(seen[2][there] / seen[0][there], seen[1][there] / seen[0][there], seen[0][there])
    return Model(mean, scale, weights, beta, steps, values, float(ysum / count))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), len(STATS))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for rows (doc_id, stats)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELS, seed: int = SEED) -> Model:
    """fit for documents whose statistics aren't there yet: they are worked out for the labelled rows that the fit uses only, `most` at the most, by a hash of the id."""
    used = stored(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias(label)), "marked")
    n = used.count()
    if n > most:
        used = used.where(unit_hash("doc_id", seed=seed) < most / n)
    rows = docs.join(F.broadcast(used.select("doc_id")) if most <= MOST_LABELS else used.select("doc_id"), "doc_id", "left_semi")
    return fit(with_statistics(rows), used, label, most, seed)


def with_score(docs: DataFrame, model: Model, to: str = "score", text: str = "text") -> DataFrame:
    """docs with one more column, the score of the whole text, from one pass over the rows; null text is empty. A column of that name must not be there."""
    refuse(docs, to)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                score = model.score(statistics_of([t or "" for t in part.column(names.index(text)).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*names, to])

    return docs.mapInArrow(run, f"{docs._jdf.schema().toDDL()}, `{to}` double")


def classified(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null texts count as empty and get a score like any other; repeated rows get repeated results; without usable labels every score is 0.5. Columns other than doc_id and text are not looked at."""
    modulus, left = held_out
    stats = stored(with_statistics(docs), "stats")
    model = fit(stats, labels.where(remainder("doc_id", modulus) != left))
    out = scored(stats, model)
    return out.select("doc_id", (remainder("doc_id", modulus) == left).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
