"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Written characters may stand for others (leet), be dropped again (separators and blanks between letters) or repeat one. Each stretch that may be such writing becomes a lattice of characters; the Viterbi path under a character trigram model, weighed with what each piece of the channel costs, is the restored stretch. Stretches without a choice are left alone. The trigram model is counted over all documents: pairs of letters exactly, trigrams in a fixed number of cells by hash, so the rarest of a large corpus share cells and none is left out. Latin letters have a symbol each, all other letters share OTHERS symbols by their code points.

The score comes from words of the restored text and from their beginnings: how much more often labelled toxic texts have them than clean ones, counted in one part of the labelled rows, then a logistic fit in the other part on how many such words a text has, how strong they are and how long the text is.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.bpe import slices
from knotwork.llm.common import dropped, remainder, stored, table, unit_hash, whole
from knotwork.llm.fingerprints import span_hashes, word_spans

SEED = 7
#: What a written sign may stand for, besides itself. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
#: Signs that may stand between the letters of a word.
BETWEEN = frozenset(" .-_*~'`,^")
#: Natural logarithms: of reading a sign as another, of dropping a sign between letters, of dropping one of equal letters, of keeping a sign that is no letter.
COST_LEET, COST_DROP, COST_REPEAT, COST_SIGN = -1.5, -0.7, -0.7, -6.0
#: Bits of a symbol, and of the number of cells that count trigrams.
SYMBOL, CELLS = 10, 20
#: The fit uses this many labelled rows at most, by a hash of the id; all rows are scored.
MOST_LABELS = 60_000
#: A word's start must be in so many toxic texts of the labelled sample to count.
LEAST_SEEN = 4
#: Starts of words of these lengths count beside the word.
STARTS = (3, 4, 5, 6, 7, 8)
EVIDENCE = 1.5  # log ratio from which a word counts

_LETTER = r"[^\W\d_]"
# What may be one written word: letters, and signs that may be letters or stand between them, in any place and number.
_STRETCH = re.compile(rf"(?:{_LETTER}|[{re.escape(''.join({*LEET, *BETWEEN} - {' '}))}])+")
_WORD = re.compile(rf"{_LETTER}+")
_DOUBLE = re.compile(r"(.)\1")
_TRIPLE = re.compile(r"(.)\1\1")
#: Marks that end a token and belong to no word.
_ENDS = ".,;:!?\"')&%"
#: Single characters with white space between each two.
_SPACED = re.compile(r"(?<!\S)\S\s+(?:\S\s+)+\S(?!\S)")
#: At a word's end these are most often no letter.
_MARKS = frozenset("!*")


def _noisy(stretch: str) -> bool:
    """Whether a stretch has a choice: letters with signs, or a letter twice in a row."""
    return _DOUBLE.search(stretch.lower()) is not None if stretch.isalpha() else _WORD.search(stretch) is not None


#: Letters up to here count by themselves, later ones by their code point modulo OTHERS; all other characters count as a blank.
_LATIN = 0x250
OTHERS = (1 << SYMBOL) - _LATIN
_BLANK = ord(" ")


@functools.cache
def _symbols() -> np.ndarray:
    kinds = np.full(0x110000, _BLANK, np.uint32)
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    at = np.flatnonzero(alpha)
    kinds[at] = np.where(at < _LATIN, at, _LATIN + at % OTHERS)
    return kinds


_SPREAD = 6946789817


def _cell(code):
    """The cell of a trigram's code; the product is below 2**63."""
    return code * _SPREAD // (1 << 24) % (1 << CELLS)


@dataclass
class Channel:
    """A character trigram model with add-k smoothing and back-off by interpolation: counts of trigrams by cell, of what begins them and of what ends them by pair of symbols. Its size is fixed."""

    cells: np.ndarray
    starts: np.ndarray
    pairs: np.ndarray

    def __post_init__(self):
        square = self.pairs.reshape(1 << SYMBOL, 1 << SYMBOL).astype(np.int64)
        self.befores, self.singles = square.sum(1).tolist(), square.sum(0).tolist()
        self.total = sum(self.singles)
        self.symbols: dict[str, int] = {}
        self.seen: dict[str, float] = {}
        self.memo: dict[str, str] = {}
        self.tokens: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def of(codes: np.ndarray, times: np.ndarray) -> Channel:
        size = 1 << 2 * SYMBOL
        counted = lambda at, n: np.bincount(at, times, n).astype(np.uint32)
        return Channel(counted(_cell(codes.astype(np.int64)), 1 << CELLS), counted(codes >> SYMBOL, size), counted(codes & (size - 1), size))

    def _symbol(self, c: str) -> int:
        got = self.symbols.get(c)
        if got is None:
            got = self.symbols[c] = (ord(c) if ord(c) < _LATIN else _LATIN + ord(c) % OTHERS) if c.isalpha() else _BLANK
        return got

    def logp(self, context: str, c: str) -> float:
        key = context + c
        got = self.seen.get(key)
        if got is None:
            x, y, z = map(self._symbol, key)
            start, pair = x << SYMBOL | y, y << SYMBOL | z
            p1 = (self.singles[z] + 0.1) / (self.total + 100)
            p2 = (int(self.pairs[pair]) + 4 * p1) / (self.befores[y] + 4)
            got = math.log((int(self.cells[_cell(start << SYMBOL | z)]) + 4 * p2) / (int(self.starts[start]) + 4))
            if len(self.seen) < 1_000_000:
                self.seen[key] = got
        return got

    def decode(self, written: str) -> str:
        """The likeliest reading of one stretch. Runs of one letter keep one or two of it."""
        got = self.memo.get(written)
        if got is None:
            got = self._decode(written)
            if len(self.memo) < 100_000:
                self.memo[written] = got
        return got

    @staticmethod
    def moves(text: str, i: int, spaced: bool) -> list[tuple[str, float]]:
        """What the i-th character of a written stretch may stand for, and what each reading costs. In a `spaced` stretch every second character is one that may stand between letters."""
        c, moves = text[i], []
        if c.isalpha():
            moves.append((c, 0.0))
            if i and text[i - 1] == c:
                # Two of a letter are most often meant.
                moves.append(("", COST_REPEAT if text[i - 2 : i - 1] == c or text[i + 1 : i + 2] == c else 4 * COST_REPEAT))
            return moves
        moves.extend((x, COST_LEET) for x in LEET.get(c, ""))
        inside = 0 < i < len(text) - 1
        if c in BETWEEN and inside:
            moves.append(("", 0.0 if spaced else COST_DROP))
            moves.append((" ", COST_LEET))
        if not moves or not inside:
            moves.append((" ", COST_SIGN if moves and not (i and c in _MARKS) else 0.0))
        return moves

    def _decode(self, written: str) -> str:
        text = written.lower()
        spaced = len(text) > 2 and all(c in BETWEEN for c in text[1::2])
        # state: the last two characters -> (score, the string so far as a chain)
        states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
        for i in range(len(text)):
            moves = self.moves(text, i, spaced)
            after: dict[str, tuple[float, tuple | None]] = {}
            for state, (score, chain) in states.items():
                for x, cost in moves:
                    s = score + cost + (self.logp(state, x) if x else 0.0)
                    to = state[1:] + x if x else state
                    if to not in after or s > after[to][0]:
                        after[to] = (s, (chain, x) if x else chain)
            states = after
        best = max(((s + self.logp(state, " "), chain) for state, (s, chain) in states.items()), key=lambda z: z[0])[1]
        out = []
        while best is not None:
            best, x = best
            out.append(x)
        return "".join(reversed(out))

    def restore(self, text: str) -> str:
        """The text in lower case with its obfuscated stretches restored."""
        text = _SPACED.sub(lambda m: self.decode(" ".join(m.group().split())), text)
        return _STRETCH.sub(lambda m: self.decode(m.group()) if _noisy(m.group()) else m.group(), text).lower()

    def token(self, token: str) -> tuple[str, ...]:
        """The words of what stands between white space."""
        # Most tokens are letters with marks around them: the marks are none of the word.
        core = token.rstrip(_ENDS).lstrip("\"'(")
        if core[-3:] in ("$$$", "***", "###"):
            core = core[:-3].rstrip(_ENDS)
        if core.isalpha():
            low = core.lower()
            if not _DOUBLE.search(low):
                return (low,)
            if not _TRIPLE.search(low) and low.isalpha():
                return (self.undoubled(low),)
            return tuple(_WORD.findall(self.decode(low)))
        return tuple(_WORD.findall(self.restore(token)))

    def undoubled(self, word: str) -> str:
        """decode(word) for letters of which none stands more than twice in a row. After the letter behind a double one both its readings are in the same state, so each is decided by itself."""
        out, last = [word[0]], len(word) - 1
        for i in range(1, len(word)):
            c = word[i]
            if c == word[i - 1]:
                before, after = word[i - 2] + c if i > 1 else " " + c, word[i + 1] if i < last else " "
                if self.logp(before, after) + 4 * COST_REPEAT > self.logp(before, c) + self.logp(c + c, after):
                    continue
            out.append(c)
        return "".join(out)

    def words(self, text: str) -> Counter:
        """How often the restored text has each word. Stretches lie within what stands between white space, or are single characters with blanks between; so each distinct token is restored once."""
        out: Counter = Counter()
        single = 0
        for token, n in Counter(w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").lower().split()).items():
            got = self.tokens.get(token)
            if got is None:
                got = self.token(token)
                if len(self.tokens) > 200_000:
                    self.tokens.clear()
                self.tokens[token] = got
            for w in got:
                out[w] += n
            if len(token) == 1:
                single += n
        if single > 2:
            out.update(self.spaced(text))
        return out

    def spaced(self, text: str) -> list[str]:
        """The words of single characters with blanks between."""
        return [w for m in _SPACED.finditer(text) for w in _WORD.findall(self.decode(" ".join(m.group().split())))]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all character trigrams of the words of a text, each word as if between blanks, and their counts."""
    at = np.concatenate(([_BLANK, _BLANK], _symbols()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)], [_BLANK])).astype(np.uint32)
    last, middle, first = at[2:], at[1:-1], at[:-2]
    first = np.where(middle == _BLANK, np.uint32(_BLANK), first)
    there = (last != _BLANK) | (middle != _BLANK)
    bits = np.uint32(SYMBOL)
    return np.unique((((first << bits) | middle) << bits | last)[there], return_counts=True)


def letter_counts(docs: DataFrame) -> Channel:
    """The trigram model of all words of all documents, words between blanks. What the driver gets is bounded by the numbers of cells and of pairs of symbols."""

    def run(batches):
        codes, times = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for batch in batches:
            for part in slices(batch, 0, 1 << 21):
                c, n = trigrams(" ".join(part.column(0).to_pylist()))
                codes.append(c)
                times.append(n)
            if len(codes) > 8:
                codes, times = ([x] for x in summed(codes, times))
        c, n = summed(codes, times)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n)], names=["t", "n"])

    def summed(codes: list, times: list) -> tuple[np.ndarray, np.ndarray]:
        c, back = np.unique(np.concatenate(codes), return_inverse=True)
        return c, np.bincount(back, np.concatenate(times), len(c)).astype(np.int64)

    counts = stored(docs.select(whole().alias("text")).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")), "letters")

    def gathered(at, n: int) -> np.ndarray:
        got = counts.groupBy(at.cast("long").alias("at")).agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(n, np.uint32)
        out[got.column("at").to_numpy()] = np.minimum(got.column("n").to_numpy(), 2**32 - 1)
        return out

    t, size = F.col("t"), 1 << 2 * SYMBOL
    out = Channel(gathered(F.expr(f"t * {_SPREAD} div {1 << 24} % {1 << CELLS}"), 1 << CELLS), gathered(F.expr(f"t div {1 << SYMBOL}"), size), gathered(t % size, size))
    dropped(counts)
    return out


@functools.lru_cache(maxsize=200_000)
def _starts(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "-" for k in STARTS if k < len(word)))


def features(words: list[str]) -> set[str]:
    out: set[str] = set()
    for w in words:
        if len(w) > 2:
            out.update(_starts(w))
    return out


@dataclass
class Model:
    """What is broadcast: the channel, and the weights, which the labelled sample bounds."""

    channel: Channel
    weights: dict[str, float]
    beta: np.ndarray
    prior: float
    memo: dict[str, float] = field(default_factory=dict)
    heads: frozenset[str] = field(init=False)
    seen: dict[int, int] = field(default_factory=dict)
    told: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self):
        self.heads = frozenset(f[:3] for f in self.weights)

    def word(self, w: str) -> float:
        if w[:3] not in self.heads:
            return 0.0
        got = self.memo.get(w)
        if got is None:
            got = max((self.weights.get(x, 0.0) for x in _starts(w)), default=0.0)
            if len(self.memo) < 500_000:
                self.memo[w] = got
        return got

    def evidence(self, words: Counter) -> list[float]:
        """The constant, how many distinct toxic words, the strongest, the strongest three, all, their share of the words, their times, the length."""
        return self._evidence({w: (x, n) for w, n in words.items() if (x := self.word(w)) > EVIDENCE}, words.total())

    @staticmethod
    def _evidence(found: dict[str, tuple[float, int]], n: int) -> list[float]:
        strong, times = sorted((x for x, _ in found.values()), reverse=True), sum(k for _, k in found.values())
        return [1.0, math.log1p(len(strong)), (strong[0] if strong else 0.0), sum(strong[:3]), math.log1p(sum(strong)), math.log1p(100 * times / max(1, n)), math.log1p(times), math.log1p(n)]

    def _token(self, h: int, token: str) -> int:
        """What a token has to say, worked out once: how many words it has, whether it is a single character, whether any word is evidence (that is in `told`)."""
        words = self.channel.token(token)
        if hits := tuple((w, x) for w in words if (x := self.word(w)) > EVIDENCE):
            self.told[h] = hits
        got = self.seen[h] = len(words) << 2 | (len(token) == 1) << 1 | bool(hits)
        return got

    def evidences(self, texts: list[str]) -> np.ndarray:
        """evidence(channel.words(text)) of each text. Tokens are told apart by their hash, so that only those not met before are read one by one."""
        if len(self.seen) > 400_000:
            self.seen.clear()
            self.told.clear()
        raw, starts, ends, counts = word_spans([t.encode("utf-8", "replace").lower() for t in texts])
        hashes, first, back = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        said = [self.seen.get(h) for h in hashes.tolist()]
        for i, x in enumerate(said):
            if x is None:
                k = first[i]
                said[i] = self._token(int(hashes[i]), raw[starts[k] : ends[k]].decode("utf-8", "replace"))
        said, of = np.array(said, np.int64)[back], np.repeat(np.arange(len(texts)), counts)
        totals, singles = (np.bincount(of, v, len(texts)).astype(np.int64).tolist() for v in (said >> 2, said >> 1 & 1))
        found: list[dict[str, tuple[float, int]]] = [{} for _ in texts]
        hit = np.flatnonzero(said & 1)
        for d, h in zip(of[hit].tolist(), hashes[back[hit]].tolist()):
            for w, x in self.told[h]:
                found[d][w] = (x, found[d].get(w, (x, 0))[1] + 1)
        for d, n in enumerate(singles):
            if n > 2:
                for w in self.channel.spaced(texts[d]):
                    totals[d] += 1
                    if (x := self.word(w)) > EVIDENCE:
                        found[d][w] = (x, found[d].get(w, (x, 0))[1] + 1)
        return np.array([self._evidence(f, n) for f, n in zip(found, totals)]).reshape(len(texts), -1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidences(texts) @ self.beta, -30, 30))) if len(self.beta) and len(texts) else np.full(len(texts), self.prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELS, seed: int = SEED) -> Model:
    """Counts the channel over all of `docs`, fits the score on the rows that `labels` marks. Several labels of one id count by their mean, from a half on as 1; null labels and ids don't count. Without two different labels every score is their mean, 0.5 without any."""
    channel = letter_counts(docs)
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).alias("y"))
    marked = stored(marked.withColumn("u", unit_hash("doc_id", seed=seed)), "marked")
    n = marked.count()
    used = marked.where(F.col("u") < most / n) if n > most else marked
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(used), "doc_id") if most <= MOST_LABELS else docs.select("doc_id", whole().alias("text")).join(used, "doc_id")

    def restore(batches):
        for batch in batches:
            for part in slices(batch, 0):
                words = [channel.words(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array([list(w.values()) for w in words], pa.list_(pa.int64())), part.column(1), part.column(2)], names=["words", "times", "y", "u"])

    sample = stored(rows.select("text", "y", "u").mapInArrow(restore, "words array<string>, times array<long>, y boolean, u double"), "restored")
    # Two of three rows are counted, the third fits how much the counts mean.
    third = F.floor(F.col("u") * (1 << 20)) % 3
    counted, fitted = sample.where(third != 0), sample.where(third == 0)

    def listed(batches):
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                found.update(features(t))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["f", "n"])

    toxic = counted.where("y").select("words").mapInArrow(listed, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)
    seen = {r["f"]: r["n"] for r in toxic.collect()}  # words of the labelled sample's toxic texts and their starts
    names = list(seen)
    at = {f: i for i, f in enumerate(names)}

    def clean(batches):
        total, rows = np.zeros(len(names), np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rows += 1
                hit = [i for i in map(at.get, features(t)) if i is not None]
                total[hit] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there.tolist()], pa.int64()), pa.array([rows, *total[there].tolist()], pa.int64())], names=["i", "n"])

    n_toxic = counted.where("y").count()
    others = {r["i"]: r["n"] for r in counted.where(~F.col("y")).select("words").mapInArrow(clean, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n_clean = others.get(-1, 0)
    if not n_toxic or not n_clean:
        share = sample.agg(F.avg(F.col("y").cast("double"))).first()[0]
        return Model(channel, {}, np.zeros(0), 0.5 if share is None else float(share))
    weights = {}
    for f, k in seen.items():
        # Seen by chance a little less often in toxic texts, a little more often in clean ones.
        a, b = (k - 0.7 * math.sqrt(k)) / n_toxic, (others.get(at[f], 0) + 0.7 * math.sqrt(others.get(at[f], 0)) + 0.5) / n_clean
        if (w := math.log(a / b)) > EVIDENCE:  # weaker ones are never looked at
            weights[f] = w
    model = Model(channel, weights, np.zeros(0), n_toxic / (n_toxic + n_clean))

    def evidence(batches):
        for batch in batches:
            x = np.array([model.evidence(Counter(dict(zip(w, n)))) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), batch.column(2).cast(pa.float64())], names=["x", "y"])

    # A third of MOST_LABELS rows of eight numbers.
    got = fitted.select("words", "times", "y").mapInArrow(evidence, "x array<double>, y double").toPandas()
    if len(got):
        model.beta = logistic(np.array(got["x"].tolist()), got["y"].to_numpy())
    model.memo.clear()
    return model


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    beta, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of all rows, from one pass over the texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", whole().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classified(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null texts count as empty; an empty text has a score like any other; a very long one is scored whole, and so is a very long word, whose lattice grows with its length only. Repeated rows get repeated results; an empty table an empty result. Columns other than doc_id and text are not looked at."""
    modulus, left = held_out
    model = fit(docs, labels.where(remainder("doc_id", modulus) != left))
    out = scored(docs, model)
    return out.select("doc_id", (remainder("doc_id", modulus) == left).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
