"""Language-model scores: the marginal probability of a text over all its segmentations into the pieces of an existing subword vocabulary.

A text is words and then its end. A word is generated piece by piece until a stop: the first piece from those that begin a word, the others from those that go on, characters without a piece byte by byte. The log probability of a word is that of all its segmentations together, by a forward recursion in log space over the lattice of its pieces; words don't share pieces, so a text's is the sum of its words' and its end's. Many words go through the recursion at once, as arrays: substrings are looked up by hash, one place and one length at a time.

The local vocabulary is one of merges, whose scores are ranks and no probabilities. So each piece weighs how often the vocabulary's own segmentation uses it in the training words, counted as often as they occur, with a little weight by its rank added, and then by ROUNDS of expected counts over all segmentations.

Words are counted over the whole corpus, so their table is no bounded thing. The words that fit FREQUENT places, by count, are broadcast; all other words of a document are looked up by a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.bpe import slices
from knotwork.llm.common import dropped, remainder, stored, table, whole
from knotwork.llm.fingerprints import span_hashes, word_spans

#: Words that are broadcast, at most; one takes 24 bytes.
FREQUENT = 1 << 19
#: Words that a piece's rank counts for, all pieces together.
SMOOTH = 1.0
#: Rounds of expected counts after the first count.
ROUNDS = 2
#: A partition's counts are sent on when so many words have been gathered.
HELD_WORDS = 1 << 18
#: Words up to this length go through the recursion as arrays, so many at once.
LONGEST, TOGETHER = 32, 1 << 14
BAR = "▁"  # U+2581, at the start of a word's first piece
_BASE = 0x9E3779B97F4A7C15
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_SLOTS = 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def usable(path: str) -> tuple[list[str], np.ndarray]:
    """The vocabulary's pieces and their kinds: 0 unusable, 1 a word's first piece, 2 a later piece, 3 a byte. Texts are lower-cased in A-Z, so pieces with A-Z in them have no use."""
    sp = vocabulary(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    kinds = np.zeros(len(pieces), np.int8)
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            kinds[i] = 3
        elif not (sp.is_unknown(i) or sp.is_control(i) or not p or BAR in p[1:] or any("A" <= c <= "Z" for c in p)):
            kinds[i] = 1 if p[0] == BAR else 2
    return pieces, kinds


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.array([pow(_BASE, k, 1 << 64) for k in range(n)], np.uint64)
    down = np.array([pow(_BASE, -k, 1 << 64) for k in range(n)], np.uint64)
    return up, down


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Lattice:
    """Log probabilities of words. `counts` has how often each piece was used, `words` in how many words."""

    def __init__(self, pieces: list[str], kinds: np.ndarray, counts: np.ndarray, words: float):
        rank = 1.0 / (np.arange(len(pieces)) + 10.0)
        first, later = kinds == 1, kinds >= 2
        weight = counts + SMOOTH * (np.where(first, rank / rank[first].sum(), 0.0) + np.where(later, rank / rank[later].sum(), 0.0))
        stops = words + 1.0
        self.logs = np.full(len(pieces), -np.inf)
        self.logs[first] = np.log(weight[first] / weight[first].sum())
        total = weight[later].sum() + stops
        self.logs[later] = np.log(weight[later] / total)
        self.stop = math.log(stops / total)
        self.bytes = np.flatnonzero(kinds == 3)
        self.byte = self.logs[self.bytes].tolist()
        #: A piece's score; None for what is only the start of a piece.
        self.scores: dict[str, float | None] = {}
        listed = np.flatnonzero((kinds == 1) | (kinds == 2))
        for i in listed.tolist():
            for k in range(1, len(pieces[i])):
                self.scores.setdefault(pieces[i][:k], None)
            self.scores[pieces[i]] = float(self.logs[i])
        self.longest = max((len(pieces[i]) for i in listed.tolist()), default=1)
        self.number = {pieces[i]: i for i in listed.tolist()}
        self._places(pieces, listed)

    def _places(self, pieces: list[str], listed: np.ndarray) -> None:
        """Two tables from a hash's bits to a piece, the second for those whose place in the first is taken."""
        up, _ = _powers(self.longest)
        self.key = np.zeros(len(pieces) + 1, np.uint64)
        for i in listed.tolist():
            codes = np.fromiter(map(ord, pieces[i]), np.uint64, len(pieces[i]))
            self.key[i + 1] = (codes * up[: len(codes)]).sum(dtype=np.uint64)
        sizes = np.array([0, *map(len, pieces)], np.uint64)
        self.key = _spread(self.key + sizes * _LENGTH)
        self.one, self.two = np.zeros(1 << _SLOTS, np.int32), np.zeros(1 << _SLOTS, np.int32)
        at = (self.key >> np.uint64(64 - _SLOTS)).astype(np.int64)
        again = (self.key >> np.uint64(20) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)
        self.rest: list[int] = []
        for i in (listed + 1).tolist():
            if not self.one[at[i]]:
                self.one[at[i]] = i
            elif not self.two[again[i]]:
                self.two[again[i]] = i
            else:
                self.rest.append(i)

    def _found(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, one up, or 0."""
        got = self.one[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        miss = np.flatnonzero(self.key[got] != h)
        other = self.two[(h[miss] >> np.uint64(20) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)]
        got[miss] = np.where((self.key[other] == h[miss]) & (other > 0), other, 0)
        for i in self.rest:
            got[h == self.key[i]] = i
        return got

    def logp(self, word: str, used: dict[int, float] | None = None, times: float = 1.0) -> float:
        """Natural log of one word's probability. `used` gets how often each piece is used in a segmentation drawn by its probability, times `times`, by a recursion back; a byte counts by itself."""
        text = BAR + word.replace(BAR, "▂")
        n, scores = len(text), self.scores
        arrive: list[list[float]] = [[] for _ in range(n + 1)]
        arrive[0].append(0.0)
        arcs: list[tuple[int, int, float, float]] = []
        heres = [0.0] * (n + 1)
        for i in range(n + 1):
            if not (into := arrive[i]):
                continue
            top = max(into)
            here = heres[i] = top + math.log(sum(math.exp(x - top) for x in into))
            arrive[i] = []
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = scores.get(text[i:j], 0.0)
                if s == 0.0:
                    break
                if s is not None:
                    arrive[j].append(here + s)
                    single |= j == i + 1
                    arcs.append((i, j, here, s))
            if not single and 0 < i < n:
                s = sum(self.byte[b] for b in text[i].encode("utf-8", "replace"))
                arrive[i + 1].append(here + s)
                arcs.append((i, i + 1, here, s))
        if used is not None:
            # From the end: how likely a segmentation has a cut at each place, and of those that have it, which piece led there.
            cut = [0.0] * n + [times]
            for i, j, before, s in reversed(arcs):
                share = cut[j] * math.exp(before + s - heres[j])
                cut[i] += share
                if (k := self.number.get(text[i:j])) is not None:
                    used[k] = used.get(k, 0.0) + share
                else:
                    for b in text[i:j].encode("utf-8", "replace"):
                        used[int(self.bytes[b])] = used.get(int(self.bytes[b]), 0.0) + share
        return heres[n] + self.stop

    def logps(self, words: list[str], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """logp of all words, and with `times` how often each piece is used in so many times these words."""
        out, used = np.empty(len(words)), None if times is None else np.zeros(len(self.logs))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        more: dict[int, float] | None = None if times is None else {}
        for i in np.flatnonzero(sizes > LONGEST).tolist():
            out[i] = self.logp(words[i], more, 1.0 if times is None else float(times[i]))
        for i, x in (more or {}).items():
            used[i] += x
        short = np.flatnonzero(sizes <= LONGEST)
        for k in range(0, len(short), TOGETHER):
            at = short[k : k + TOGETHER]
            at = at[np.argsort(-sizes[at], kind="stable")]  # the longest first: those with so many characters are a head of the list
            out[at] = self._together([words[i] for i in at.tolist()], sizes[at], None if times is None else times[at], used)
        return out, used

    def _together(self, words: list[str], sizes: np.ndarray, times: np.ndarray | None, used: np.ndarray | None) -> np.ndarray:
        n, wide = len(words), int(sizes[0]) + 1
        codes = np.zeros((wide, n), np.uint64)
        codes[0] = ord(BAR)
        flat = np.frombuffer("".join(words).replace(BAR, "▂").encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(n), sizes)
        codes[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1, of] = flat
        up, down = _powers(wide)
        sums = np.zeros((wide + 1, n), np.uint64)
        np.cumsum(codes * up[:, None], axis=0, out=sums[1:])
        with_length = np.searchsorted(-sizes, -np.arange(wide + 1), side="right")  # words of at least so many characters
        ahead = np.full((wide + 1, n), -np.inf)
        ahead[0] = 0.0
        kept = []
        for i in range(wide):
            for j in range(i + 1, min(wide, i + self.longest) + 1):
                m = int(with_length[j - 1])
                if not m:
                    break
                got = self._found(_spread((sums[j, :m] - sums[i, :m]) * down[i] + np.array(j - i, np.uint64) * _LENGTH))
                hit = np.flatnonzero(got)
                if j == i + 1 and i and len(hit) < m:
                    none = np.flatnonzero(got == 0)
                    chars, back = np.unique(codes[i, none], return_inverse=True)
                    spelled = [chr(c).encode("utf-8", "replace") for c in chars.tolist()]
                    s = np.array([sum(self.byte[b] for b in x) for x in spelled])[back]
                    ahead[j, none] = np.logaddexp(ahead[j, none], ahead[i, none] + s)
                    if used is not None:
                        kept.append((i, j, none, s, (spelled, back)))
                if len(hit):
                    ids = got[hit] - 1
                    s = self.logs[ids]
                    ahead[j, hit] = np.logaddexp(ahead[j, hit], ahead[i, hit] + s)
                    if used is not None:
                        kept.append((i, j, hit, s, ids))
        ends = ahead[sizes + 1, np.arange(n)]
        if used is not None:
            cut = np.zeros((wide + 1, n))
            cut[sizes + 1, np.arange(n)] = times
            for i, j, at, s, ids in reversed(kept):
                with np.errstate(invalid="ignore"):
                    share = np.where(np.isfinite(ahead[i, at]), cut[j, at] * np.exp(ahead[i, at] + s - ahead[j, at]), 0.0)
                cut[i, at] += share
                if isinstance(ids, tuple):
                    for spelled, x in zip(ids[0], np.bincount(ids[1], share, len(ids[0])).tolist()):
                        for b in spelled:
                            used[self.bytes[b]] += x
                else:
                    used += np.bincount(ids, share, len(used))
        return ends + self.stop


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "replace").lower().split()


def together(batches):
    """Batches of TOGETHER rows at least, but the last; arrays of few words would cost more to start than to work through."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all words of docs (text, train): in how many places the training texts have it; words of other texts only count none."""

    def rows(found: Counter, others: set):
        listed = [*found, *others.difference(found)]
        return pa.RecordBatch.from_arrays([pa.array(listed, pa.binary()), pa.array([*found.values(), *[0] * (len(listed) - len(found))], pa.int64())], names=["word", "c"])

    def run(batches):
        found, others = Counter(), set()
        for batch in batches:
            for part in slices(batch, 0, 1 << 21):
                for text, train in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    (found if train else others).update(tokens(text))
                if len(found) + len(others) > HELD_WORDS:
                    yield rows(found, others)
                    found, others = Counter(), set()
        yield rows(found, others)

    return docs.select("text", "train").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> Lattice:
    """The weights of the vocabulary's pieces from training words (word, c): their use in the vocabulary's own segmentation, then rounds of expected counts. What the driver gets has a row for each piece of the vocabulary."""
    pieces, kinds = usable(path)
    words = words.where("c > 0").select("word", "c")

    def gathered(rows: DataFrame) -> np.ndarray:
        counts = np.zeros(len(pieces) + 1)
        for r in rows.groupBy("i").agg(F.sum("x").alias("x")).collect():
            counts[r["i"]] = r["x"]
        return counts

    def batch_of(found: np.ndarray):
        there = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(found[there], pa.float64())], names=["i", "x"])

    def own(batches):
        sp, found = vocabulary(path), np.zeros(len(pieces) + 1)
        for batch in batches:
            times = batch.column(1).to_numpy()
            found[-1] += times.sum()
            ids = sp.encode([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], out_type=int, num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            found += np.bincount(np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum())), np.repeat(times, sizes), len(found))
        yield batch_of(found)

    counts = gathered(words.mapInArrow(own, "i long, x double"))
    n = counts[-1]
    lattice = Lattice(pieces, kinds, np.where(kinds > 0, counts[:-1], 0.0), n)

    def expected(lattice: Lattice):
        def run(batches):
            found = np.zeros(len(pieces))
            for batch in together(batches):
                found += lattice.logps([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(float))[1]
            yield batch_of(found)

        return run

    for _ in range(rounds):
        lattice = Lattice(pieces, kinds, gathered(words.mapInArrow(expected(lattice), "i long, x double"))[:-1], n)
    return lattice


def scored(docs: DataFrame, held_out: tuple[int, int] = (7, 2), path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null texts are empty: one token, the end. Without training rows no word is known, the vocabulary's ranks alone weigh the pieces and a text ends with one half. Whole texts: words of up to LONGEST characters go through the lattice together, longer ones, of any length, one by one. Repeated rows are scored one by one; an empty table gives an empty one. Columns other than doc_id and text are not looked at."""
    path, (modulus, left) = path or default_vocabulary(), held_out
    held = remainder("doc_id", modulus) == left
    n_texts = docs.where(~held).count()
    words = stored(count_words(docs.select(whole().alias("text"), (~held).alias("train"))), "words")
    got = words.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = (got["c"] or 0) + n_texts, (got["v"] or 0) + (n_texts > 0)
    lattice = fit(words, path)
    end = n_texts / total if total else 0.5
    # A text of words only, or of ends only, keeps a little for the other.
    end = min(max(end, 1e-9), 1 - 1e-9)
    go_on, ends = math.log1p(-end), math.log(end)

    def with_lattice(batches):
        for batch in together(batches):
            listed = batch.column(0).to_pylist()
            raw, starts, ends_ = _joined(listed)
            hashes = span_hashes(raw, starts, ends_).view(np.int64)
            logs, _ = lattice.logps([w.decode("utf-8", "replace") for w in listed])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64()), pa.array(logs + go_on, pa.float64())], names=["word", "c", "hash", "sub"])

    known = stored(words.select("word", "c").mapInArrow(with_lattice, "word binary, c long, hash long, sub double"), "lattice")
    dropped(words)

    # The words that are broadcast: the highest classes of counts that fit, a class being an eighth of a doubling; so at most `frequent`.
    step = F.floor(F.log2(F.col("c") + 1.0) * 8).cast("int")
    classes = sorted(((r["s"], r["n"]) for r in known.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, least = frequent, (classes[0][0] + 1 if classes else 0)
    for s, n in classes:
        if n > room:
            break
        room, least = room - n, s
    top = known.where(step >= least).select("hash", "sub", "c").toArrow()
    hashes = top.column("hash").to_numpy()
    order = np.argsort(hashes)
    hashes = hashes[order]
    twice = np.unique(hashes[:-1][np.diff(hashes) == 0])  # words with one hash are looked up by the join
    shared = docs.sparkSession.sparkContext.broadcast((hashes, top.column("sub").to_numpy()[order], top.column("c").to_numpy()[order], twice))
    del top, order, hashes

    base_of = lambda c: np.log10((c + 1.0) / (total + 1.0 * (distinct + 1)))

    def score(batches):
        hashes, sub, times, twice = shared.value
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, 1, 1 << 21):
                texts = [t.encode("utf-8", "replace").lower() for t in piece.column(1).to_pylist()]
                raw, starts, ends_, counts = word_spans(texts)
                own = span_hashes(raw, starts, ends_).view(np.int64)
                of = np.repeat(np.arange(len(texts)), counts)
                place = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                there = hashes[place] == own if len(hashes) else np.zeros(len(own), bool)
                if len(twice):
                    there &= ~np.isin(own, twice)
                found = place[there]
                per_text = lambda v: np.bincount(of[there], v, len(texts)).astype(float)  # noqa: E731  whole numbers where nothing is there
                c = times[found]
                rest = [Counter() for _ in texts]
                for i in np.flatnonzero(~there).tolist():
                    rest[of[i]][raw[starts[i] : ends_[i]]] += 1
                ids = (part << 33) + at + np.arange(len(texts), dtype=np.int64)
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), piece.column(0), piece.column(2), pa.array(counts + 1), pa.array(per_text(c > 0).astype(np.int64)), pa.array(per_text(base_of(c))), pa.array(per_text(sub[found])), pa.array([list(r) for r in rest], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rest], pa.list_(pa.int64()))],
                    names=["row", "doc_id", "held_out", "n_tokens", "met", "base", "logp", "words", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", whole().alias("text"), held.alias("held_out"))
    seen = stored(source.mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, met long, base double, logp double, words array<binary>, times array<long>"), "scored")

    # The other words: joined by the word itself, summed by the row's number.
    rare = seen.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    others = known.where((step < least) | F.col("hash").isin(twice.tolist())) if len(twice) < 1000 else known
    looked = rare.join(others.select("word", "c", "sub"), "word")
    bases = F.log10((F.col("c") + 1.0) / (total + 1.0 * (distinct + 1)))
    added = looked.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("met2"), F.sum(F.col("times") * bases).alias("base2"), F.sum(F.col("times") * F.col("sub")).alias("logp2"))
    both = seen.drop("words", "times").join(added, "row", "left")
    end_base = float(base_of(float(n_texts)))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("met") + F.coalesce("met2", F.lit(0)) + (1 if n_texts else 0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base2", F.lit(0.0)) + end_base).alias("base_score"),
        ((F.col("logp") + F.coalesce("logp2", F.lit(0.0)) + ends) / math.log(10)).alias("score"),
    )


def _joined(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return b"".join(words), np.concatenate(([0], ends[:-1])) if len(words) else ends, ends


def op2_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
