"""N-gram Jaccard join with prefix filters under several token orders.

Two sets of shingles whose Jaccard similarity is at least t share a shingle among the first n - ceil(t * n) + 1 of each, in whatever order of all shingles these are the first; with k shingles more in both prefixes they share k + 1. A pair has to pass this under several orders, which are intersected before anything is compared:

0. an order by hash alone. The prefixes, with an eighth of the set more, are sent to buckets of the hash, packed, and each text learns how many of its prefix shingles any other text's prefix has. Texts with too few have no partner and are done: most texts of most corpora. This is a shuffle of some bytes for each prefix shingle and asks for nothing whose size is fixed.
1. and 2. two orders that rank shingles by how often the remaining texts have them, as two independent count sketches of fixed size tell it, then by a hash. Texts of equal shingle sets are one class. Classes that share a prefix shingle and agree in size are chained, and connected components of the chains are worked out, for each order by itself. A similar pair is in one component of the first order and in one of the second, so only the intersections of both partitions are looked at: what one sketch joins by accident the other takes apart.
3. inside such a cell: an exact order by the cell's own counts, then prefixes in two hash orders that a candidate must share as well, then the exact test. Pairs that links found so far connect already are not tested.

A shingle that very many classes share sends on one class of each size from each slice of texts; the others are chained to it on the spot. A cell of more than BLOCK classes (a long one counts several times) is dealt out in blocks in the order of size, numbered in two steps: first each block beside the cell's first block; then, with what these links connect, all classes outside the cell's largest component, in blocks, beside those blocks whose sizes can match. So every pair of a cell is tested or connected, no task holds more than two blocks, and nothing grows with the square of a group of near copies. No pair leaves a task but a link that connects two components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm.bpe import slices
from knotwork.llm.common import IdFilter, dropped, small_batches, stored, table, whole
from knotwork.llm.components import components
from knotwork.llm.fingerprints import mixed, shingle_hashes, word_hashes

#: Cells of each of the two sketches, and pieces in which they are summed.
CELLS, PIECES = 1 << 22, 128
#: Classes in a block; each UNIT shingles of a class, begun ones too, count for one.
BLOCK, UNIT = 256, 512
#: Prefix shingles that are sent in one packet, about, and bytes of text for each bucket that receives them.
SENT, BUCKET_BYTES = 1 << 19, 1 << 23
_SALT = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_MANY = 0xFFFF  # stands for "several classes of this packet"


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the text of each. A-Z count as a-z."""
    hashes, of = shingle_hashes(*word_hashes([t.encode("utf-8", "replace").lower() for t in texts]), words)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[first], of[first]


def keys_of(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of each text's set as two numbers, and the set's size."""
    sizes = np.bincount(of, minlength=n)
    ends = np.cumsum(sizes)

    def summed(salt: np.uint64) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes + salt), dtype=np.uint64)))
        return mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)

    return summed(_SALT[0]), summed(_SALT[1]), sizes


def cell(hashes: np.ndarray, order: int) -> np.ndarray:
    return (mixed(hashes ^ _SALT[order]) % np.uint64(CELLS)).astype(np.int64)


def prefix_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """n - ceil(percent * n / 100) + 1."""
    return n - (n * percent + 99) // 100 + 1


def spare(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles by which the prefix of order 0 is longer."""
    return n // 8


_PACKET = "bucket int, packet long, tokens binary, whose binary, ids array<long>, of binary, keys binary, more binary, sizes binary, known binary"
_PACKET_SCHEMA = pa.schema([("bucket", pa.int32()), ("packet", pa.int64()), ("tokens", pa.binary()), ("whose", pa.binary()), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("of", "keys", "more", "sizes", "known"))])


def packets(docs: DataFrame, buckets: int, words: int, percent: int) -> DataFrame:
    """Prefix shingles of order 0 in packets. A packet has a row for each bucket (the least 40 bits of each shingle, and the class of the packet that has it) and a row about itself (its ids, the class of each, the classes' keys and sizes, and how many of their shingles another class of the packet has).

    A shingle that several classes of a packet have is settled there and sent once, as _MANY, so no shingle of the corpus has more than one entry from each packet."""

    def pack(packet: int, held: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        keys, more, sizes = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        # One class of the packet for all rows with the same set.
        both = np.empty(len(keys), [("a", np.int64), ("b", np.int64)])
        both["a"], both["b"] = keys, more
        _, first, of = np.unique(both, return_index=True, return_inverse=True)
        row_of = np.repeat(np.arange(len(keys)), np.concatenate([h[5] for h in held]))
        mine = first[of[row_of]] == row_of  # the class's first row speaks for it
        tokens, whose = mixed(np.concatenate([h[4] for h in held])[mine] + _SALT[1]), of[row_of[mine]]
        order = np.argsort(tokens, kind="stable")
        tokens, whose = tokens[order], whose[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1) > 1
        known = np.bincount(whose[several[group]], minlength=len(first)) if len(tokens) else np.zeros(len(first), np.int64)
        tokens, whose = tokens[new], np.where(several[group[new]], _MANY, whose[new]) if len(tokens) else whose
        at = ((tokens >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)  # in order, as the tokens are
        cuts = np.flatnonzero(np.diff(at)) + 1
        low = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :5]
        rows = [{"bucket": int(at[a]), "packet": packet, "tokens": low[a:b].tobytes(), "whose": whose[a:b].astype(np.uint16).tobytes()} for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]) if b > a]
        about = {"bucket": packet % buckets, "packet": packet, "ids": ids.to_pylist(), "of": of.astype(np.uint16).tobytes(), "keys": keys[first].tobytes(), "more": more[first].tobytes(), "sizes": sizes[first].astype(np.int64).tobytes(), "known": known.astype(np.int64).tobytes()}
        return pa.RecordBatch.from_pylist([*rows, about], schema=_PACKET_SCHEMA)

    def run(batches):
        packet, held, rows, sent = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                for k in range(0, part.num_rows, 20_000):
                    piece = part.slice(k, 20_000)
                    hashes, of = shingle_sets(piece.column(1).to_pylist(), words)
                    keys, more, sizes = keys_of(hashes, of, piece.num_rows)
                    # The sets are in the order of their hashes, which is order 0.
                    most = np.minimum(sizes, prefix_size(sizes, percent) + spare(sizes)) * (sizes > 0)
                    taken = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[of] < most[of]
                    if held and (rows + piece.num_rows >= _MANY or sent + int(most.sum()) > SENT):
                        yield pack(packet, held)
                        packet, held, rows, sent = packet + 1, [], 0, 0
                    held.append((piece.column(0), keys, more, sizes, hashes[taken], most))
                    rows, sent = rows + piece.num_rows, sent + int(most.sum())
        if held:
            yield pack(packet, held)

    return docs.mapInArrow(run, _PACKET)


def sifted(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, key, more, n, likely) of every row: the class of its set, and whether it has enough prefix shingles of order 0 in common with any others.

    docs must be read from a table, so that a task that is run again sees the same rows in the same order."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = max(8, size // BUCKET_BYTES)

    def count(t: pa.Table) -> pa.Table:
        """For each packet the classes that an answer is about, one time for each shingle that others have too."""
        about = t.filter(pa.compute.is_valid(t.column("keys")))
        sent = t.filter(pa.compute.is_null(t.column("keys")))
        raw, lists = sent.column("tokens").to_pylist(), [np.frombuffer(x, np.uint16) for x in sent.column("whose").to_pylist()]
        rows = []
        if raw:
            tokens = np.zeros((sum(map(len, lists)), 8), np.uint8)
            tokens[:, :5] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 5)
            tokens, whose = tokens.view(np.uint64).ravel(), np.concatenate(lists)
            _, back, times = np.unique(tokens, return_inverse=True, return_counts=True)
            here = np.zeros(len(times), bool)
            here[back[whose == _MANY]] = True
            there = ((times > 1) | here)[back] & (whose != _MANY)
            at = np.cumsum([0, *map(len, lists)])
            for k, packet in enumerate(sent.column("packet").to_pylist()):
                if (found := whose[at[k] : at[k + 1]][there[at[k] : at[k + 1]]]).size:
                    rows.append({"packet": packet, "whose": found.tobytes()})
        return pa.concat_tables([about.select(_PACKET_SCHEMA.names), pa.Table.from_pylist(rows, schema=_PACKET_SCHEMA)])

    def answer(t: pa.Table) -> pa.Table:
        about = t.filter(pa.compute.is_valid(t.column("keys"))).to_pylist()[0]
        keys, more, sizes, known = (np.frombuffer(about[x], np.int64) for x in ("keys", "more", "sizes", "known"))
        found = b"".join(x for x in t.column("whose").to_pylist() if x)
        likely = (known + np.bincount(np.frombuffer(found, np.uint16), minlength=len(keys)) >= 1 + spare((sizes * percent + 99) // 100)) & (sizes > 0)
        of = np.frombuffer(about["of"], np.uint16)
        return pa.table({"doc_id": pa.array(about["ids"], pa.int64()), "key": keys[of], "more": more[of], "n": sizes[of], "likely": likely[of]})

    counted = packets(docs, buckets, words, percent).groupBy("bucket").applyInArrow(count, _PACKET)
    return counted.groupBy("packet").applyInArrow(answer, "doc_id long, key long, more long, n long, likely boolean")


def members(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, text) of the classes in wanted (doc_id, key, n), each once.

    The texts are filtered before they are shuffled (IdFilter); the join decides. The key is worked out again beside the text, so rows with one id and different texts are told apart."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                keys, _, _ = keys_of(*shingle_sets(part.column(1).to_pylist(), words), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), part.column(1)], names=["doc_id", "key", "text"])

    likely = IdFilter(wanted).maybe(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, key long, text string")
    return likely.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])


def sketches(docs: DataFrame, words: int) -> np.ndarray:
    """For both orders, the class of each cell: twice the logarithm of how many shingles of all texts fall in it."""
    size = CELLS // PIECES

    def partial(batches):
        total = np.zeros((2, CELLS), np.uint32)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                hashes, _ = shingle_sets(part.column(1).to_pylist(), words)
                for o in (0, 1):
                    at, n = np.unique(cell(hashes, o), return_counts=True)
                    total[o, at] += n.astype(np.uint32)
        # A row for each piece: its counts in the least width that holds them.
        pieces = [p if (most := p.max()) > 65535 else p.astype(np.uint16 if most > 255 else np.uint8) for p in total.reshape(2 * PIECES, size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * PIECES), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "counts"])

    def whole_(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // size])
                if piece in sums:
                    sums[piece] += counts
                else:
                    sums[piece] = counts.astype(np.int64)
        if sums:
            ranks = [np.floor(2 * np.log2(np.maximum(s, 1))).astype(np.uint8).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["piece", "ranks"])

    out = np.zeros((2 * PIECES, size), np.uint8)
    summed = docs.mapInArrow(partial, "piece int, counts binary").repartition(2 * PIECES // 16, "piece").mapInArrow(whole_, "piece int, ranks binary")
    for r in summed.toLocalIterator():  # CELLS bytes for each order, whatever the corpus
        out[r["piece"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.reshape(2, CELLS)


def postings(docs: DataFrame, ranks, words: int, percent: int) -> DataFrame:
    """(token, key, n, head) of the prefix shingles of docs (key, text) under both orders; the order is the token's least bit.

    Shingles that a sketch counts once are left out: no other class has them. Of a slice's classes with one token and size, the others name the first as their head."""

    def run(batches):
        table_ = ranks.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                hashes, of = shingle_sets(part.column(1).to_pylist(), words)
                sizes, keys = np.bincount(of, minlength=part.num_rows), part.column(0).to_numpy()
                starts, most = np.cumsum(sizes) - sizes, prefix_size(sizes, percent)
                by = [table_[o][cell(hashes, o)] for o in (0, 1)]
                alone = (by[0] == 0) | (by[1] == 0)
                for o in (0, 1):
                    tie = mixed(hashes + _SALT[o])
                    # Ranks are below 128: rank and tie make one number.
                    order = np.lexsort((by[o].astype(np.uint64) << np.uint64(57) | tie >> np.uint64(7), of))
                    taken = order[(np.arange(len(order)) - starts[of]) < most[of]]
                    taken = taken[~alone[taken]]
                    token, key, n = (tie[taken] & ~np.uint64(1)) | np.uint64(o), keys[of[taken]], sizes[of[taken]]
                    order = np.lexsort((key, n, token))
                    token, key, n = token[order], key[order], n[order]
                    new = np.ones(len(token), bool)
                    new[1:] = (token[1:] != token[:-1]) | (n[1:] != n[:-1])
                    head = key[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(key), pa.array(n), pa.array(head, mask=new)], names=["token", "key", "n", "head"])

    return docs.select("key", "text").mapInArrow(run, "token long, key long, n long, head long")


def cells(found: DataFrame, percent: int) -> DataFrame:
    """(key, cell) of the classes that share a cell with another one."""
    by_size = W.partitionBy("token").orderBy("n", "key")
    gap = F.coalesce(F.lag("n").over(by_size) * 100 < F.col("n") * percent, F.lit(True))
    runs = found.where("head is null").select("token", "key", "n", gap.cast("int").alias("gap")).withColumn("run", F.sum("gap").over(by_size))
    head = F.first("key").over(W.partitionBy("token", "run").orderBy("n", "key"))
    # A node is a class in one order: the least bit of its number tells the order.
    node = lambda c: F.col(c).bitwiseAND(F.lit(~1)).bitwiseOR(F.col("token").bitwiseAND(F.lit(1)))
    chained = runs.withColumn("head", head).select("key", "head", "token").unionByName(found.where("head is not null").select("key", "head", "token")).where("key <> head")
    chained = stored(chained.select(node("key").alias("u"), node("head").alias("v"), "key", "head", F.col("token").bitwiseAND(F.lit(1)).alias("order")).distinct(), "chains")
    labels = components(chained.select("u", "v"))
    keys = chained.select("key", "u", "order").unionByName(chained.select(F.col("head").alias("key"), F.col("v").alias("u"), "order")).distinct()
    both = keys.join(labels, F.col("u") == F.col("node")).groupBy("key").agg(F.max(F.when(F.col("order") == 0, F.col("label"))).alias("a"), F.max(F.when(F.col("order") == 1, F.col("label"))).alias("b"))
    both = stored(both.where("a is not null and b is not null").select("key", F.xxhash64("a", "b").alias("cell")), "cells")
    dropped(chained)
    shared = both.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").select("cell")
    return both.join(shared, "cell")


def linked(ids: list[int], sets: list[np.ndarray], ask: np.ndarray, comps: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect components, among pairs of which one is in `ask`. comps: what is connected already."""
    n = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    _, token, times = np.unique(every, return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    rare = [token[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
    whole_sets = [frozenset(t.tolist()) for t in rare]
    prefix = prefix_size(n, percent)
    tie = mixed(np.arange(len(times), dtype=np.uint64) + _SALT[0]) >> np.uint64(1)
    other = mixed(np.arange(len(times), dtype=np.uint64) + _SALT[1])
    first = lambda t, k, by: t[np.argsort(by[t], kind="stable")[:k]]
    counted = np.lexsort((tie, times))
    place = np.empty(len(times), np.int64)
    place[counted] = np.arange(len(times))
    one = [first(t, k, place) for t, k in zip(rare, prefix.tolist())]
    two = [frozenset(first(t, k, tie).tolist()) for t, k in zip(rare, prefix.tolist())]
    three = [frozenset(first(t, k, other).tolist()) for t, k in zip(rare, prefix.tolist())]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out, index = [], {}
    for i in np.argsort(n, kind="stable").tolist():
        near: set[int] = set()
        for t in one[i].tolist():
            near.update(index.get(t, ()))
            index.setdefault(t, []).append(i)
        least, mine = n[i] * percent, find(comps[i])
        for j in sorted(near):
            if n[j] * 100 < least or not (ask[i] or ask[j]) or find(comps[j]) == mine or two[i].isdisjoint(two[j]) or three[i].isdisjoint(three[j]):
                continue
            both = len(whole_sets[i] & whole_sets[j])
            if 100 * both >= percent * (n[i] + n[j] - both):
                out.append((ids[i], ids[j]))
                parent[find(comps[j])] = mine = find(comps[i])
    return out


def _link_groups(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """rows (group, side, key, comp, text): links in each group between classes of side 1 and any other."""

    def run(key, t):
        ids = t.column("key").to_pylist()
        hashes, of = shingle_sets(t.column("text").to_pylist(), words)
        sets = np.split(hashes, np.cumsum(np.bincount(of, minlength=len(ids)))[:-1])
        out = linked(ids, sets, t.column("side").to_numpy() == 1, t.column("comp").to_pylist(), percent) if len(ids) > 1 else []
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("group").applyInArrow(run, "u long, v long")


def in_blocks(rows: DataFrame, to: str) -> DataFrame:
    """rows (cell, place, weight, doc_id, ...) with `to`, a block by running weight in the order of place inside a cell. In two steps: weights of strata (cell, place, bucket of the id), some hundred rows each, and then the place inside a stratum; so no task sees a whole cell."""
    strata = rows.groupBy("cell", "place").agg(F.count("*").alias("k"))
    dealt = rows.join(strata, ["cell", "place"]).withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.ceil(F.col("k") / 256))).drop("k")
    sums = dealt.groupBy("cell", "place", "h").agg(F.sum("weight").alias("w"))
    sums = sums.select("cell", "place", "h", F.coalesce(F.sum("w").over(W.partitionBy("cell").orderBy("place", "h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("weight").over(W.partitionBy("cell", "place", "h").orderBy("doc_id", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("inside", inside).join(sums, ["cell", "place", "h"]).withColumn(to, F.floor((F.col("before") + F.col("inside")) / BLOCK).cast("long")).drop("h", "inside", "before")


def links(texts: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) that connect what is similar, by the key's number. texts: (key, doc_id, n, text); placed: (key, doc_id, n, cell)."""
    weighed = placed.withColumn("weight", F.ceil(F.greatest("n", F.lit(1)) / UNIT).cast("long")).withColumn("place", F.col("n"))
    totals = weighed.groupBy("cell").agg(F.sum("weight").alias("total"))
    weighed = stored(weighed.join(totals, "cell"), "weighed")
    columns = ["key", "cell", "total", "block"]
    numbered = weighed.where(F.col("total") <= BLOCK).withColumn("block", F.lit(0).cast("long")).select(columns).unionByName(in_blocks(weighed.where(F.col("total") > BLOCK), "block").select(columns))
    texts = stored(texts.select("key", "n", "text").join(numbered, "key"), "placed-texts")
    dropped(weighed)
    group = lambda *c: F.xxhash64(*c).alias("group")

    # Each block beside the first one of its cell; in a cell of one block that is all.
    own = texts.select(group(F.lit(1), "cell", "block"), F.lit(1).alias("side"), "key", F.col("key").alias("comp"), "text")
    large = texts.where(F.col("total") > BLOCK)
    others = large.where("block > 0").select("cell", F.col("block").alias("to")).distinct()
    hub = large.where("block = 0").join(others, "cell").select(group(F.lit(1), "cell", F.col("to").alias("block")), F.lit(0).alias("side"), "key", F.col("key").alias("comp"), "text")
    first = stored(_link_groups(own.unionByName(hub), words, percent), "links")
    if large.isEmpty():
        dropped(texts)
        return first

    comps = components(first)
    small = large.select("key", "n", "cell", "block").join(comps, F.col("key") == F.col("node"), "left").select("key", "n", "cell", "block", F.coalesce("label", "key").alias("comp"))
    small = stored(small, "comps")
    counts = small.groupBy("cell", "comp").agg(F.count("*").alias("k"))
    main = counts.groupBy("cell").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    # Outside the largest component: numbered anew, in blocks that meet the blocks whose sizes can match.
    out = small.join(main, "cell").where("comp <> main").select("key", "n", "cell", F.col("block").alias("place"), F.lit(1).cast("long").alias("weight"), F.col("key").alias("doc_id"))
    out = stored(in_blocks(out, "asks").select("key", "n", "cell", "asks"), "asks")
    span = [F.min("n").alias("lo"), F.max("n").alias("hi")]
    asking = out.groupBy("cell", "asks").agg(*span).select("cell", "asks", F.col("lo").alias("a"), F.col("hi").alias("b"))
    meets = asking.join(small.groupBy("cell", "block").agg(*span), "cell").where((F.col("a") * percent <= F.col("hi") * 100) & (F.col("lo") * percent <= F.col("b") * 100)).select("cell", "asks", "block")
    meets = stored(meets, "meets")
    second = stored(large.select("key", "text").join(small.select("key", "cell", "block", "comp"), "key").join(out.select("key", "asks"), "key", "left"), "second")
    ask = second.where("asks is not null").select("key", "text", "cell", "comp", "asks").join(meets, ["cell", "asks"])
    ask = ask.select(group(F.lit(2), "cell", "asks", "block"), F.lit(1).alias("side"), "key", "comp", "text")
    # A text that asks in this group is there already.
    told = second.withColumnRenamed("asks", "mine").join(meets, ["cell", "block"]).where("mine is null or mine <> asks")
    told = told.select(group(F.lit(2), "cell", "asks", "block"), F.lit(0).alias("side"), "key", "comp", "text")
    more = stored(_link_groups(ask.unionByName(told), words, percent), "links")
    dropped(texts, small, out, meets, second)
    return first.unionByName(more)


def joined(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_copies (rows with the same shingle set) of every row.

    Rows with equal sets are linked. A null, empty or blank text has no shingles and is linked with nothing: its component is its own id. Null ids take part through their set, but name no component. Repeated rows get repeated results, rows of one id with different texts are told apart; an empty table gives an empty one. Ids must be whole numbers or null. Whole texts of any length are read, a very long one counts as several in a block. Other columns are not looked at."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    ids = stored(sifted(rows, words, percent), "sets")
    classes = stored(ids.where("n > 0").groupBy("key", "more", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.bool_or("likely").alias("likely")), "classes")
    wanted = classes.where("likely and rep is not null").select(F.col("rep").alias("doc_id"), "key", "n")
    texts = stored(members(rows.where("doc_id is not null"), wanted, words), "members")
    shared = docs.sparkSession.sparkContext.broadcast(sketches(texts.select("key", "text"), words))
    placed = stored(cells(postings(texts, shared, words, percent), percent).join(texts.select("key", "doc_id", "n"), "key"), "placed")
    found = links(texts, placed, words, percent)
    dropped(texts, placed)
    # The links name sets; a component is named by its least id.
    comps = stored(components(found), "components")
    reps = comps.join(classes.select("key", "rep").where("rep is not null"), F.col("node") == F.col("key")).groupBy("label").agg(F.min("rep").alias("component"))
    named = comps.join(reps, "label").select(F.col("node").alias("key"), "component")
    named = classes.join(named, "key", "left").select("key", "more", "n", "n_copies", F.coalesce("component", "rep").alias("component"))
    out = ids.join(named, ["key", "more", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), words=4, percent=85)
