"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, other columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import bpe, common, components, fingerprints, lattice_lm, mixing, neighbours, ngram_join, page_diff, pii, progressive_jpeg, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token long, n long, key string, u double"
LONG = " ".join(f"word{i % 700}x{i % 13}" for i in range(20000))


def table(spark, rows):
    """(doc_id, text, lang, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "k", 0.5) for r in rows], SCHEMA)


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "One word's é日 ", "en", "b"), (5, LONG, "en", "b"), (5, LONG, "en", "b"), (6, "the cat sat on the mat and ran away again", None, "a"), (7, "the cat sat on the mat and ran away again", "fr", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


# ---- n-gram join ------------------------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = {i: frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if (w := words(t)) else frozenset() for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in index[x]).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            index[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [512, 8])
def test_join_against_brute_force(spark, block, monkeypatch):
    """Copies, a chain of near copies that only neighbours link, texts around the limit, and a passage that all share."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    passage = [f"p{i}" for i in range(40)]
    rows, now = [], list(base)
    for i in range(60):
        now = list(now)
        now[(i * 7) % 80] = f"x{i}"
        rows.append((i, " ".join(now)))
    for i in range(60, 90):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(80)] = f"y{rng.random()}"
        rows.append((i, " ".join(near)))
    rows += [(i, " ".join(passage + [f"z{i}_{k}" for k in range(30)])) for i in range(90, 120)]
    rows += [(i, " ".join(base)) for i in range(120, 130)] + [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(table(spark, [(i, t, "en", "s") for i, t in rows]), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_join_of_odd_rows(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_copies) for r in ngram_join.joined(odd).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 5, 6, 7]
    assert [g[2] for g in got] == [1, 2, 3, 4, 5, 5, 6, 6] and got[0][1] == 0 and got[4][3] == 2
    assert ngram_join.joined(odd.limit(0)).count() == 0


def test_join_of_many_unlike_texts_in_one_cell(spark):
    """Each text shares half of its words with the next one: one chain of candidates, no link but between the planted near copies."""
    n = 3000
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(30)] + [f"a{i + 1}x{k}" for k in range(30)])) for i in range(n)]
    rows += [(n + i, rows[i * 500][1] + f" more{i}") for i in range(6)]
    got = {r.doc_id: r.component_id for r in ngram_join.joined(table(spark, [(i, t, "en", "s") for i, t in rows]), 4, 85).collect()}
    assert {i: c for i, c in got.items() if i != c} == {n + i: i * 500 for i in range(6)}


def test_rows_of_one_id_keep_their_links(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.random()}" for _ in range(40)) for _ in range(2)]
    rows = [(5, texts[0]), (5, texts[1]), (7, texts[0] + " x"), (9, texts[1] + " y"), (5, texts[0])]
    got = Counter((r.doc_id, r.component_id, r.n_shingles, r.n_copies) for r in ngram_join.joined(table(spark, [(i, t, "en", "s") for i, t in rows]), 4, 85).collect())
    assert got == Counter({(5, 5, 37, 2): 2, (5, 5, 37, 1): 1, (7, 5, 38, 1): 1, (9, 5, 38, 1): 1})


@pytest.mark.parametrize("name", ["op1_ngram_join", "op3_source_mix"])
def test_same_rows_as_sql(spark, sf_dir, name):
    import duckdb

    from knotwork.llm import registry

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(c.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 103)}}


# ---- lattice scores ---------------------------------------------------------------------------------------------------


def all_segmentations(lattice, pieces, kinds, word):
    """The probability of a word as the plain sum over its segmentations."""
    first = {p: lattice.scores[p] for p, k in zip(pieces, kinds) if k == 1}
    later = {p: lattice.scores[p] for p, k in zip(pieces, kinds) if k == 2}

    def total(s, table_):
        if not s:
            return math.exp(lattice.stop)
        out = sum(math.exp(table_[s[:j]]) * total(s[j:], later) for j in range(1, len(s) + 1) if s[:j] in table_)
        if table_ is later and s[0] not in later:
            out += math.exp(sum(lattice.byte[b] for b in s[0].encode())) * total(s[1:], later)
        return out

    return total("▁" + word.replace("▁", "▂"), first)


def test_lattice_sums_all_segmentations():
    pieces, kinds = lattice_lm.usable(lattice_lm.default_vocabulary())
    rng = np.random.default_rng(4)
    lattice = lattice_lm.Lattice(pieces, kinds, np.where(kinds > 0, rng.random(len(kinds)) * 50, 0.0), 1000)
    listed = ["the", "hereing", "zqx", "日a", "▁", "", "é", "\U0001f600b", "x" * 9]
    want = [math.log(all_segmentations(lattice, pieces, kinds, w)) for w in listed]
    assert [lattice.logp(w) for w in listed] == pytest.approx(want)
    long = "ab日" * 30  # one by one; the others as arrays
    got, used = lattice.logps([*listed, long], np.arange(1.0, len(listed) + 2))
    assert got.tolist() == pytest.approx([*want, lattice.logp(long)])
    one = {}
    for w, n in zip([*listed, long], range(1, 99)):
        lattice.logp(w, one, float(n))
    assert used == pytest.approx(np.array([one.get(i, 0.0) for i in range(len(used))]))
    # Each word has one first piece.
    assert used[kinds == 1].sum() == pytest.approx(sum(range(1, len(listed) + 2)))


@pytest.mark.parametrize("frequent", [0, 1 << 19])
def test_scores_sum_all_segmentations(spark, frequent):
    rows = [(i, t, "en", "s") for i, t in enumerate(["the cat sat", "A cat  ran", "zq the日", None, "", "the the the", "sat ran", "unseen cat"])]
    got = {r.doc_id: r.score for r in lattice_lm.scored(table(spark, rows), frequent=frequent).collect()}
    train = [w.decode() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t)]
    n_texts = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in rows)
    pieces, kinds = lattice_lm.usable(lattice_lm.default_vocabulary())
    own = Counter(i for w in train for i in lattice_lm.vocabulary(lattice_lm.default_vocabulary()).encode(w))
    lattice = lattice_lm.Lattice(pieces, kinds, np.array([own[i] if k else 0.0 for i, k in enumerate(kinds)]), len(train))
    for _ in range(lattice_lm.ROUNDS):
        used = {}
        for w in train:
            lattice.logp(w, used)
        lattice = lattice_lm.Lattice(pieces, kinds, np.array([used.get(i, 0.0) for i in range(len(kinds))]), len(train))
    end = n_texts / (len(train) + n_texts)
    for i, t, *_ in rows:
        want = math.log10(end) + sum(math.log10(1 - end) + math.log10(all_segmentations(lattice, pieces, kinds, w.decode())) for w in words(t))
        assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("frequent", [0, 1 << 19])
def test_long_words_have_their_whole_log_probability(spark, frequent):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:30]
    texts = {held[0]: "\u65e5x" * 2500, held[1]: "\u65e5x" * 5000, held[2]: "\u65e5x" * 10000}
    rows = [(i, "the cat sat on the mat", "en", "s") for i in train] + [(i, t, "en", "s") for i, t in texts.items()]
    got = {r.doc_id: r.score for r in lattice_lm.scored(table(spark, rows), frequent=frequent).collect()}
    a, b, c = (got[i] for i in held)
    assert c - b == pytest.approx(2 * (b - a), rel=1e-6) and b - a < -1000


@pytest.mark.parametrize("frequent", [1 << 19, 50])
def test_base_scores(spark, docs, odd, frequent):
    rows = docs.select("doc_id", "text", "lang").unionByName(odd.select(F.col("doc_id") + 10**6, "text", "lang").toDF("doc_id", "text", "lang"))
    got = lattice_lm.scored(rows, frequent=frequent).collect()
    pairs = [(r.doc_id, words(r.text)) for r in rows.collect()]
    train = [w for i, w in pairs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for d in train for w in d)
    n, v = sum(c.values()) + len(train), len(c) + 1
    base = lambda k: math.log10((k + 1) / (n + 1 * (v + 1)))
    want = {i: (len(w) + 1, sum(x in c for x in w) + 1, sum(base(c[x]) for x in w) + base(len(train)), zlib.crc32(str(i).encode()) % 7 == 2) for i, w in pairs}
    assert len(got) == len(pairs)
    for r in got:
        assert (r.n_tokens, r.n_known, r.held_out, r.train_tokens) == (want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][3], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2]) and r.score < 0 and math.isfinite(r.score)
    assert lattice_lm.scored(rows.limit(0)).count() == 0


# ---- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= epochs * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_against_repeated_clamping(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["a", "b", "b", "b", "b", "c", "ç", None])) for i in range(900)]
    frame = table(spark, rows).repartition(5)
    got = mixing.mixed(frame).collect()
    sizes, taken = Counter(), Counter()
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    target = brute_targets(sizes)
    source = {i: s for i, _, _, s in rows}
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(frame.repartition(2)).collect()))


def test_mix_of_odd_rows(odd):
    got = mixing.mixed(odd).collect()
    assert len(got) == len(ODD) and mixing.mixed(odd.limit(0)).count() == 0


# ---- progressive JPEG -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 1152, 20000, 1_700_000])
def test_payload_round_trip(n):
    payload = progressive_jpeg.padded(np.random.default_rng(n).bytes(n))
    image = progressive_jpeg.decode(progressive_jpeg.encode(payload))
    assert progressive_jpeg.payload_of(image) == payload and len(payload) % 576 == 0


def reference_scans(coefficients):
    """A grey progressive JPEG written code by code: DC in two steps, AC in two bands and two steps, with runs of finished blocks."""
    J, bits, out = progressive_jpeg, [], [b"\xff\xd8"]
    n = len(coefficients)
    symbols = bytes(sorted({*range(12), *((r << 4) | s for r in range(16) for s in range(11))}))
    lengths = bytes([0] * 7 + [len(symbols)] + [0] * 8)
    codes = {s: i for i, s in enumerate(symbols)}
    out.append(J._segment(0xDB, bytes([0]) + bytes([1] * 64)))
    out.append(J._segment(0xC2, bytes([8, 0, 8, 0, 8 * n, 1, 1, 0x11, 0])))
    out.append(J._segment(0xC4, b"".join(bytes([c]) + lengths + symbols for c in (0x00, 0x10))))

    def put(v, k):
        bits.extend((v >> (k - 1 - i)) & 1 for i in range(k))

    def number(v):
        put(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, abs(v).bit_length())

    def close(start, end, high, low):
        out.append(J._sos([(1, 0)], start, end, high, low))
        bits.extend([1] * (-len(bits) % 8))
        out.append(J._stuffed(np.packbits(np.array(bits, np.uint8)).tobytes()))
        bits.clear()

    last = 0
    for b in coefficients:
        d = (int(b[0]) >> 1) - last
        last += d
        put(codes[abs(d).bit_length()], 8)
        number(d)
    close(0, 0, 0, 1)
    for start, end in ((1, 5), (6, 63)):
        for b in coefficients:
            run = 0
            for k in range(start, end + 1):
                v = int(np.sign(b[k])) * (abs(int(b[k])) >> 1)
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(codes[0xF0], 8)
                    run -= 16
                put(codes[run << 4 | abs(v).bit_length()], 8)
                number(v)
                run = 0
            if run:
                put(codes[0], 8)
        close(start, end, 0, 1)
    bits.extend(int(b[0]) & 1 for b in coefficients)
    close(0, 0, 1, 0)
    for b in coefficients:
        old = [abs(int(v)) > 1 for v in b]
        new = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        k = 1
        for at in new:
            run, waiting = 0, []
            for j in range(k, at):
                if old[j]:
                    waiting.append(abs(int(b[j])) & 1)
                else:
                    run += 1
                    if run == 16:
                        put(codes[0xF0], 8)
                        bits.extend(waiting)
                        run, waiting = 0, []
            put(codes[run << 4 | 1], 8)
            bits.append(int(b[at] > 0))
            bits.extend(waiting)
            k = at + 1
        if k < 64:
            put(codes[0], 8)
            bits.extend(abs(int(b[j])) & 1 for j in range(k, 64) if old[j])
    close(1, 63, 1, 0)
    return b"".join([*out, b"\xff\xd9"])


def test_code_by_code_scans():
    rng = np.random.default_rng(4)
    blocks = np.where(rng.random((5, 64)) < 0.3, rng.integers(-9, 10, (5, 64)), 0)
    blocks[:, 0] = rng.integers(-200, 200, 5)
    blocks[2, 1:] = 0
    image = progressive_jpeg.decode(reference_scans(blocks))
    assert (image.components[0].blocks.reshape(-1, 64) == blocks).all()
    x, y = np.meshgrid(range(8), range(8))
    want = sum(blocks[0][k] * (0.125**0.5 if z // 8 == 0 else 0.5) * (0.125**0.5 if z % 8 == 0 else 0.5) * np.cos((2 * y + 1) * (z // 8) * np.pi / 16) * np.cos((2 * x + 1) * (z % 8) * np.pi / 16) for k, z in enumerate(progressive_jpeg.ZIGZAG))
    assert (abs(image.rgb()[:, :8, 0] - np.clip(np.rint(want + 128), 0, 255)) <= 1).all()


def test_media_columns(spark, odd):
    got = {(r.doc_id, r.payload_bytes): r for r in progressive_jpeg.digests(odd).collect()}
    for i, t, *_ in ODD:
        p = progressive_jpeg.padded((t or "").encode())
        r = got[(i, len(p))]
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    media = progressive_jpeg.with_tensor(progressive_jpeg.with_media(odd.select("doc_id", F.col("text").cast("binary").alias("p")), "p"))
    rows = media.select("rgb.*").where("data is not null").collect()
    assert len(rows) == 7 and all(len(r.data) == r.height * r.width * 3 for r in rows)


# ---- fingerprints -----------------------------------------------------------------------------------------------------


def test_likeness_is_near_the_true_similarity(docs):
    texts = [r.text for r in docs.select("text").limit(150).collect()]
    sets = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set()
    errors = []
    for a, b in zip(texts, texts[1:]):
        e = fingerprints.edited(a, b)
        x, y = sets(a), sets(e)
        p, q = fingerprints.fingerprint_rows([a.encode().lower(), e.encode().lower()])
        errors.append(fingerprints.likeness([p], [q])[0] - len(x & y) / max(1, len(x | y)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_ring_of_documents(odd, docs):
    for frame in (odd, docs, docs.limit(1), docs.limit(0)):
        rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (-r[0], r[1]))
        want = sorted((i, len(t), hashlib.sha256(fingerprints.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
        got = fingerprints.fingerprinted(frame.repartition(4)).collect()
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


# ---- byte-level BPE ---------------------------------------------------------------------------------------------------


def test_tokens(odd):
    c = bpe.codec(bpe.default_ranks(), bpe._pattern(None))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd).collect())
    whole = lambda t: c.encoding.encode_ordinary(t or "")
    assert got == sorted((i, len(whole(t)), hashlib.sha256(" ".join(map(str, whole(t))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    out = bpe.decode(bpe.encode(odd.select("doc_id", "text")))
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in out.collect())


def test_parts_meet_at_safe_places():
    c = bpe.codec(bpe.default_ranks(), bpe._pattern(None))
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab1 \n\t'sé.  日") for _ in range(rng.randint(0, 120)))
        assert c.encode(text, 7) == c.encoding.encode_ordinary(text) and "".join(bpe.safe_parts(text, 7)) == text


# ---- toxicity and quality ---------------------------------------------------------------------------------------------


def channel_of(times):
    return toxicity.Channel.of(*toxicity.trigrams(" ".join(w for w, n in times.items() for _ in range(n))))


@pytest.mark.parametrize("written", ["id10t", "1.d-i0t", "iddiioot", "i d i o t", "$h1t!", "a@@a", "0", "ооо3", "th3", "(un7"])
def test_viterbi_against_all_readings(written):
    channel = channel_of({"idiot": 50, "the": 500, "is": 300, "dot": 20, "count": 9, "слово": 7})
    spaced = len(written) > 2 and all(c in toxicity.BETWEEN for c in written[1::2])
    readings = [("", 0.0)]
    for i in range(len(written)):
        readings = [(r + x, s + cost) for r, s in readings for x, cost in channel.moves(written, i, spaced)]
    score = lambda r: sum(channel.logp(("  " + r)[k : k + 2], c) for k, c in enumerate(r + " "))
    best = max(s + score(r) for r, s in readings)
    got = channel.decode(written)
    assert max(s + score(r) for r, s in readings if r == got) == pytest.approx(best)


@pytest.mark.parametrize("written", ["1d10t", "i d i o t", "idioooot", "i.d.i.o.t", "!d!ot", "IDIOT"])
def test_deobfuscation(written):
    channel = channel_of({"idiot": 50, "the": 500, "is": 300, "at": 100, "dot": 20, "it": 90})
    assert channel.restore(f"the {written} is") == "the idiot is"
    assert channel.words(f"the {written} is")["idiot"] == 1


@pytest.mark.parametrize("written, word", [("idio7", "idiot"), ("idi07", "idiot"), ("tras#", "trash"), ("scum5", "scums"), ("l053r", "loser"), ("l0$3r", "loser"), ("50(um", "socum"), ("1053r", "loser"), ("w0rthl3$$", "worthless"), ("d15gu571ng", "disgusting"), ("stuupid", "stupid"), ("mooronn", "moron"), ("i  d\ti o\nt", "idiot"), ("idiot!", "idiot")])
def test_deobfuscation_in_any_place(written, word):
    channel = channel_of({w: 60 for w in ("idiot", "trash", "scums", "loser", "socum", "worthless", "disgusting", "stupid", "moron")} | {"the": 500, "is": 300, "at": 100})
    assert channel.words(f"the {written} is")[word] == 1 and channel.restore(f"the {written} is").split()[1] == word


def test_doubled_letters_as_viterbi_reads_them():
    channel = channel_of({"idiot": 50, "the": 500, "moon": 40, "abba": 9, "aab": 7, "baab": 5})
    rng = random.Random(2)
    listed = {"".join(rng.choice("abioomndt") for _ in range(rng.randint(1, 9))) for _ in range(3000)} | {"idioot", "iidiott", "mmoonn", "aabb", "aa"}
    listed = {w for w in listed if not re.search(r"(.)\1\1", w)}
    assert [w for w in listed if channel.undoubled(w) != channel.decode(w)] == []


def test_letter_counts(spark):
    texts = ["the idiot is a zebra", "the cat, слово!", None, ""]
    got = toxicity.letter_counts(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3))
    tri = Counter(f"  {w} "[i : i + 3] for t in texts for w in re.findall(r"[^\W\d_]+", t or "") for i in range(len(w) + 1))
    assert got.total == sum(tri.values()) == got.cells.sum() == got.starts.sum()
    symbol = got._symbol
    for t, n in tri.items():
        x, y, z = map(symbol, t)
        assert got.cells[toxicity._cell((x << 10 | y) << 10 | z)] >= n
        assert got.starts[x << 10 | y] == sum(k for u, k in tri.items() if u[:2] == t[:2]) and got.pairs[y << 10 | z] == sum(k for u, k in tri.items() if u[1:] == t[1:])


def test_evidence_of_many_texts(spark):
    """Texts scanned together give what each text's restored words give."""
    channel = channel_of({"idiot": 50, "the": 500, "is": 300, "house": 90})
    model = toxicity.Model(channel, {"idiot": 3.0, "idi-": 2.0}, np.zeros(0), 0.5)
    texts = ["the 1d10t is", "", "i d i o t the", "IDIOT idiot, id!ot", "house " * 50, "the\tx y z q"]
    assert model.evidences(texts).tolist() == [model.evidence(channel.words(t)) for t in texts]


def held_out_right(got, labels, label, modulus, left):
    both = [(r.predicted, y) for r in got if (y := labels.get(r.doc_id)) is not None and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == left) for r in got)
    return sum(p == y for p, y in both) / len(both)


def test_held_out_labels(spark):
    """Both classifiers, on labels that they don't learn from."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    of = lambda label: {r.doc_id: r[label] for r in labels.collect()}
    assert held_out_right(toxicity.classified(docs, labels).collect(), of("toxic"), "toxic", 5, 0) >= 0.93
    assert held_out_right(quality.classified(docs, labels).collect(), of("quality"), "quality", 4, 2) >= 0.9


def labelled(spark, bad, n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        w = [rng.choice("alpha beta gamma delta house river stone".split()) for _ in range(30)]
        if toxic:
            w[5] = w[20] = bad
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(toxic)))
    return table(spark, rows), labels


def test_toxicity(spark, odd):
    docs, labels = labelled(spark, "scumbag")
    frame = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    extra = table(spark, [(10000, "a 5cumb4g scumbag alpha", "en", "s"), (10001, None, "en", "s")])
    got = {r.doc_id: r for r in toxicity.classified(docs.unionByName(extra), frame).collect()}
    assert all(got[i].predicted == y for i, y in labels) and got[10000].predicted == 1 and got[10001].predicted == 0
    none = toxicity.classified(odd, frame.limit(0)).collect()
    assert len(none) == len(ODD) and all(r.score == 0.5 for r in none)
    assert toxicity.classified(odd.limit(0), frame).count() == 0


def test_features_are_a_gaussian_kernel_and_the_fit_is_ridge(spark, sf_dir, docs):
    Q = quality
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r.doc_id, r.text, labels[r.doc_id]) for r in docs.collect() if r.doc_id in labels]
    model = Q.fit_on(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    x, y = Q.statistics_of([t for _, t, _ in rows]), np.array([y for *_, y in rows], float)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0) + 1e-3, rel=1e-3)
    z = Q.features(model.mean, model.scale, model.weights, x)
    u = np.clip((x - model.mean) / model.scale, -8, 8)
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(2) / (2 * len(Q.STATS)))
    assert np.abs(z[:, 1:] @ z[:, 1:].T - kernel).mean() < 0.08
    k = z.shape[1]
    gram = z.T @ z
    direct = np.linalg.solve(gram + Q.RIDGE * max(1.0, gram[0, 0]) / k * np.eye(k), z.T @ y)
    assert z @ model.beta == pytest.approx(z @ direct, abs=1e-4)


def test_quality(spark, sf_dir, docs, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.classified(docs.unionByName(odd.select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10**6)), labels)
    both = got.join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert both > 0.9 and got.where("score < 0 or score > 1 or score is null").count() == 0 and got.count() == docs.count() + len(ODD)
    assert {r.score for r in quality.classified(odd, labels.limit(0)).collect()} == {0.5}


def test_isotonic():
    at, values = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert values.tolist() == [0, 0.5, 1] and at.tolist() == [0, 1.5, 3]


# ---- pages ------------------------------------------------------------------------------------------------------------


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got, rest = [a[i] for i in page_diff.common(a, b)], iter(b)
        assert len(got) == t[-1][-1] and all(x in rest for x in got)


def test_page_text(spark):
    marked = "<html><head><title>t</title><script>'</p>'</script></head><body><nav>x</nav><div class=cookie-notice>c</div><article><header><h1>T &amp; x</h1></header><p>One <b>two</b><br>three&nbsp;four<p>Five<ul><li>a<li>b</ul><section id=comments>c</section></article><aside>s</aside><footer>f</footer>"
    rows = [(i, f"https://a.org/en/{i}.html", f"<body><div>Home</div><p>Story {i}</p><div>Imprint</div></body>") for i in range(12)]
    rows += [(100, "https://b.org/1", marked), (101, None, None), (102, "http://[bad", ""), (100, "https://b.org/1", marked)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in page_diff.extracted(frame).collect())
    assert got[:12] == [(i, f"Story {i}", len(f"Story {i}")) for i in range(12)]
    assert got[12:14] == [(100, "T & x\nOne two three four\nFive\na\nb", 33)] * 2 and [g[1] for g in got[14:]] == ["", ""]
    assert page_diff.extracted(frame.limit(0)).count() == 0


def texts_of(spark, pages):
    frame = spark.createDataFrame([(i, f"https://c.org/n/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in page_diff.extracted(frame).orderBy("page_id").collect()]


def test_marked_pages_are_differenced(spark):
    body = lambda i, story: f"<div>Our town</div><div>By writer {i}</div><article><p>{story}</p><p>All stories end so</p></article><div>Imprint</div>"
    got = texts_of(spark, [body(i, f"A long story of number {i} and what became of it") for i in range(6)])
    assert got == [f"By writer {i}\nA long story of number {i} and what became of it\nAll stories end so" for i in range(6)]


def test_weaker_marks_and_noise_articles(spark):
    lead = lambda i: f"<main><h1>Title {i}</h1><p>Lead {i}</p><article class='post comments-open'><p>Story {i}</p></article></main>"
    card = lambda i: f"<div class=content><p>The body of {i}</p><p>Read on</p></div><article class=related><p>Card {i}</p></article><article class=teaser>Short {i}</article>"
    assert texts_of(spark, [lead(i) for i in range(3)]) == [f"Title {i}\nLead {i}\nStory {i}" for i in range(3)]
    assert texts_of(spark, [card(i) for i in range(3)]) == [f"The body of {i}\nShort {i}" for i in range(3)]
    assert texts_of(spark, ["<article><p>Story</p><article class=user-comment>Nice</article></article><article class='has-sidebar'>More</article>"]) == ["Story\nMore"]


def test_copies_and_boilerplate(spark):
    site = "".join(f"<div>{k} of the town and its surroundings since 1890</div>" for k in ("News", "Sport", "Trade", "Weather", "Letters", "Culture", "Notices of death", "Jobs", "Flats", "Cars", "Imprint", "Terms"))
    story = lambda i: f"A short story numbered {i}"
    page = lambda x, more="": f"<body>{site}<p>{x}</p>{more}</body>"
    assert texts_of(spark, [page(story(i)) for i in range(5)]) == [story(i) for i in range(5)]
    assert texts_of(spark, [page(story(i // 2)) for i in range(10)]) == [story(i // 2) for i in range(10)]  # each page twice
    long = "A long story of the harbour. " * 60
    assert texts_of(spark, [page(f"{long}x"), page(long), page(long, "<p>As of May</p>"), page(f"{long}y")]) == [f"{long}x", long.strip(), f"{long.strip()}\nAs of May", f"{long}y"]


def test_marks_that_name_no_article(spark):
    """A class or main around the site's lines protects none of them; a heading inside an article stays whatever its class says."""
    site = lambda x, mark: f"<div {mark}><p>Home and all about it</p><p>A story of number {x}</p><p>Imprint of the house</p></div>"
    for mark in ("id='content'", "class='main'", "role='main'"):
        assert texts_of(spark, [site(i, mark) for i in range(5)]) == [f"A story of number {i}" for i in range(5)]
    assert texts_of(spark, ["<article><h2 class='related-work'>Related work</h2><p>Text</p></article>"]) == ["Related work\nText"]


def test_pages_without_a_host_are_apart(spark):
    pages = [(1, None), (2, None), (3, "no url"), (4, "no url"), (5, "http://[bad")]
    frame = spark.createDataFrame([(i, u, f"<p>One line</p><p>Page {i}</p>") for i, u in pages], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in page_diff.extracted(frame).collect()} == {i: f"One line\nPage {i}" for i, _ in pages}


def test_common_in_little_memory(monkeypatch):
    rng = random.Random(9)
    for _ in range(40):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 40))] for _ in range(2))
        monkeypatch.setattr(page_diff, "ROWS", 1 << 26)
        n = len(page_diff.common(a, b))
        monkeypatch.setattr(page_diff, "ROWS", 20)
        got, rest = page_diff.common(a, b), iter(b)
        assert len(got) == n and all(a[i] in rest for i in got)


def test_whole_extraction_against_a_plain_version(spark):
    """Hosts of pages in random order: the plain version sorts each host's paths and compares with a table of common lengths."""

    def plain_common(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    rng, pages = random.Random(12), []
    for h in range(6):
        menu = [f"Menu {h} entry {k}" for k in range(4)]
        for p in rng.sample(range(1000), 9):
            own = [f"Story {h} {p} paragraph {k} and so on at some length" for k in range(rng.randint(2, 6))]
            pages.append((h, f"/{rng.choice(['a', 'b'])}/{p}", menu[:2] + own + menu[2:], own))
    rng.shuffle(pages)
    frame = spark.createDataFrame([(i, f"https://h{h}.example.org{p}", "".join(f"<p>{x}</p>" for x in lines)) for i, (h, p, lines, _) in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text.split("\n") for r in page_diff.extracted(frame).collect()}
    for i, (h, path, lines, own) in enumerate(pages):
        host = sorted((p, ls) for hh, p, ls, _ in pages if hh == h)
        at = [p for p, _ in host].index(path)
        near = [host[k] for k in (at - 1, at + 1) if 0 <= k < len(host)]
        other = near[0] if len(near) == 1 or page_diff.nearer(path, near[0][0], near[1][0]) else near[1]
        assert len(lines) - len(got[i]) == plain_common(lines, other[1]) and got[i] == own


# ---- personal data ----------------------------------------------------------------------------------------------------


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms(spark, odd):
    rows = ["card 4041894974608795!! and 4041-8949-7460-8795, not 4041894974608796", "+1 (974) 555-3436 and +1 974-555-3436", "ip 97.51.17.173. bad 300.1.1.1 and 1.2.3.4.5", "born 1985-02-28, 28/02/1985, 28.02.1985, bad 2020-13-45", "ssn 123-45-6789 bad 000-12-3456", "GB29 NWBK 6016 1331 9268 19 DE89370400440532013000", "jo.7@mail3.example.com, x@y.org", None, "", "9" * 3000]
    frame = table(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])
    out = pii.pseudonymised(frame, "k", found="n_found")
    got = [r.text for r in out.orderBy("doc_id").collect()]
    a, b, c = re.findall(r"[\d-]{16,}", got[0])
    assert luhn(a) and a == b.replace("-", "") and a != "4041894974608795" and c == "4041894974608796"
    assert re.fullmatch(r"\+1 \((\d{3})\) (\d{3}-\d{4}) and \+1 \1-\2", got[1]) and "300.1.1.1 and 1.2.3.4.5" in got[2] and "97.51.17.173" not in got[2]
    y, m, d = re.search(r"born (\d{4})-(\d\d)-(\d\d)", got[3]).groups()
    assert f"{d}/{m}/{y}, {d}.{m}.{y}, bad 2020-13-45" in got[3] and "000-12-3456" in got[4] and "123-45-6789" not in got[4]
    iban = re.sub(" ", "", re.match(r"GB.{25}", got[5]).group())
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"[a-z]{2}\.\d@mail3\.example\.com, [a-z]@y\.org", got[6]) and got[7] is None and got[8] == "" and got[9] == rows[9]
    back = [r.text for r in pii.pseudonymised(out, "k", back=True).orderBy("doc_id").collect()]
    assert back == rows and pii.pseudonymised(odd, "k").columns == odd.columns and pii.pseudonymised(odd.limit(0), "k").count() == 0


def test_adjacent_values(spark):
    values = {"email": "jo.7@mail3.example.com", "iban": "GB29 NWBK 6016 1331 9268 19", "iban2": "DE89370400440532013000", "ip": "190.137.223.204", "date": "1985-02-28", "ssn": "123-45-6789", "phone": "+1 (826) 555-4081", "phone2": "+49 30 1234567", "local": "974-555-3436", "card": "4111111111111111", "card2": "4111 1111 1111 1111"}
    pairs = [(a, b) for a in values for b in values]
    one = dict(zip(values, (r.text for r in pii.pseudonymised(spark.createDataFrame([(i, v) for i, v in enumerate(values.values())], "i int, text string"), "k").orderBy("i").collect())))
    assert all(one[k] != v for k, v in values.items())
    rows = [f"{values[a]} {values[b]}" for a, b in pairs] + [f"{values['card']} 12", f"12 {values['card']}", f"{values['card2']} 05/27", f"{values['phone']} 39 cats", f"{values['phone']} 39", "+49 30 1234567 123 4567 8901", "AB12 4111 1111 1111 1111"]
    got = pii.pseudonymised(spark.createDataFrame(list(enumerate(rows)), "i int, text string"), "k", found="n")
    texts = [r.text for r in got.orderBy("i").collect()]
    card, card2, phone = (one[k] for k in ("card", "card2", "phone"))
    assert [(x, y) for x, y in zip(texts, [f"{one[a]} {one[b]}" for a, b in pairs]) if x != y] == []
    assert texts[len(pairs) :][:5] == [f"{card} 12", f"12 {card}", f"{card2} 05/27", f"{phone} 39 cats", f"{phone} 39"] and texts[-1] == f"AB12 {card2}"
    assert "1234567" not in texts[-2] and got.where("n <> 2").count() == 7
    assert [r.text for r in pii.pseudonymised(got, "k", back=True).orderBy("i").collect()] == rows


def plain_feistel(values, moduli, kind, key):
    half = len(values) // 2
    for i in range(pii.ROUNDS):
        first = i % 2 == 0
        other = values[half:] if first else values[:half]
        said = "|".join([key, kind, str(i), str(len(values)), ",".join(map(str, other))])
        stream = "".join(hashlib.sha256(f"{said}#{k}".encode()).hexdigest() for k in (0, 1))
        values = [(v + int(stream[j % 32 * 4 : j % 32 * 4 + 4], 16)) % m if (j < half) == first else v for j, (v, m) in enumerate(zip(values, moduli))]
    return values


def test_pseudonyms_against_a_plain_feistel(spark):
    def card(digits, key):
        body = "".join(map(str, plain_feistel([int(c) for c in digits[:-1]], [10] * (len(digits) - 1), "card", key)))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def address(ip, key):
        return ".".join(map(str, plain_feistel([int(x) for x in ip.split(".")], [256] * 4, "ip", key)))

    rows = ["4111111111111111", "378282246310005", "190.137.223.204", "6011000990139424"]
    for key in ("k", "another key"):
        got = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(rows)), "i int, text string"), key).orderBy("i").collect()]
        assert got == [address(x, key) if "." in x else card(x, key) for x in rows]


def test_values_before_digits_and_short_words(spark):
    """What follows a valid value by a blank must not hide it."""
    rows = ["4111 1111 1111 1111 123", "4111 1111 1111 1111 12/25", "BE68 5390 0754 7034 THE", "ES91 2100 0418 4502 0005 1332 AND", "paid 4111 1111 1111 1111 4111 1111 1111 1111 twice", "IBAN GB29 NWBK 6016 1331 9268 19 OR CASH"]
    values = [["4111 1111 1111 1111"], ["4111 1111 1111 1111"], ["BE68 5390 0754 7034"], ["ES91 2100 0418 4502 0005 1332"], ["4111 1111 1111 1111"], ["GB29 NWBK 6016 1331 9268 19"]]
    flat = sorted({v for vs in values for v in vs})
    run = lambda xs: [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(xs)), "i int, text string"), "k").orderBy("i").collect()]
    one = dict(zip(flat, run(flat)))
    assert all(a != b for a, b in one.items())
    want = []
    for row, vs in zip(rows, values):
        for v in vs:
            row = row.replace(v, one[v])
        want.append(row)
    assert run(rows) == want


def test_different_values_stay_different(spark):
    frame = spark.createDataFrame([(f"{i:03d}-55-{j:04d}",) for i in range(1, 40) for j in range(1, 40)], "text string")
    assert pii.pseudonymised(frame, "k").distinct().count() == 39 * 39


# ---- neighbours, pipeline ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    """Bins of a plain loop over the shingles; each empty bin asks the bins of its row of attempts in order."""
    F5 = fingerprints
    hashes, _ = F5.shingle_hashes(*F5.word_hashes([text]), F5.WORDS)
    bins = [None] * F5.BINS
    for h in hashes.tolist():
        b = h >> (64 - F5.BINS.bit_length() + 1)
        bins[b] = h if bins[b] is None else min(bins[b], h)
    if not any(x is not None for x in bins):
        return b""
    filled = [x if x is not None else next(bins[j] for j in F5._attempts(F5.BINS)[i].tolist() if bins[j] is not None) for i, x in enumerate(bins)]
    bits = "".join(format(int(F5.mixed(np.array([x], np.uint64))[0]) & (1 << F5.BITS) - 1, f"0{F5.BITS}b") for x in filled)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_fingerprints_against_a_plain_version(docs):
    texts = [(r.text or "").encode() for r in docs.limit(30).collect()] + [b"", b"one", b"a b c d e f", b"x " * 4000]
    assert fingerprints.fingerprint_rows(texts) == [plain_fingerprint(t) for t in texts]


def test_registered_queries():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert neighbours and common


def test_pipeline_of_odd_rows(spark, sf_dir):
    """Nulls, blanks, repeated rows, an empty table, and columns of the names that the stages use inside."""
    import corpus_pipeline as C

    extra = "score double, row long, stats string, n long, copy long, of string, all long, alike long, key string, text_ string"
    rows = [(i, t, lang, s, n, 0.5, 1, "s", 2, 3, "o", 4, 5, "k", None) for i, t, lang, s, n in [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t", "en", None, 2), (4, "x " * 30000, "en", "b", 60000), (5, "the cat sat on the mat and ran away", "en", "b", 5), (5, "the cat sat on the mat and ran away", "en", "b", 5), (None, "one row without an id at all", "en", "c", 7), (None, None, None, None, None)]]
    odd_docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns
        got = Counter(r.doc_id for r in out.collect())
        assert set(got) <= {1, 2, 3, 4, 5, None}
        if name == "near duplicates":
            assert got == Counter([1, 2, 3, 4, 5, None, None])
        if name == "personal data":
            assert sum(got.values()) == len(rows)
        if name == "mix":
            want = Counter()
            for r in mixing.mixed(odd_docs).collect():
                want[r.doc_id] += r.copies
            assert got == Counter({i: k for i, k in want.items() if k})
        assert stage(spark, odd_docs.limit(0), sf_dir).count() == 0
    assert C.STAGES[-1][1](spark, odd_docs, sf_dir).count() == len(rows)


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as C

    now = docs.unionByName(docs.limit(3))
    for name, stage in C.STAGES:
        before, now = now, common.stored(stage(spark, now, sf_dir), "t")
        if name != C.STAGES[-1][0]:
            assert now.columns == docs.columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            kept = {r.doc_id for r in now.collect()}
            wrong = sum((i in kept) != (q == 1) for i, q in labels.items())
            assert wrong <= 0.1 * len(labels)
        if name == "near duplicates":
            rows = {r.doc_id: r.text for r in before.collect()}
            want = {i for i, (_, c) in brute_components(list(rows.items()), 5, 80).items() if i == c}
            ids = [r.doc_id for r in now.collect()]
            assert sorted(ids) == sorted(want)
        if name == "personal data":
            assert now.count() == before.count()
        if name == "mix":
            mix = {r.doc_id: r.copies for r in mixing.mixed(before).collect()}
            assert Counter(r.doc_id for r in now.collect()) == Counter({i: k for i, k in mix.items() if k})
        if name == "tokens":
            assert Counter(r.doc_id for r in now.collect()) == Counter(r.doc_id for r in before.collect())
