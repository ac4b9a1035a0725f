"""Language-model scoring, centroid clustering and hard-negative mining against brute force, with their edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwise.llm import centroids, hard_negatives
from stepwise.llm import ngram_lm as lm

NAMES = ["ash", "Birch", "cedar", "DOGWOOD", "elm", "fir", "été", "x" * 70, "x" * 71, "abcdefgh", "abcdefghi"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    words = NAMES + [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choices(words, weights=[40] * 11 + [1] * 400, k=rnd.randint(1, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "never seen before"), (304, "ash\x1cash \x0b fir"), (305, "ab" * 300_000 + " ash " * 30_000), (None, "ash elm"), (7, rows[7][1]), (7, rows[7][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("N_known", F.lit(2))


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + [None]


def expected(train, rows, level):
    """Scores by plain counts; ``level(prev, token, count)`` is the level of a pair."""
    count = collections.Counter(w for t in train for w in words_of(t))
    pairs = collections.Counter(p for t in train for p in zip([0, *words_of(t)], words_of(t)))
    n, v = sum(count.values()), len(count)
    out = []
    for t in rows:
        toks, base, score = words_of(t), 0.0, 0.0
        for prev, tok in zip([0, *toks], toks):
            b = (count[tok] + 0.1) / (n + 0.1 * (v + 1))
            before = len(train) if prev == 0 else count[prev]
            most = min(before, count[tok])
            j = min(level(prev, tok, pairs[prev, tok]), 0 if most == 0 else 1 + int(math.floor(math.log(most) / math.log(lm.BASE) + 1e-9)))
            base += math.log10(b)
            score += math.log10((min(lm.MEANS[j], before) + lm.STRENGTH * b) / (before + lm.STRENGTH))
        out.append((len(toks), sum(count[w] > 0 for w in toks), n, base, score))
    return out


def scalar_hash(word):
    low = word.encode()
    one = lm._hashes(np.frombuffer(low, np.uint8), np.array([0]), np.array([len(low)]))
    return int(one[0])


def member(bits, short, level):
    """One event of the filter, asked for with plain whole numbers."""
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    size, h = len(bits) * 8, mix((short << 8) + level)
    return all(bits[p >> 3] >> (p & 7) & 1 for p in ((h % size + i * ((mix(h) | 1) % size)) % size for i in range(lm.PROBES))), mix


def results(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect())


def test_scores_equal_brute_force_of_counts_and_filter(spark, texts):
    train = texts.where("doc_id % 3 <> 0 or doc_id is null")
    model = lm.train(train, block_bytes=1 << 18)
    assert model.block_bits >= 2
    got = results(lm.score(texts, model))
    rows = texts.collect()
    learned = [r["text"] for r in train.collect()]
    blocks = {r["block"]: r["bits"] for r in model.blocks.collect()}
    hashes = {}

    def filtered(prev, tok, count):
        def h(x):
            if x is None or x == 0:
                return int(lm._END if x is None else lm._START)
            if x not in hashes:
                hashes[x] = scalar_hash(x)
            return hashes[x]
        _, mix = member(b"\0" * 8, 0, 0)
        key = mix((h(prev) * 0xD6E8FEB86659FD93 + h(tok)) & (1 << 64) - 1)
        bits = blocks.get(key >> 64 - model.block_bits)
        short = (key << model.block_bits & (1 << 64) - 1) >> 32
        j = 0
        while bits and member(bits, short, j + 1)[0]:
            j += 1
        assert j >= (0 if count == 0 else 1 + math.floor(math.log(count) / math.log(lm.BASE) + 1e-9))  # a filter never forgets
        return j

    some = [r for r in rows if r["doc_id"] != 305]
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *e) for r, e in zip(some, expected(learned, [r["text"] for r in some], filtered)))
    got = [g for g in got if g[0] != 305]
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    exact = expected(learned, [r["text"] for r in some], lambda p, t, c: 0 if c == 0 else 1 + int(math.floor(math.log(c) / math.log(lm.BASE) + 1e-9)))
    near = [abs(a[4] - b[4]) < 0.05 * abs(b[4]) for (r, a), b in zip(sorted(((r["doc_id"] if r["doc_id"] is not None else -1, e) for r, e in zip(some, expected(learned, [r["text"] for r in some], filtered))), key=lambda x: x[0]), [e for _, e in sorted(((r["doc_id"] if r["doc_id"] is not None else -1, e) for r, e in zip(some, exact)), key=lambda x: x[0])])]
    assert np.mean(near) > 0.97


def test_scores_are_the_same_whether_blocks_are_broadcast_or_asked(spark, texts):
    model = lm.train(texts.where("doc_id < 150"), block_bytes=1 << 16)
    a = results(lm.score(texts, model, broadcast_bytes=1 << 40))
    b = results(lm.score(texts, model, broadcast_bytes=0, group_bytes=1 << 15))
    assert a == b and len(a) == texts.count()
    assert a == results(lm.score(texts.repartition(3), model, broadcast_bytes=0))


def test_score_edges(spark, texts):
    model = lm.train(texts)
    out = lm.score(texts, model)
    assert [c for c in out.columns if c.lower() in ("score", "n_known")] == ["n_known", "score"]
    seen = {r["doc_id"]: r for r in out.collect()}
    assert seen[300]["n_tokens"] == seen[301]["n_tokens"] == seen[302]["n_tokens"] == 1 and seen[300]["score"] == seen[301]["score"] < 0
    assert seen[304]["n_tokens"] == 3 and seen[305]["n_tokens"] == 30_002
    assert lm.score(texts.limit(0), model).count() == 0 and lm.score(texts.limit(0), model, broadcast_bytes=0).count() == 0
    none = lm.train(texts.limit(0))
    for way in (1 << 30, -1):
        r = lm.score(texts.where("doc_id = 303"), none, broadcast_bytes=way).first()
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (4, 0, 0, 0.0, 0.0)


def test_known_texts_score_higher_than_shuffled_ones(spark, texts):
    rnd = random.Random(1)
    model = lm.train(texts)
    pairs = [(i, t, " ".join(rnd.sample(t.split(" "), len(t.split(" "))))) for i, t in texts.where("doc_id < 200 and length(text) > 200").select("doc_id", "text").collect()]
    a = results(lm.score(spark.createDataFrame([(i, t) for i, t, _ in pairs], "doc_id long, text string"), model))
    b = results(lm.score(spark.createDataFrame([(i, t) for i, _, t in pairs], "doc_id long, text string"), model))
    assert np.mean([x[5] > y[5] for x, y in zip(a, b)]) > 0.95 and np.allclose([x[4] for x in a], [y[4] for y in b])


def test_filter_never_forgets_and_errs_as_its_size_says():
    rnd = np.random.default_rng(2)
    short = np.unique(rnd.integers(0, 1 << 32, 200_000, dtype=np.uint64).astype(np.uint32))
    counts = rnd.zipf(1.7, len(short)).clip(1, 10**9)
    bits = lm.filter_bits(short, counts)
    top = lm.levels(counts)
    got = lm._in_turn(bits, short)
    assert (got >= top).all() and np.mean(got > top) < 0.006
    other = np.setdiff1d(rnd.integers(0, 1 << 32, 200_000, dtype=np.uint64).astype(np.uint32), short)
    rate = (1 - math.exp(-lm.PROBES / lm.BITS_PER_EVENT)) ** lm.PROBES
    assert np.mean(lm._in_turn(bits, other) > 0) < 2 * rate
    assert list(lm.levels(np.array([0, 1, 2, 3, 4, 5, 6]))) == [0, 1, 2, 3, 4, 4, 5] and lm.MEANS[4] == 4.5


# ---------------------------------------------------------------- clustering

def lloyd(rows, k, rounds, scale=1024):
    vecs = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    start = sorted(vecs, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in vecs]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(vecs, own) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in vecs]
    spent = collections.Counter()
    for _, d, j in found:
        spent[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i if i is not None else -1, j, d, spent[j], sum(spent.values()), sha[j]) for i, d, j in found)


def test_clusters_equal_plain_lloyd_with_ties_and_odd_rows(spark):
    rnd = random.Random(9)
    rows = [(i, [round(rnd.gauss(i % 3, 0.4), 2) for _ in range(4)]) for i in range(120)]
    rows += [(200, [0.5] * 4), (201, [0.5] * 4), (202, [-3.25] * 4), (5, rows[5][1]), (5, rows[5][1]), (None, [1.0] * 4)]
    bad = [(300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 2.0, 3.0]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash"))
    for k, rounds in ((8, 10), (3, 0), (200, 2)):
        got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, *r[1:]) for r in centroids.cluster(df, width=4, k=k, rounds=rounds).collect())
        assert got == lloyd(rows, k, rounds)
    assert centroids.cluster(df.limit(0), width=4).count() == 0
    big = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(big, width=4).collect()


def test_search_rejects_without_error():
    rnd = np.random.default_rng(4)
    x = rnd.integers(-500, 500, (3000, 16)) + rnd.integers(-300, 300, (3000, 1))
    c = np.concatenate([x[:60], x[:3], x[5:6]])  # equal centroids: the smaller number wins
    who, dist, measured = centroids.Centroids(c).nearest(x)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (dist == every.min(axis=1)).all() and (who == every.argmin(axis=1)).all()
    assert measured < 0.7 * every.size


# ---------------------------------------------------------------- hard negatives

def mined(rows, positives=5, negatives=10):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in best.items():
        if a % 100:
            continue
        ranked = sorted((-score(v, w), i, lab) for i, (lab, w) in best.items() if i != a)
        for p, pos, lab in [r for r in ranked if r[2] == label][:positives]:
            fit = [(s, i) for s, i, lab2 in ranked if lab2 != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, pos, rank, i, -p, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, seed=0, width=6):
    rnd = random.Random(seed)
    return [(i, rnd.randint(0, 3), [rnd.choice([-1.0, 0.0, 0.5, 0.25, rnd.random()]) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("block_rows", [1 << 14, 40])
def test_negatives_equal_brute_force(spark, block_rows):
    rows = vectors(600) + [(700, 1, [0.0] * 6), (800, 2, [-1.0] * 6), (None, 1, [1.0] * 6), (901, None, [1.0] * 6), (902, 1, None), (903, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, 0, [float("nan")] * 6), (905, 3, [0.5, 0.5]), (1000, 1, [0.5] * 9), (906, 2, [])]
    rows += [rows[100], rows[100], (3, 2, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = sorted(tuple(r) for r in hard_negatives.mine(df, anchor=F.col("vec_id") % 100 == 0, block_rows=block_rows).collect())
    assert got == mined(rows) and len(got) > 50


def test_negatives_of_small_and_empty_tables(spark):
    df = spark.createDataFrame(vectors(3), "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(df.limit(0)).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(one).count() == 0


def test_threshold_stops_early_and_keeps_ties():
    rnd = np.random.default_rng(8)
    v = rnd.integers(-40, 40, (4000, 3))
    v[:50] += 400
    v[10:20] = v[10]
    block = hard_negatives.SortedBlock(np.arange(4000), np.zeros(4000), v)
    anchor = np.array([5, 7, 0])
    got, scored = block.search(anchor, np.ones(4000, bool), [(-(1 << 62), 1 << 62, 15)])
    every = sorted((-int(s), i) for i, s in enumerate(v @ anchor))[:15]
    assert [(-s, i) for i, s in zip(*map(list, got[0]))] == every
    assert scored < 1000
    nothing, scored = block.search(anchor, np.ones(4000, bool), [(10_000_000, 20_000_000, 5)])
    assert len(nothing[0][0]) == 0 and scored < 200


def test_sorted_keys_come_back_and_shrink():
    """Cells of ascending keys, empty ones too; at the size of a block their steps take less than the keys themselves."""
    import zlib

    rnd = np.random.default_rng(5)
    for kind in (np.uint32, np.uint64):
        keys = np.unique(rnd.integers(0, np.iinfo(kind).max, 20_000, dtype=kind, endpoint=True))
        ends = np.array([0, 1, 9_000, 9_000, len(keys)])
        cells = lm._sorted_cells(keys, ends).to_pylist()
        assert [len(c) // keys.itemsize for c in cells] == [0, 1, 8_999, 0, len(keys) - 9_000]
        assert (np.concatenate([lm._ascending(c, kind) for c in cells]) == keys).all()
        assert len(zlib.compress(cells[-1], 1)) < 0.9 * len(zlib.compress(keys[9_000:].tobytes(), 1))
        assert (lm._unplaned(lm._planes(keys), kind) == keys).all()
