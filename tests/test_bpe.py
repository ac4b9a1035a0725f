import heapq
import random

from stepwise.operators import bpe

# The corpus and the vocabulary expected of it.
WORDS = ["hug"] * 10 + ["pug"] * 5 + ["pun"] * 12 + ["bun"] * 4 + ["hugs"] * 5
EXPECTED = ['[PAD]', '[UNK]', '[EOS]', 'p', 'u', 'n', ',', ' ', 'g', 'h', 's', 'b',
            'ug', 'un', 'hug', 'pun', 'pug', 'hugs', 'bun']


def _corpus(spark, seed=0):
    w = list(WORDS)
    random.Random(seed).shuffle(w)
    return spark.createDataFrame([(0, ", ".join(w))], "doc_id long, text string")


def test_train_to_exhaustion(spark):
    model = bpe.bpe_train(_corpus(spark), "text", "doc_id", vocab_size=1000)
    assert sorted(model.tokens) == sorted(EXPECTED)
    assert ("h", "ug") in model.merges
    assert model.tokens[:3] == ["[PAD]", "[UNK]", "[EOS]"]


def test_encode_decode(spark):
    model = bpe.bpe_train(_corpus(spark), "text", "doc_id", vocab_size=1000)
    probe = spark.createDataFrame([(1, "hug un"), (2, ""), (3, "   ")], "k long, text string")
    enc = {r["k"]: r["ids"] for r in bpe.encode(probe, "text", "k", model).collect()}
    assert [model.tokens[i] for i in enc[1]] == ["hug", " ", "un", "[EOS]"]
    assert enc[2] == [bpe.EOS_ID] and enc[3] == [bpe.EOS_ID]
    dec = {r["k"]: r["text"] for r in bpe.decode(bpe.encode(probe, "text", "k", model), "ids", "k", model).collect()}
    assert dec[1] == "hug un[EOS]"


def _one_at_a_time(words_freq, vocab_size, alphabet):
    """Brute-force textbook BPE on a {word: freq} dict."""
    tokens = ["[PAD]", "[UNK]", "[EOS]"] + alphabet
    segs = {w: list(w) for w in words_freq if len(w) > 1}
    merges = []
    while len(tokens) < vocab_size:
        counts = {}
        for w, s in segs.items():
            for a, b in zip(s, s[1:]):
                counts[(a, b)] = counts.get((a, b), 0) + words_freq[w]
        if not counts:
            break
        (a, b) = min(counts, key=lambda p: (-counts[p], p[0].encode(), p[1].encode()))
        merges.append((a, b))
        if a + b not in tokens:
            tokens.append(a + b)
        for w, s in segs.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            segs[w] = out
    return tokens, merges


def test_batched_rounds_equal_one_at_a_time(spark):
    rng = random.Random(7)
    letters = "abcde"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
                      for _ in range(rng.randint(1, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = bpe.bpe_train(df, "text", "doc_id", new_tokens=40, head=8)
    for other in ({"guess_words": 0}, {"guess_words": 5, "guess_merges": 7}, {"guess_words": 20, "head": 300}):
        got = bpe.bpe_train(df, "text", "doc_id", new_tokens=40, **other)
        assert got.merges == model.merges and got.tokens == model.tokens
    freq = {}
    for t in texts:
        for w in t.split(" "):
            if w:
                freq[w] = freq.get(w, 0) + 1
    alphabet = model.tokens[3:3 + len([t for t in model.tokens[3:] if len(t) == 1])]
    tokens, merges = _one_at_a_time(freq, len(model.tokens), alphabet)
    assert merges == model.merges
    assert tokens == model.tokens


def _greedy(word, ranks):
    """Brute-force encoding: join the leftmost pair of lowest rank until none is left."""
    s = list(word)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]
        if not found:
            return s
        i = min(found)[1]
        s[i:i + 2] = [s[i] + s[i + 1]]


def test_full_size_model_equals_one_at_a_time(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    model = bpe.bpe_train(items, "text", "item_id", new_tokens=1000, guess_words=200)
    words = bpe.word_freq(items, "text", "item_id")
    freq = {r["word"]: r["freq"] for r in words.collect()}
    alphabet = [r["token"] for r in bpe.alphabet(words).orderBy("id").collect()]
    tokens, merges = _one_at_a_time(freq, 3 + len(alphabet) + 1000, alphabet)
    assert merges == model.merges and tokens == model.tokens
    assert len(merges) > 500
    for row in bpe.encode_words(words, model).collect():
        assert row["tokens"] == _greedy(row["word"], model.ranks)


def _one_at_a_time_indexed(freq, new_tokens):
    """Textbook BPE, one merge at a time, touching the words of the merged pair only."""
    alphabet = {c for w in freq for c in w}
    segs, counts, where, ever, merges = {w: list(w) for w in freq}, {}, {}, set(alphabet), []
    for w, s in segs.items():
        for p in zip(s, s[1:]):
            counts[p] = counts.get(p, 0) + freq[w]
            where.setdefault(p, set()).add(w)
    queue = [(-c, *p) for p, c in counts.items()]
    heapq.heapify(queue)
    while queue and len(ever) - len(alphabet) < new_tokens:
        c, a, b = heapq.heappop(queue)
        if c == 0 or counts[a, b] != -c:
            continue
        merges.append((a, b))
        ever.add(a + b)
        change = {}
        for w in where.pop((a, b)):
            out = []
            for x in segs[w]:
                if out and out[-1] == (a, None) and x == b:
                    out[-1] = (a + b, 1)
                else:
                    out.append((x, None))
            out = [x for x, _ in out]
            for p in zip(segs[w], segs[w][1:]):
                change[p] = change.get(p, 0) - freq[w]
            for p in zip(out, out[1:]):
                change[p] = change.get(p, 0) + freq[w]
                where.setdefault(p, set()).add(w)
            segs[w] = out
        for p, d in change.items():
            if d:
                counts[p] = counts.get(p, 0) + d
                heapq.heappush(queue, (-counts[p], *p))
    return merges


def test_incremental_rounds_equal_one_at_a_time_and_touch_fewer_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rounds = []
    model = bpe.bpe_train(docs, "text", "doc_id", new_tokens=3000, on_round=rounds.append)
    freq = {r["word"]: r["freq"] for r in bpe.word_freq(docs, "text", "doc_id").collect()}
    assert model.merges == _one_at_a_time_indexed(freq, 3000)
    assert sum(r["taken"] for r in rounds) >= 3000 and len(rounds) < 100
    third = len(rounds) // 3
    touched = [r["touched"] / max(1, r["taken"]) for r in rounds]
    assert sum(touched[-third:]) < 0.2 * sum(touched[:third])
    assert rounds[-1]["done"] > 1000  # segmentations were written anew on the way
    few = bpe.bpe_train(docs, "text", "doc_id", new_tokens=150, waiting=(3, 8), guess_merges=20, guess_words=300, head=400)
    assert few.merges == model.merges[:len(few.merges)] and len(few.merges) >= 150


def test_postings_agree_on_both_sides(spark):
    df = spark.createDataFrame([(["a", "b\x01", "é😀", "a", "b\x01"],), (["x"],), ([],)], "sym array<string>")
    got = [r[0] for r in df.select(bpe._postings("sym")).collect()]
    assert got == [[bpe._posting("a", "b\x01"), bpe._posting("b\x01", "é😀"), bpe._posting("é😀", "a")], [], []]


def test_replay_hears_every_change(spark):
    """Counts before every merge, from the changes that a word makes, equal counts made anew."""
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "ab"), ("a", "a"), ("aa", "b"), ("ab", "ab")]
        start = rng.randint(0, len(merges))
        counts = [{} for _ in range(len(merges) - start + 1)]

        def note(left, right, step, change):
            for c in counts[step:]:
                c[left, right] = c.get((left, right), 0) + change

        got = bpe.replay(word, bpe._times(merges), start, note)
        seq = list(word)
        for t in range(len(merges) + 1):
            if t >= start:
                now = {}
                for p in zip(seq, seq[1:]):
                    now[p] = now.get(p, 0) + 1
                assert {p: c for p, c in counts[t - start].items() if c} == now
            if t < len(merges):
                out, i = [], 0
                while i < len(seq):
                    if tuple(seq[i:i + 2]) == merges[t]:
                        out.append(seq[i] + seq[i + 1])
                        i += 2
                    else:
                        out.append(seq[i])
                        i += 1
                seq = out
        assert got == seq


def test_decode_out_of_range_raises(spark):
    model = bpe.BpeModel(["[PAD]", "[UNK]", "[EOS]", "a"], [])
    df = spark.createDataFrame([(1, [3, 2]), (2, [9])], "k long, ids array<int>")
    ok = bpe.decode(df.filter("k = 1"), "ids", "k", model).first()["text"]
    assert ok == "a[EOS]"
    import pytest
    with pytest.raises(Exception):
        bpe.decode(df.filter("k = 2"), "ids", "k", model).collect()


def test_alphabet_too_large_raises(spark):
    import pytest
    df = spark.createDataFrame([(0, "abcdef")], "doc_id long, text string")
    with pytest.raises(ValueError):
        bpe.bpe_train(df, "text", "doc_id", vocab_size=5)


def test_alphabet_order_emoji_and_separators(spark):
    df = spark.createDataFrame([(0, " ba😀b a@b\u001cbanana aaaa ")], "doc_id long, text string")
    words = {r["word"]: r["freq"] for r in bpe.word_freq(df, "text", "doc_id").collect()}
    assert words == {"ba😀b": 1, " ": 2, "a@b": 1, "\u001c": 1, "banana": 1, "aaaa": 1}
    ids = {r["token"]: r["id"] for r in bpe.alphabet(bpe.word_freq(df, "text", "doc_id")).collect()}
    assert [t for t, _ in sorted(ids.items(), key=lambda kv: kv[1])] == ["b", "a", "😀", " ", "@", "\u001c", "n"]
    model = bpe.bpe_train(df, "text", "doc_id", new_tokens=3)
    assert len(model.merges) >= 3
    probe = spark.createDataFrame([(1, "banana aaaa")], "k long, text string")
    rt = bpe.round_trip(probe, "text", "k", model).first()["text"]
    assert rt == "banana aaaa"


def test_replay_tells_only_changes(spark):
    """What the merges before the start change is what the pairs before and after them differ by; words that nothing changes tell nothing."""
    rng = random.Random(4)
    merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "ab"), ("aa", "b")]
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        start = rng.randint(0, len(merges))
        whole, changes = {}, {}
        got = bpe.replay(word, bpe._times(merges), start, lambda l, r, step, c: whole.update({(l, r, step): whole.get((l, r, step), 0) + c}))
        assert bpe.replay(word, bpe._times(merges), start, lambda l, r, step, c: changes.update({(l, r, step): changes.get((l, r, step), 0) + c}), changes=True) == got
        for pair in zip(word, word[1:]):
            whole[*pair, 0] = whole.get((*pair, 0), 0) - 1
        assert {k: c for k, c in whole.items() if c} == {k: c for k, c in changes.items() if c}
    told = []
    bpe.replay("ccc", bpe._times(merges), 2, lambda *a: told.append(a), changes=True)
    assert told == []
