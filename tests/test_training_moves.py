"""Training sends every distinct word once, without its first place, and keeps its states in small files."""

import os
import random

import pytest

from stepwise.operators import bpe


def _local(state):
    return state.path.removeprefix("file:")


def test_training_sends_each_word_once(spark, monkeypatch):
    of, plans, states = bpe.Segmented.of.__func__, [], []

    def spy(cls, segs, done):
        plans.append(segs._jdf.queryExecution().executedPlan().toString())
        states.append(of(cls, segs, done))
        assert os.path.isdir(_local(states[-1])) and not any(os.path.isdir(_local(s)) for s in states[:-2])
        return states[-1]

    monkeypatch.setattr(bpe.Segmented, "of", classmethod(spy))
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(20)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = bpe.bpe_train(df, "text", "doc_id", new_tokens=60, guess_merges=10, waiting=(16, 16))
    assert plans[0].count("Exchange") == 1 and "SortAggregate" not in plans[0] and "InMemory" not in plans[0]
    assert len(states) > 1 and not any(os.path.exists(_local(s)) for s in states)
    assert len(model.merges) >= 60


def test_words_of_a_state_fill_several_files(spark, monkeypatch):
    monkeypatch.setattr(bpe, "FILE_WORDS", 100)
    words = spark.range(0, 1000, 1, 1).selectExpr("split(concat('ab', id), '') sym", "id + 1 freq")
    state = bpe.Segmented.of(words, 0)
    assert len([f for f in os.listdir(_local(state)) if f.endswith(".parquet")]) == 10
    got = {"".join(r["sym"]): (r["sym"], r["freq"], r["pairs"]) for r in state.segs.collect()}
    for i in range(1000):
        sym = list(f"ab{i}")
        assert got[f"ab{i}"][:2] == (sym, i + 1)
        assert got[f"ab{i}"][2] == list(dict.fromkeys(bpe._posting(*p) for p in zip(sym, sym[1:])))
    counts = {(r["left"], r["right"]): r["count"] for r in state.counts.collect()}
    assert counts["a", "b"] == 1000 * 1001 // 2
    state.drop()
    assert not os.path.exists(_local(state))


def _places(rows):
    """Per character the first (key, word, place), nulls first."""
    best = {}
    for k, text in rows:
        pos, words = 0, []
        for w in bpe.word_lists(bpe.pa.array([(text or "").strip()], bpe.pa.string())).flatten().to_pylist():
            words.append((pos, w))
            pos += 1
        for pos, w in words:
            for c in w:
                at = ([(x is not None, x or 0) for x in k], pos, w.index(c))
                best[c] = min(best.get(c, at), at)
    return best


@pytest.mark.parametrize("most", [bpe.LOT_BYTES, 200])
def test_alphabet_of_texts(spark, monkeypatch, most):
    monkeypatch.setattr(bpe, "LOT_BYTES", most)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "b", "c", "é", "😀", " ", "  ", ",", "-", "x1", "　", chr(rng.randint(0x4E00, 0x4E40))]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for kinds in ([None, 1, 2, 3, 50, 7], [4], range(300)):
        rows = [((rng.choice(kinds), rng.choice([None, 1, 2])), rng.choice([None, "", t, t, t])) for t in texts]
        best = _places(rows)
        df = spark.createDataFrame([(*k, t) for k, t in rows], "k long, u int, text string")
        for parts in (1, 7):
            ids = {r["token"]: r["id"] for r in bpe.alphabet(df.repartition(parts), "text", ["k", "u"]).collect()}
            assert sorted(ids.values()) == list(range(3, 3 + len(best))) and ids.keys() == best.keys()
            assert [best[c] for c in sorted(ids, key=ids.get)] == sorted(best.values())


def test_alphabet_of_nested_keys_and_no_texts(spark):
    df = spark.createDataFrame([([2], "b a"), ([1], "a"), (None, "c"), ([1], None)], "k array<int>, text string")
    assert {r["token"]: r["id"] for r in bpe.alphabet(df, "text", "k").collect()} == {"c": 3, "a": 4, "b": 5, " ": 6}
    assert bpe.alphabet(df.where("text is null"), "text", "k").count() == 0
    assert bpe.alphabet(df.where("false"), "text", "k").count() == 0
