"""Steps whose cost must follow the data: micro-batches by append, word tallies made in the tasks, bounded Python batches."""

from stepwise.operators import bpe
from stepwise.plans import catalog
from stepwise.streaming import ordered


def _events(spark, path, runs=20, steps=30):
    rows = spark.range(runs * steps).selectExpr(
        "id event_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, int(id div 4)) ts", f"id % {runs} user_id",
        "if(id % 7 = 0, 'error', 'click') event_type", "double(id % 11) value", "'{}' props")
    rows.write.parquet(f"{path}/events.parquet")


def test_shuffled_stream_takes_an_append_in_a_micro_batch(spark, tmp_path, monkeypatch):
    _events(spark, tmp_path)
    outs, started = [], ordered.append_batches

    def seen(stream, path, *rest):
        outs.append(path)
        return started(stream, path, *rest)

    monkeypatch.setattr(ordered, "append_batches", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many files an append, as on a large cluster
    try:
        rows = catalog.QUERIES["stream_log_summary_shuffled"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n_steps"] for r in rows) == 600
    assert len({r["run_id"] for r in rows}) == 20
    assert spark.read.json(f"{outs[0]}/manifest/*/*").distinct().count() == 5


def _by_hand(rows):
    """(word, freq, first) of (keys, text) rows; nulls come first."""
    import re

    from stepwise.functions.text import WORD_PATTERN
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), WORD_PATTERN)
    low = lambda k: tuple((x is not None, x) if x is not None else (False, 0) for x in k)
    freq, first = {}, {}
    for keys, text in rows:
        for pos, w in enumerate(re.findall(pattern, (text or "").strip())):
            freq[w] = freq.get(w, 0) + 1
            if w not in first or (low(keys), pos) < (low(first[w][0]), first[w][1]):
                first[w] = (keys, pos)
    return {w: (n, *first[w]) for w, n in freq.items()}


def test_words_and_alphabet_of_repeated_and_null_keys(spark, monkeypatch):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "b", "c", "é", "😀", " ", "  ", ",", "-", "x1", "\u3000"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = [((rng.choice([None, 1, 2, 3, 50, 7]), rng.choice([None, "u", "v", ""])), rng.choice([None, "", t, t, t])) for t in texts]
    df = spark.createDataFrame([(*k, t) for k, t in rows], "k long, u string, text string")
    for most in (bpe.LOT_BYTES, 50):
        monkeypatch.setattr(bpe, "LOT_BYTES", most)
        for parts in (1, 7):
            some = df.repartition(parts)
            words = bpe.word_freq(some, "text", ["k", "u"])
            found = {r["word"]: (r["freq"], (r["first"]["k"], r["first"]["u"]), r["first"]["pos"]) for r in words.collect()}
            assert found == _by_hand(rows)
            place = lambda w: ([(x is not None, x or (0 if i == 0 else "")) for i, x in enumerate(found[w][1])], found[w][2])
            best = {c: min((place(w), w.index(c)) for w in found if c in w) for c in "".join(found)}
            ids = {r["token"]: r["id"] for r in bpe.alphabet(words).collect()}
            assert [best[c] for c in sorted(ids, key=ids.get)] == sorted(best.values())
            assert sorted(ids.values()) == list(range(3, 3 + len(best)))


def test_words_reach_the_shuffle_tallied(spark):
    df = spark.range(0, 2000, 1, 4).selectExpr("id doc_id", "repeat('aa bb cc ', 50) text")
    words = bpe.word_freq(df, "text", "doc_id")
    assert "Generate" not in words._jdf.queryExecution().executedPlan().toString()  # no row for each occurrence
    assert {r["word"]: r["freq"] for r in words.collect()} == {"aa": 100_000, "bb": 100_000, "cc": 100_000, " ": 298_000}


def test_nested_and_empty_inputs_of_words(spark):
    df = spark.createDataFrame([([2], "b a"), ([1], "a"), (None, "c"), ([1], None)], "k array<int>, text string")
    found = {r["word"]: (r["freq"], r["first"]["k"], r["first"]["pos"]) for r in bpe.word_freq(df, "text", "k").collect()}
    assert found == {"a": (2, [1], 0), "b": (1, [2], 0), " ": (1, [2], 1), "c": (1, None, 0)}
    assert bpe.word_freq(df.where("false"), "text", "k").count() == 0
    ids = {r["token"]: r["id"] for r in bpe.alphabet(bpe.word_freq(df, "text", "k")).collect()}
    assert ids == {"c": 3, "a": 4, "b": 5, " ": 6}
    assert bpe.alphabet(bpe.word_freq(df.where("text is null"), "text", "k")).count() == 0


def test_encoding_takes_bounded_lots(spark, monkeypatch):
    model = bpe.BpeModel(["[PAD]", "[UNK]", "[EOS]", "a", "b", " ", "ab", "abab"], [("a", "b"), ("ab", "ab")])
    texts = ["abab ab", None, "", "z abab", "b" * 100, " ", "ab,ab"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    ids = {t: i for i, t in enumerate(model.tokens)}
    want = {"abab ab": [7, 5, 6], "z abab": [1, 5, 7], "b" * 100: [4] * 100, "ab,ab": [6, 1, 6]}
    for most in (bpe.LOT_BYTES, 3):
        monkeypatch.setattr(bpe, "LOT_BYTES", most)
        for eos in ([], [ids["[EOS]"]]):
            got = {r["k"]: r["ids"] for r in bpe.encode(df, "text", "k", model, add_eos=bool(eos)).collect()}
            assert got == {k: want.get(t, []) + eos for k, t in enumerate(texts)}


def test_words_of_an_arrow_column_are_those_of_the_pattern(spark):
    import random

    import pyarrow as pa

    from stepwise.functions import text as tx
    rng = random.Random(3)
    alphabet = list(tx.PUNCT_CHARS + tx.WHITESPACE) + ["a", "é", "😀", "@", "\u0086", "\u00a1", "\u2010", "\u200b", "\u3001", "\u0000", "中", "߿"] * 6
    texts = [None, "", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    rows = df.select("k", tx.pre_tokenize("text").alias("w"), tx.normalize_text("text").alias("t")).orderBy("k").collect()
    for part in (pa.array(texts), pa.array(["x y", *texts]).slice(1)):
        assert tx.word_lists(part).to_pylist() == [r["w"] or [] for r in rows]
    assert [r["t"] for r in rows] == [t and t.strip() for t in texts]
    assert tx.word_lists(pa.array([], pa.string())).to_pylist() == []


def test_embedding_sends_the_rows_that_occur(spark):
    from pyspark.sql import functions as F

    from stepwise.operators import vectors

    table = spark.range(2000).select("id", F.array_repeat(F.col("id") / 2, 16).alias("v"))
    enc = spark.range(40).select("id", F.array(F.col("id") % 3, F.lit(7)).cast("array<int>").alias("ids"))
    out = vectors.embed_tokens(enc, "ids", "id", table, "id", "v", max_broadcast_bytes=20_000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "Union" not in plan
    got = {(r["id"], r["pos"]): (r["token_id"], r["vector"]) for r in out.collect()}
    assert got == {(i, p): (t, [t / 2] * 16) for i in range(40) for p, t in enumerate((i % 3, 7))}
