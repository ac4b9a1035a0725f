"""Null keys, ids and losses lose no rows."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepwise.operators import bpe
from stepwise.operators import rank as rk
from stepwise.operators import vectors as vec
from stepwise.operators.logs import count_window_summary
from stepwise.operators.smooth import smooth_and_mask
from stepwise.streaming.summary import make_summariser


@pytest.fixture(scope="module")
def two_runs(spark):
    rows = [(r, s, "train", 1, 1.0 + s / 100) for r in ("a", None) for s in range(1, 101)]
    return spark.createDataFrame(rows, "run_id string, step long, split string, epoch int, loss double").withColumn("time", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def _key(rows, cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in rows)


def test_summary_keeps_null_runs_on_both_paths(two_runs):
    plain = count_window_summary(two_runs, flush_interval=20, aggregation_interval=7).collect()
    safe = count_window_summary(two_runs, flush_interval=20, aggregation_interval=7, skew_safe=True).collect()
    assert sum(r["n_steps"] for r in plain) == sum(r["n_steps"] for r in safe) == 200
    cols = ["run_id", "n_steps", "step", "loss_mean"]
    assert _key(plain, cols) == _key(safe, cols)


def test_smoothing_keeps_null_runs_on_both_paths(two_runs):
    plain = smooth_and_mask(two_runs, "run_id", ["loss"]).count()
    safe = smooth_and_mask(two_runs, "run_id", ["loss"], skew_safe=True).count()
    assert plain == safe == 200


def test_split_and_batches_keep_null_ids_and_groups(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    parts = rk.random_split(df, "k", [0.5, 0.2], keep_remainder=True)
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"part0": 50, "part1": 20, "remainder": 30}
    grouped = df.withColumn("g", F.when(F.col("v") < 50, F.lit("x")))
    batches = rk.make_batches(grouped, "v", 10, group="g").groupBy("g", "batch").count().collect()
    assert len(batches) == 10 and all(r["count"] == 10 for r in batches)


def test_missing_embedding_raises(spark):
    enc = spark.createDataFrame([(1, [0, 7])], "k int, ids array<int>")
    table = spark.createDataFrame([(0, [1.0])], "i int, v array<double>")
    with pytest.raises(Exception, match="without an embedding: 7"):
        vec.embed_tokens(enc, "ids", "k", table, "i", "v").collect()


def test_encode_keeps_rows_with_equal_keys_and_long_words(spark):
    model = bpe.BpeModel([*bpe.SPECIALS, "a", "b", "ab", "abab"], [("a", "b"), ("ab", "ab")])
    df = spark.createDataFrame([(1, "ab"), (1, "aba"), (2, "")], "k int, t string")
    got = sorted((r["k"], r["ids"]) for r in bpe.encode(df, "t", "k", model).collect())
    assert got == [(1, [5, 2]), (1, [5, 3, 2]), (2, [2])]
    assert "Exchange hashpartitioning" not in bpe.encode(df, "t", "k", model)._jdf.queryExecution().toString()
    assert bpe.bpe_word("ab" * 50_000, model.ranks) == ["abab"] * 25_000


def _slow(word, ranks):
    toks = list(word)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(toks, toks[1:])) if p in ranks]:
        _, i = min(pairs)
        toks[i:i + 2] = [toks[i] + toks[i + 1]]
    return toks


def test_heap_encoding_equals_plain_search():
    import random
    rnd = random.Random(5)
    for _ in range(300):
        merges, have = [], list("abc")
        for _ in range(rnd.randint(0, 12)):
            p = (rnd.choice(have), rnd.choice(have))
            if p not in merges:
                merges.append(p)
                have.append(p[0] + p[1])
        ranks = {m: i for i, m in enumerate(merges)}
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40)))
        assert bpe.bpe_word(word, ranks) == _slow(word, ranks)


class _State:
    exists = hasTimedOut = False

    def update(self, v):
        pass

    def remove(self):
        pass


@pytest.mark.parametrize("loss,null,mean,perplexity", [(math.nan, False, math.nan, math.nan), (1000.0, False, 1000.0, math.inf), (math.nan, True, None, None)])
def test_stream_counts_nan_null_and_large_losses_like_the_batch(loss, null, mean, perplexity):
    rows = pd.DataFrame([{"run_id": "r", "split": "train", "epoch": 1, "step": 1, "time": pd.Timestamp("2024-01-01"), "loss": loss, "end_of_run": None, "loss_null": null}])
    out = pd.concat(make_summariser(0, 1)(("r",), [rows], _State())).iloc[0]
    for got, want in ((out["loss_mean"], mean), (out["perplexity"], perplexity)):
        assert (got is None or math.isnan(got)) if want is None or math.isnan(want) else got == want
