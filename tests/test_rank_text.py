import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stepwise.functions import text as tx
from stepwise.operators import rank as rk

PY_DELIMS = r'([,\.\'"!#$%^&*(){}\[\];:<>/?\\|`~\-_=+\s])'


def test_hash_rank_equals_sort(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 3)
    ranked = rk.hash_rank(df, F.concat(F.lit("42:"), F.col("id").cast("string")), out="r").collect()
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), f"42:{i}"))
    assert {r["id"]: r["r"] for r in ranked} == {i: p for p, i in enumerate(order)}


def test_ordered_rank_with_hot_key(spark):
    rows = [(0 if i % 3 else i, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, tie long")
    got = {(r["k"], r["tie"]): r["r"] for r in rk.ordered_rank(df, ["k", "tie"], out="r").collect()}
    assert got == {kt: p for p, kt in enumerate(sorted(rows))}


def test_split_sizes():
    assert rk.split_sizes(10, [0.5, 0.3]) == [5, 3, 2]
    assert sum(rk.split_sizes(1001, [0.7, 0.2])) == 1001
    assert rk.split_sizes(7, [1.0]) == [7, 0]
    with pytest.raises(ValueError):
        rk.split_sizes(10, [1.0, 1.0])


def test_random_split_exact(spark):
    df = spark.range(997).withColumnRenamed("id", "vid")
    parts = {r["split"]: r["n"] for r in rk.random_split(df, "vid", [0.8, 0.1], ["train", "val"])
             .groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert parts == dict(zip(["train", "val"], rk.split_sizes(997, [0.8, 0.1])[:2]))


def _py_words(t):
    return [w for w in re.split(PY_DELIMS, t.strip()) if w]


def test_pre_tokenize_matches_python(spark):
    rng = random.Random(1)
    alphabet = list("ab @é😀,.'\"!-_=+\t\n") + [" ", "\u001c", " ", "　", "\\", "|", "[", "]"]
    texts = ["", "   ", " x\u001c", "a@b c", "banana aaaa"] + \
        ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r["i"]: r["w"] for r in df.select("i", tx.pre_tokenize(tx.normalize_text("t")).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _py_words(t), repr(t)


def test_collate_orders_rows_keeps_nulls_and_a_null_batch(spark):
    df = spark.createDataFrame([(0, 1, "b"), (0, 0, None), (None, 5, "z")], "batch int, position int, v string")
    got = {r["batch"]: (r["n_rows"], r["v"]) for r in rk.collate(df, "batch", "position", "v").collect()}
    assert got == {0: (2, [None, "b"]), None: (1, ["z"])}


def test_epoch_shuffle_counts_from_zero(spark):
    out = rk.epoch_shuffle(spark.range(5), "id", 2).collect()
    assert sorted((r["epoch"], r["position"]) for r in out) == [(e, p) for e in (0, 1) for p in range(5)]
