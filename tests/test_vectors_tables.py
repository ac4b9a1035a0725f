"""Dense layers given as tables against the broadcast form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwise.operators import vectors as vec


def as_tables(spark, w, b):
    entries = [(int(i), int(j), float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1]) if w[i, j]]
    return spark.createDataFrame(entries, "i int, j int, w double"), spark.createDataFrame([(j, float(v)) for j, v in enumerate(b) if v], "j int, b double")


@pytest.mark.parametrize("dims, block, grouped", [([7, 5, 4, 3], 4, 2), ([3, 20, 2], 8, 64), ([9, 9, 9, 9, 11], 256, 64)])
def test_blocked_layers_equal_broadcast_ones(spark, capsys, dims, block, grouped):
    rnd = np.random.default_rng(5)
    layers = [(rnd.normal(size=(i, o)) * (rnd.random((i, o)) < 0.7), rnd.normal(size=o) * (rnd.random(o) < 0.5)) for i, o in zip(dims, dims[1:])]
    layers[0][0][:, :1] = 0  # a column without entries
    rows = [(i % 40, [float(x) for x in rnd.normal(size=dims[0])]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, x array<double>").repartition(3)
    want = vec.score_mlp(df, "x", layers, ["k"]).collect()
    scored = vec.score_mlp_tables(df, "x", [as_tables(spark, *layer) for layer in layers], dims, ["k"], block=block, grouped=grouped)
    got = scored.collect()
    key = lambda r: (r["k"], [round(v, 6) for v in r["logits"]])
    want, got = sorted(want, key=key), sorted(got, key=key)
    assert [r["k"] for r in want] == [r["k"] for r in got]
    assert np.allclose([r["logits"] for r in want], [r["logits"] for r in got], atol=1e-9)
    scored.explain()
    assert "BroadcastNestedLoop" not in capsys.readouterr().out


def test_rows_of_another_width_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k long, x array<double>")
    layer = as_tables(spark, np.ones((3, 1)), np.ones(1))
    with pytest.raises(Exception, match="3 features"):
        vec.score_mlp_tables(df, "x", [layer, as_tables(spark, np.ones((1, 1)), np.ones(1))], [3, 1, 1], ["k"]).collect()
    empty = vec.score_mlp_tables(df.where(F.lit(False)), "x", [layer], [3, 1], ["k"])
    assert empty.count() == 0
