import math
import random

import numpy as np
from pyspark.sql import functions as F

from stepwise.operators import analysis as an
from stepwise.operators import logs, smooth


def _simulate(records, flush, agg):
    """Literal re-enactment of the buffered logger: flush at F records, on split change, at end."""
    out, buf = [], []

    def flush_buf():
        for i in range(0, len(buf), agg):
            chunk = buf[i:i + agg]
            losses = [r["loss"] for r in chunk]
            mean = sum(losses) / len(losses)
            std = (math.sqrt(sum((x - mean) ** 2 for x in losses) / (len(losses) - 1))
                   if len(losses) > 1 else None)
            out.append((chunk[-1]["run_id"], len(chunk), chunk[-1]["step"], chunk[-1]["split"], mean, std))
        buf.clear()

    for run in sorted({r["run_id"] for r in records}):
        prev = None
        for r in sorted((x for x in records if x["run_id"] == run), key=lambda x: x["step"]):
            if prev is not None and r["split"] != prev:
                flush_buf()
            buf.append(r)
            prev = r["split"]
            if flush and len(buf) >= flush:
                flush_buf()
        flush_buf()
    return out


def test_count_window_summary_equals_buffer_simulation(spark):
    rng = random.Random(3)
    recs = []
    for run in range(6):
        split = "train"
        for step in range(1, rng.randint(1, 60) + 1):
            if rng.random() < 0.15:
                split = "val" if split == "train" else "train"
            recs.append({"run_id": f"r{run}", "step": step, "split": split, "loss": rng.random() * 3,
                         "epoch": 1, "time": None})
    df = spark.createDataFrame([(r["run_id"], r["split"], r["epoch"], r["step"], r["loss"]) for r in recs],
                               "run_id string, split string, epoch int, step bigint, loss double")
    for flush, agg in [(20, 7), (10, 3), (0, 4), (5, 1), (7, 7)]:
        got = sorted((r["run_id"], r["n_steps"], r["step"], r["split"], round(r["loss_mean"], 9),
                      None if r["loss_std"] is None else round(r["loss_std"], 9))
                     for r in logs.count_window_summary(df, flush_interval=flush, aggregation_interval=agg).collect())
        exp = sorted((a, b, c, d, round(e, 9), None if f is None else round(f, 9))
                     for a, b, c, d, e, f in _simulate(recs, flush, agg))
        assert got == exp, (flush, agg)


def _poly_smooth(y, window=51, degree=3):
    n, h = len(y), window // 2
    out = []
    for i in range(n):
        s = min(max(0, i - h), n - window)
        x = np.arange(window)
        coef = np.polyfit(x, y[s:s + window], degree)
        out.append(np.polyval(coef, i - s))
    return out


def test_savgol_matches_polynomial_fit_and_run_lengths(spark):
    rng = np.random.default_rng(0)
    rows = []
    for run, n in [("a", 50), ("b", 51), ("c", 52), ("d", 80)]:
        ys = rng.normal(size=n)
        rows += [(run, i + 1, float(v)) for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "run_id string, step bigint, loss double")
    got = {(r["run_id"], r["step"]): r["smoothed_loss"]
           for r in smooth.savgol_smooth(df, ["run_id"], "step", ["loss"]).collect()}
    for run in "abcd":
        ys = [v for (k, _, v) in rows if k == run]
        if len(ys) < 51:
            assert all(got[(run, i + 1)] is None for i in range(len(ys)))
            continue
        exp = _poly_smooth(np.array(ys))
        assert max(abs(got[(run, i + 1)] - e) for i, e in enumerate(exp)) < 1e-9


def test_savgol_reproduces_cubic_and_null_block(spark):
    xs = list(range(1, 61))
    rows = [("c", x, 0.5 * x ** 3 - 2 * x + 1.0) for x in xs] + \
           [("n", x, None if x == 40 else float(x)) for x in xs]
    df = spark.createDataFrame(rows, "run_id string, step bigint, loss double")
    got = {(r["run_id"], r["step"]): r["smoothed_loss"]
           for r in smooth.savgol_smooth(df, ["run_id"], "step", ["loss"]).collect()}
    assert max(abs(got[("c", x)] - (0.5 * x ** 3 - 2 * x + 1.0)) / max(1.0, abs(0.5 * x ** 3)) for x in xs) < 1e-9
    assert got[("n", 40)] is None and got[("n", 10)] is None


def test_mask_outside_edges(spark):
    rows = [("a", s, float(s)) for s in range(0, 100, 10)]
    df = spark.createDataFrame(rows, "run_id string, step bigint, v double")
    kept = sorted(r["step"] for r in smooth.mask_outside(df, ["v"], "run_id").collect() if r["v"] is not None)
    assert kept == [30, 40, 50, 60]


def test_best_per_run_nulls_nan_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.2), ("a", 3, 0.2), ("a", 4, float("nan")),
                                ("b", 1, None), ("c", 1, 0.9), ("c", 2, 0.95)],
                               "run_id string, step bigint, loss double")
    acc = df.withColumnRenamed("loss", "acc")
    got = {r["run_id"]: (r["best_loss_step"], r["best_loss"])
           for r in an.best_per_run(df, "run_id", "step", {"loss": "lower"}).collect()}
    assert got == {"a": (2, 0.2), "b": (None, None), "c": (1, 0.9)}
    hi = {r["run_id"]: r["best_acc_step"] for r in an.best_per_run(acc, "run_id", "step", {"acc": "higher"}).collect()}
    assert hi == {"a": 1, "b": None, "c": 2}


def test_null_semantics(spark):
    df = spark.createDataFrame([(None, "x"), (0.7, "y"), (0.7, "x"), (0.1, None)], "lr double, exp string")
    cond = an.pd_cmp("lr", ">=", 0.5) & an.pd_cmp("exp", "!=", "x")
    kept = sorted((r["lr"] if r["lr"] is not None else -1, r["exp"] or "") for r in an.filter_not(df, cond).collect())
    assert kept == [(-1, "x"), (0.1, ""), (0.7, "x")]
    logs_df = spark.createDataFrame([(None, 1), ("1", 2)], "run_id string, step int")
    cfg = spark.createDataFrame([(None, "n"), ("1", "o")], "id string, name string")
    assert an.join_logs_configs(logs_df, cfg).count() == 2
    counts = an.distinct_count(spark.createDataFrame([(None,), ("a",)], "o string"), "o", count_null=True).first()
    assert counts["n_o"] == 2


def test_pandas_metric_fallback_matches_builtin(spark):
    rows = [("r", "train", 1, s, float(s % 5)) for s in range(1, 30)]
    df = spark.createDataFrame(rows, "run_id string, split string, epoch int, step bigint, loss double")
    pm = logs.PandasMetric("loss_max", lambda p: {"loss_max": float(p["loss"].max()),
                                                  "last_loss": float(p["loss"].iloc[-1])},
                           "loss_max double, last_loss double", ["step", "loss"])
    out = logs.count_window_summary(df, flush_interval=10, aggregation_interval=4, metrics=("loss", pm)).collect()
    exp = {r["step"]: r for r in out}
    assert len(out) == 9
    for r in out:
        chunk = [float(s % 5) for s in range(1, 30) if s <= r["step"] and s > r["step"] - r["n_steps"]]
        assert r["loss_max"] == max(chunk) and r["last_loss"] == chunk[-1]


def _skewed_log(spark):
    rng = random.Random(11)
    rows = []
    for run, n in [("hot", 1500), ("a", 50), ("b", 51), ("c", 52), ("d", 130)]:
        split = "train"
        for step in range(1, n + 1):
            if rng.random() < 0.05:
                split = "val" if split == "train" else "train"
            rows.append((run, split, 1, step * 10, rng.random() * 3))
    return spark.createDataFrame(rows, "run_id string, split string, epoch int, step bigint, loss double")


def test_skew_safe_summary_equals_default(spark):
    df = _skewed_log(spark)
    for flush, agg in [(20, 7), (0, 5), (100, 10)]:
        a = sorted(tuple(r) for r in logs.count_window_summary(df, flush_interval=flush,
                                                               aggregation_interval=agg).collect())
        b = sorted(tuple(r) for r in logs.count_window_summary(df, flush_interval=flush, aggregation_interval=agg,
                                                               skew_safe=True).collect())
        assert [x[:6] for x in a] == [x[:6] for x in b]
        for x, y in zip(a, b):
            for i in (6, 7):
                assert (x[i] is None and y[i] is None) or abs(x[i] - y[i]) < 1e-9


def test_skew_safe_smoothing_equals_default(spark):
    df = _skewed_log(spark)
    a = {(r["run_id"], r["step"]): r["smoothed_loss"]
         for r in smooth.smooth_and_mask(df, ["run_id"], ["loss"]).collect()}
    b = {(r["run_id"], r["step"]): r["smoothed_loss"]
         for r in smooth.mask_outside_agg(
             smooth.savgol_smooth_skew_safe(df, ["run_id"], "step", ["loss"], bucket_rows=64),
             ["smoothed_loss"], ["run_id"]).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or abs(a[k] - b[k]) < 1e-9, k


def test_vector_edge_cases_do_not_raise(spark):
    from stepwise.functions import arrays as ar
    df = spark.createDataFrame([(1, [2.0]), (2, []), (3, [1.0, 1.0]), (4, [1.0, 3.0])], "k int, v array<double>")
    got = {r["k"]: r["n"] for r in df.select("k", ar.layer_norm("v").alias("n")).collect()}
    assert got[1] is None and got[2] is None and got[3] is None
    assert [round(x, 9) for x in got[4]] == [round(-1 / 2 ** 0.5, 9), round(1 / 2 ** 0.5, 9)]


def test_smoothing_of_a_long_run_equals_the_hat_matrix_and_collects_nothing(spark, capsys):
    import numpy as np
    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("run_id"), F.col("id").alias("step"), (F.sin(F.col("id") / 50) * 100 + F.hash("id") / 1e10).alias("loss"),
                               F.when(F.col("id") == 40_000, F.lit(float("nan"))).when(F.col("id") != 20_000, F.col("id") % 7.0).alias("odd"))
    y = np.array([r["loss"] for r in df.orderBy("step").collect()])
    v = np.vander(np.arange(-25, 26.0), 4, increasing=True)
    hat = v @ np.linalg.pinv(v)
    want = np.convolve(y, hat[25][::-1], mode="same")
    want[:25], want[-25:] = hat[:25] @ y[:51], hat[26:] @ y[-51:]
    for out in (smooth.savgol_smooth(df, "run_id", "step", ["loss", "odd"]), smooth.savgol_smooth_skew_safe(df, "run_id", "step", ["loss", "odd"])):
        rows = out.orderBy("step").collect()
        assert np.abs(np.array([r["smoothed_loss"] for r in rows]) - want).max() < 1e-9
        assert [r["step"] for r in rows if r["smoothed_odd"] is None] == list(range(19_975, 20_026))
        assert [r["step"] for r in rows if r["smoothed_odd"] is not None and r["smoothed_odd"] != r["smoothed_odd"]] == list(range(39_975, 40_026))
        out.explain()
        assert "collect_list" not in capsys.readouterr().out
    cubic = spark.range(300).select(F.lit("a").alias("run_id"), F.col("id").alias("step"), (F.pow(F.col("id") - 100.0, F.lit(3)) / 1e4 - F.col("id")).alias("loss"))
    assert all(abs(r["smoothed_loss"] - r["loss"]) < 1e-7 for r in smooth.savgol_smooth(cubic, "run_id", "step", ["loss"]).collect())
    fifth = smooth.savgol_smooth(cubic, "run_id", "step", ["loss"], window=7, degree=2).orderBy("step").collect()
    w = np.vander(np.arange(-3, 4.0), 3, increasing=True)
    z = np.array([r["loss"] for r in fifth])
    assert abs(fifth[150]["smoothed_loss"] - (w @ np.linalg.pinv(w))[3] @ z[147:154]) < 1e-9


def test_runs_are_measured_and_split_if_long(spark, monkeypatch, capsys):
    from stepwise.operators import common
    df = spark.range(400).select((F.col("id") % 2).cast("string").alias("run_id"), F.lit("train").alias("split"), F.lit(1).alias("epoch"), F.col("id").alias("step"),
                                 F.lit(None).cast("timestamp").alias("time"), (F.col("id") * 0.5).alias("loss"))
    plain = [logs.count_window_summary(df, flush_interval=20, aggregation_interval=7), smooth.smooth_and_mask(df, "run_id", ["loss"])]
    assert not common.splits_runs(df, "run_id", None) and common.splits_runs(df, "run_id", True)
    monkeypatch.setattr(common, "HOT_RUN_ROWS", 100)
    assert common.splits_runs(df, "run_id", None) and not common.splits_runs(df, "run_id", False)
    split = [logs.count_window_summary(df, flush_interval=20, aggregation_interval=7), smooth.smooth_and_mask(df, "run_id", ["loss"])]
    for a, b in zip(plain, split):
        b.explain()
        assert "__pid" in capsys.readouterr().out
        rnd = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rows)
        assert rnd(a.select(sorted(a.columns)).collect()) == rnd(b.select(sorted(b.columns)).collect())
