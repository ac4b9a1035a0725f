"""Training of a grid against plain NumPy, one run at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwise.operators import grid_train as gt
from stepwise.operators.rank import epoch_shuffle

GRID = [(1, 8, 1, "sgd", 0.1), (2, 8, 1, "adam", 0.01), (3, 5, 2, "adam", 0.02), (4, 6, 0, "sgd", 0.05), (5, 8, 1, "sgd", 0.5)]


@pytest.fixture(scope="module")
def samples(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(90):
        y = i % 3
        rows.append((i, [float(v) for v in rnd.normal(y, 1.0, 4)], y, "val" if i % 5 == 0 else "train"))
    rows += [(200, None, 1, "train"), (201, [1.0, 2.0], 1, "train"), (202, [1.0, None, 0.0, 0.0], 1, "val"), (203, [float("nan")] * 4, 0, "train"), (204, [1.0] * 4, None, "train"), (205, [1.0] * 4, 1, "test")]
    return spark.createDataFrame(rows, "id long, x array<double>, y int, split string")


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame(GRID, "run_id long, width int, depth int, optimizer string, learning_rate double")


def one_run(run, batches, val, steps, val_interval, per_epoch, seed=42):
    """Plain training, gradients by hand for each sample."""
    run_id, width, depth, optimizer, rate = run
    layers = gt.shapes(width, depth, 4, 3)
    flat = gt.first_weights(run_id, layers, seed)

    def parts(f):
        out, at = [], 0
        for i, o in layers:
            out.append((f[at:at + i * o].reshape(i, o), f[at + i * o:at + i * o + o]))
            at += i * o + o
        return out

    def forward(f, x):
        hs = [x]
        ps = parts(f)
        for k, (w, b) in enumerate(ps):
            h = hs[-1] @ w + b
            hs.append(np.maximum(h, 0) if 0 < k < len(ps) - 1 else h)
        z = hs[-1]
        p = np.exp(z - z.max())
        return hs, p / p.sum()

    def evaluate(f, rows):
        ps = [(forward(f, x)[1], y) for x, y in rows]
        return np.mean([-np.log(p[y]) for p, y in ps]), sum(int(p.argmax() == y) for p, y in ps)

    m, v, log = 0.0, 0.0, []
    for step in range(1, steps + 1):
        rows = batches(step)
        loss, right = evaluate(flat, rows)
        log.append((run_id, "train", (step - 1) // per_epoch, step, loss, len(rows), right))
        g = np.zeros_like(flat)
        for x, y in rows:
            hs, p = forward(flat, x)
            d = p.copy()
            d[y] -= 1
            gs, ps = [], parts(flat)
            for k in reversed(range(len(ps))):
                gs.append(np.concatenate([np.outer(hs[k], d).ravel(), d]))
                if k:
                    d = ps[k][0] @ d
                    if k > 1:
                        d = d * (hs[k] > 0)
            g += np.concatenate(gs[::-1])
        g /= len(rows)
        if optimizer == "sgd":
            flat = flat - rate * g
        else:
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        if step % val_interval == 0:
            loss, right = evaluate(flat, val)
            log.append((run_id, "val", (step - 1) // per_epoch, step, loss, len(val), right))
    return log


def same_log(got, want):
    got = sorted((r["run_id"], r["split"], r["epoch"], r["step"], r["loss"], r["n_samples"], r["n_correct"]) for r in got.collect())
    want = sorted(want)
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-6, atol=1e-9)


def rows_where(samples, cond):
    return [(np.array(r["x"]), r["y"]) for r in samples.where(cond).where("id < 100").collect()]


@pytest.mark.parametrize("bound", [None, 150])
def test_whole_batches_equal_numpy(spark, samples, grid, monkeypatch, bound):
    if bound:  # several blocks of runs, small pieces, few rows at once, two levels of sums
        monkeypatch.setattr(gt, "MAX_WEIGHTS", bound)
        monkeypatch.setattr(gt, "FAN_IN", 2)
        monkeypatch.setattr(gt, "PIECE", 16)
        monkeypatch.setattr(gt, "ACTIVATIONS", 100)
    train, val = rows_where(samples, "split = 'train'"), rows_where(samples, "split = 'val'")
    got = gt.train_grid(samples.repartition(5), grid, "id", "x", "y", 4, 3, epochs=7, val_interval=3)
    want = [row for run in GRID for row in one_run(run, lambda s: train, val, 7, 3, 1)]
    same_log(got, want)


def test_mini_batches_equal_numpy(spark, samples, grid):
    val = rows_where(samples, "split = 'val'")
    dealt = epoch_shuffle(samples.where("split = 'train' and id < 100"), "id", 2, 42).collect()
    per_epoch = -(-72 // 20)

    def batch(step):
        e, b = divmod(step - 1, per_epoch)
        return [(np.array(r["x"]), r["y"]) for r in dealt if r["epoch"] == e and r["position"] // 20 == b]

    got = gt.train_grid(samples, grid, "id", "x", "y", 4, 3, epochs=2, batch_size=20, val_interval=4)
    want = [row for run in GRID for row in one_run(run, batch, val, 2 * per_epoch, 4, per_epoch)]
    same_log(got, want)
    assert {r["n_samples"] for r in got.where("split = 'train'").collect()} == {20, 12}


def test_training_learns_and_refuses_odd_input(spark, samples, grid):
    log = gt.train_grid(samples, grid.where("run_id = 2"), "id", "x", "y", 4, 3, epochs=30, val_interval=30)
    steps = {r["step"]: r for r in log.where("split = 'train'").collect()}
    assert steps[30]["loss"] < 0.8 * steps[1]["loss"]
    with pytest.raises(ValueError, match="optimizer"):
        gt.train_grid(samples, grid.withColumn("optimizer", F.lit("rms")), "id", "x", "y", 4, 3, epochs=1)
    with pytest.raises(Exception, match="no such class"):
        gt.train_grid(samples, grid, "id", "x", "y", 4, 2, epochs=1)
    nothing = gt.train_grid(samples.limit(0), grid, "id", "x", "y", 4, 3, epochs=1)
    assert {(r["loss"], r["n_samples"]) for r in nothing.collect()} == {(None, 0)}


def test_gradients_are_small_differences():
    rnd = np.random.default_rng(3)
    layers = gt.shapes(5, 2, 4, 3)
    flat = np.stack([gt.first_weights(i, layers, 1) for i in range(3)])
    x, y = rnd.normal(size=(6, 4)), rnd.integers(0, 3, 6)
    _, _, grad = gt.losses(flat, layers, x, y, True)
    for k in rnd.integers(0, flat.shape[1], 20):
        up, down = flat.copy(), flat.copy()
        up[:, k] += 1e-6
        down[:, k] -= 1e-6
        slope = (gt.losses(up, layers, x, y, False)[0] - gt.losses(down, layers, x, y, False)[0]) / 2e-6
        assert np.allclose(grad[:, k], slope, atol=1e-5)


@pytest.mark.parametrize("rows, interval", [(40, 4), (1 << 14, 3)])
def test_lots_of_steps_take_two_jobs_and_equal_numpy(spark, samples, grid, monkeypatch, rows, interval):
    monkeypatch.setattr(gt, "LOT_ROWS", rows)
    val = rows_where(samples, "split = 'val'")
    dealt = epoch_shuffle(samples.where("split = 'train' and id < 100"), "id", 3, 42).collect()
    made = []
    added = gt._added
    monkeypatch.setattr(gt, "_added", lambda *a: made.append(1) or added(*a))

    def batch(step):
        e, b = divmod(step - 1, 4)
        return [(np.array(r["x"]), r["y"]) for r in dealt if r["epoch"] == e and r["position"] // 20 == b]

    got = gt.train_grid(samples, grid, "id", "x", "y", 4, 3, epochs=3, batch_size=20, val_interval=interval)
    same_log(got, [row for run in GRID for row in one_run(run, batch, val, 12, interval, 4)])
    # one pass over the held-out rows for each lot that has validations, where it was a job for each of 12 steps
    assert len(made) == (3 if rows == 40 else 1)


def test_mini_batches_without_rows(spark, samples, grid):
    got = gt.train_grid(samples.where("split = 'val'"), grid, "id", "x", "y", 4, 3, epochs=2, batch_size=20, val_interval=1)
    assert {(r["split"], r["step"], r["n_samples"]) for r in got.collect()} == {("train", 1, 0), ("train", 2, 0), ("val", 1, 18), ("val", 2, 18)}
    nothing = gt.train_grid(samples.limit(0), grid, "id", "x", "y", 4, 3, epochs=1, batch_size=20)
    assert {(r["loss"], r["n_samples"]) for r in nothing.collect()} == {(None, 0)}
