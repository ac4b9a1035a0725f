import math
import random
from datetime import datetime

import pandas as pd

from stepwise.operators.logs import count_window_summary
from stepwise.streaming.summary import make_summariser, run_to_table, stream_count_summary


class FakeState:
    """Minimal stand-in for GroupState (exists/get/update/remove/hasTimedOut)."""

    def __init__(self):
        self.value = None
        self.hasTimedOut = False

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        pass


def _simulate(rows, flush, agg):
    out, buf, prev = [], [], None

    def flush_buf():
        for i in range(0, len(buf), agg):
            ch = buf[i:i + agg]
            out.append((len(ch), ch[-1][0], ch[-1][1], round(sum(c[2] for c in ch) / len(ch), 9)))
        buf.clear()

    for step, split, loss in rows:
        if prev is not None and split != prev:
            flush_buf()
        buf.append((step, split, loss))
        prev = split
        if flush and len(buf) >= flush:
            flush_buf()
    flush_buf()
    return out


def _frame(rows, end=False):
    data = [{"run_id": "r", "split": s, "epoch": 1, "step": st, "time": pd.Timestamp("2024-01-01"),
             "loss": lo, "end_of_run": None} for st, s, lo in rows]
    if end:
        data.append({"run_id": "r", "split": None, "epoch": None, "step": 10 ** 9, "time": pd.NaT,
                     "loss": None, "end_of_run": True})
    return pd.DataFrame(data)


def test_state_function_equals_buffer_simulation_across_batches():
    rng = random.Random(2)
    for flush, agg in [(20, 7), (0, 3), (5, 5)]:
        split, rows = "train", []
        for step in range(1, 120):
            if rng.random() < 0.1:
                split = "val" if split == "train" else "train"
            rows.append((step, split, rng.random()))
        fn, state, got = make_summariser(flush, agg), FakeState(), []
        cuts = [0, 17, 18, 60, len(rows)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            last = i == len(cuts) - 2
            # micro-batches arrive unordered inside; the function sorts by step
            batch = _frame(rows[a:b], end=last).sample(frac=1, random_state=i)
            for pdf in fn(("r",), iter([batch]), state):
                got += [(r.n_steps, r.step, r.split, round(r.loss_mean, 9)) for r in pdf.itertuples()]
        assert got == _simulate(rows, flush, agg)
        assert not state.exists


def test_late_record_joins_the_open_chunk_and_std_null_for_single_record():
    fn, state = make_summariser(0, 2), FakeState()
    list(fn(("r",), iter([_frame([(1, "train", 1.0), (2, "train", 3.0), (3, "train", 5.0)])]), state))
    out = pd.concat(list(fn(("r",), iter([_frame([(2, "train", 9.0), (4, "train", 5.0)], end=True)]), state)))
    assert state.value is None
    assert list(out["n_steps"]) == [2, 1] and list(out["loss_mean"]) == [7.0, 5.0] and list(out["step"]) == [3, 4]
    assert out["loss_std"].isna().tolist() == [False, True]
    assert math.isclose(out["perplexity"].iloc[1], math.exp(5.0))


def test_stream_equals_batch_on_null_nan_infinite_and_large_losses(spark, tmp_path):
    """Whatever the losses, labels and splits are, the stream gives the rows of the batch summary."""
    rng = random.Random(11)
    losses = [None, float("nan"), float("inf"), -float("inf"), 31730.5, 1000.0, 0.0]
    schema = ("run_id string, split string, epoch int, step bigint, time timestamp, loss double, "
              "logits array<array<double>>, labels array<int>, end_of_run boolean")
    rows = []
    for run in ("a", "b", "c", None):
        for step in range(60):
            loss = rng.choice(losses) if run in ("b", None) and rng.random() < 0.3 else rng.random()
            labels = None if rng.random() < 0.2 else [rng.randint(0, 1) for _ in range(rng.randint(1, 3))]
            logits = None if labels is None else [[rng.random(), rng.random()] for _ in labels]
            rows.append((run, rng.choice(["train", "train", "val", None]) if run == "c" else "train", step // 20, step,
                         datetime(2024, 1, 1, 0, 0, step), loss, logits, labels, None))
    log = spark.createDataFrame(rows, schema)
    base, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo, hi in ((0, 13), (13, 14), (14, 60)):
        log.where(f"step >= {lo} and step < {hi}").coalesce(1).write.mode("append").parquet(base)
    ends = [(r, None, None, 60, None, None, None, None, True) for r in ("a", "b", "c", None)]
    spark.createDataFrame(ends, schema).write.mode("append").parquet(base)
    metrics = ("loss", "perplexity", "accuracy")
    for flush, size in ((10, 4), (0, 7)):
        stream = spark.readStream.schema(schema).parquet(base)
        to = f"{out}-{flush}"
        run_to_table(stream_count_summary(stream, flush, size, metrics=metrics), to, to + "-chk")
        got = spark.read.parquet(to)
        want = count_window_summary(log.drop("end_of_run"), flush_interval=flush, aggregation_interval=size, metrics=metrics)

        def plain(df):
            return sorted(str([("%.9g" % v if isinstance(v, float) else v) for v in r]) for r in df.select(*want.columns).collect())

        assert plain(got) == plain(want)
