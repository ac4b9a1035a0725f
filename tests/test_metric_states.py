"""Mergeable metrics in batch, on split runs and in streams; streams out of order, killed and restarted."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepwise.operators import logs, metrics
from stepwise.plans import catalog  # registers loss_extent
from stepwise.session import scratch_path
from stepwise.streaming import ordered

SCHEMA = "run_id string, split string, epoch int, step bigint, time timestamp, loss double, end_of_run boolean"
COLUMNS = catalog.SUMMARY_ROWS + ", loss_mean double, loss_std double, loss_min double, loss_max double, loss_size double"


def log_rows(runs=4, steps=120, seed=1):
    rnd = random.Random(seed)
    rows = []
    for r in range(runs):
        split = "train"
        for s in range(1, steps + rnd.randint(0, 9)):
            split = rnd.choice(["train", "val"]) if rnd.random() < 0.2 else split
            loss = rnd.choice([None, float("nan"), float("inf")]) if rnd.random() < 0.02 else rnd.gauss(2, 1)
            rows.append((f"r{r}" if r else None, split, None if s % 50 == 0 else s // 40, s, datetime(2024, 1, 1) + timedelta(minutes=s, seconds=r), loss, None))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(log_rows(), SCHEMA)


@pytest.fixture(params=[3, 10_000])
def batch_rows(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def frame(df):
    pdf = df.toPandas()
    return pdf.sort_values(["run_id", "step", "split"], na_position="first").reset_index(drop=True)


def same(a, b):
    a, b = frame(a), frame(b)
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False, rtol=1e-9)
    assert len(a)


@pytest.mark.parametrize("skew_safe", [False, True])
def test_states_give_what_native_aggregates_give(log, batch_rows, skew_safe):
    native = logs.count_window_summary(log, flush_interval=20, aggregation_interval=7, metrics=("loss", "perplexity"))
    states = [logs.state_metric(m) for m in ("loss", "perplexity")]
    same(native, logs.count_window_summary(log, flush_interval=20, aggregation_interval=7, metrics=states, skew_safe=skew_safe))
    same(logs.count_window_summary(log, flush_interval=0, aggregation_interval=1000, metrics=("loss",)),
         logs.count_window_summary(log, flush_interval=0, aggregation_interval=1000, metrics=states[:1], skew_safe=skew_safe))


def test_accuracy_state_gives_what_the_native_one_gives(spark, batch_rows):
    rnd = random.Random(2)
    rows = [("a", "train", 1, s, datetime(2024, 1, 1), 0.5, [[rnd.random() for _ in range(3)] for _ in range(s % 4)] if s % 9 else None, [rnd.randint(0, 2) for _ in range(s % 4)] if s % 9 else None)
            for s in range(60)]
    df = spark.createDataFrame(rows, "run_id string, split string, epoch int, step bigint, time timestamp, loss double, logits array<array<double>>, labels array<int>")
    same(logs.count_window_summary(df, flush_interval=10, aggregation_interval=4, metrics=("accuracy",)),
         logs.count_window_summary(df, flush_interval=10, aggregation_interval=4, metrics=(logs.state_metric("accuracy"),)))


def test_python_metric_sees_whole_chunks_in_order(log, batch_rows):
    def fn(rows):
        assert list(rows.index) == list(range(len(rows)))
        return {"steps": ",".join(map(str, rows["step"])), "top": None if rows["loss"].isna().all() else float(np.nanmax(rows["loss"]))}

    m = logs.PandasMetric("steps", fn, "steps string, top double", ["step", "loss"])
    got = frame(logs.count_window_summary(log, flush_interval=20, aggregation_interval=7, metrics=("loss", m)))
    split = frame(logs.count_window_summary(log, flush_interval=20, aggregation_interval=7, metrics=("loss", m), skew_safe=True))
    pd.testing.assert_frame_equal(got, split[got.columns])
    for steps, n, last in zip(got["steps"], got["n_steps"], got["step"]):
        steps = list(map(int, steps.split(",")))
        assert steps == list(range(last - n + 1, last + 1))


def test_a_metric_of_a_user_runs_in_batch_split_runs_and_streams(spark, log):
    want = logs.count_window_summary(log, flush_interval=20, aggregation_interval=7, metrics=("loss", "loss_extent"))
    same(want, logs.count_window_summary(log, flush_interval=20, aggregation_interval=7, metrics=("loss", "loss_extent"), skew_safe=True))
    base, out = scratch_path(spark, "t-in"), scratch_path(spark, "t-out")
    write(spark, base, log.orderBy("step").collect(), 3)
    write(spark, base, ends(log), 1)
    closed = summary(spark, base, 0.0)
    ordered.append_batches(closed, out, out + "-chk").awaitTermination()
    rows = ordered.read_batches(spark, out, COLUMNS)
    assert rows.where("kind = 'rejected'").count() == 0
    same(want, rows.drop("kind"))


def write(spark, path, rows, files):
    """Files in the order of the rows, oldest first."""
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame([tuple(r) for r in rows[i:i + size]], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def ends(log):
    return [(r["run_id"], None, None, r["s"] + 1, None, None, True) for r in log.groupBy("run_id").agg(F.max("step").alias("s")).collect()]


def summary(spark, base, delay, idle_ms=None, files=1):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(base)
    return ordered.stream_ordered_summary(stream, 20, 7, ("loss", "loss_extent"), delay=delay, idle_ms=idle_ms)


def test_records_out_of_order_within_the_delay_give_the_batch_rows(spark, log):
    rnd = random.Random(3)
    rows = sorted(log.collect(), key=lambda r: r["step"] + rnd.uniform(0, 25))  # up to 25 minutes late
    base, out = scratch_path(spark, "t-in"), scratch_path(spark, "t-out")
    write(spark, base, rows, 6)
    write(spark, base, ends(log), 1)
    ordered.append_batches(summary(spark, base, 25 * 60.0), out, out + "-chk").awaitTermination()
    got = ordered.read_batches(spark, out, COLUMNS)
    same(logs.count_window_summary(log, flush_interval=20, aggregation_interval=7, metrics=("loss", "loss_extent")), got.where("kind = 'summary'").drop("kind"))
    assert got.where("kind = 'rejected'").count() == 0


def test_late_records_are_rows_and_in_no_chunk(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(minutes=s)
    rows = [("a", "train", 1, s, at(s), float(s), None) for s in (1, 2, 5, 6, 9)]
    late = [("a", "train", 1, s, at(s), float(s), None) for s in (3, 6, 10)] + [("b", "val", None, 1, None, None, None)]
    base, out = scratch_path(spark, "t-in"), scratch_path(spark, "t-out")
    write(spark, base, rows, 1)
    write(spark, base, late, 1)
    write(spark, base, [("a", None, None, 11, None, None, True), ("b", None, None, 2, None, None, True)], 1)
    write(spark, base, [("a", "train", 1, 12, at(12), 1.0, None)], 1)  # after its run's end
    ordered.append_batches(summary(spark, base, 2 * 60.0), out, out + "-chk").awaitTermination()
    got = ordered.read_batches(spark, out, COLUMNS).collect()
    assert sorted((r["run_id"], r["step"]) for r in got if r["kind"] == "rejected") == [("a", 3), ("a", 6), ("a", 12)]
    assert all(r["loss_mean"] is None and r["loss_min"] is None for r in got if r["kind"] == "rejected")
    a = [r for r in got if r["kind"] == "summary" and r["run_id"] == "a"]
    assert [(r["n_steps"], r["step"], r["loss_mean"], r["loss_max"]) for r in a] == [(6, 10, 33 / 6, 10.0)]
    b = [r for r in got if r["kind"] == "summary" and r["run_id"] == "b"]
    assert [(r["n_steps"], r["step"], r["time"], r["epoch"], r["loss_mean"]) for r in b] == [(1, 1, None, None, None)]


def test_a_killed_stream_leaves_every_row_once(spark, log, monkeypatch):
    base, out = scratch_path(spark, "t-in"), scratch_path(spark, "t-out")
    write(spark, base, log.orderBy("step").collect(), 4)
    write(spark, base, ends(log), 1)
    made, real = [], type(spark).createDataFrame

    def dies(self, rows, *a, **k):
        made.append(rows)
        if len(made) == 3:
            raise RuntimeError("killed between the rows and the manifest")
        return real(self, rows, *a, **k)

    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(Exception, match="killed"):
        ordered.append_batches(summary(spark, base, 0.0), out, out + "-chk").awaitTermination()
    monkeypatch.setattr(type(spark), "createDataFrame", real)
    listed = spark.read.json(f"{out}/manifest/*/*").count()
    written = spark.read.json(f"{out}/rows").select("batch").distinct().count()
    assert written > listed == 2
    partial = ordered.read_batches(spark, out, COLUMNS).count()
    ordered.append_batches(summary(spark, base, 0.0), out, out + "-chk").awaitTermination()
    got = ordered.read_batches(spark, out, COLUMNS)
    assert partial < got.count()
    same(logs.count_window_summary(log, flush_interval=20, aggregation_interval=7, metrics=("loss", "loss_extent")), got.drop("kind"))


def test_idle_runs_are_closed_by_a_timer(spark):
    rows = [("a", "train", 1, s, datetime(2024, 1, 1), 1.0, None) for s in range(1, 4)]
    base, out = scratch_path(spark, "t-in"), scratch_path(spark, "t-out")
    write(spark, base, rows, 1)
    q = (summary(spark, base, 0.0, idle_ms=500).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-chk")
         .trigger(processingTime="500 milliseconds").start())
    try:
        end, got = time.time() + 60, []
        while not got and time.time() < end:
            time.sleep(1)
            got = spark.read.schema(COLUMNS).parquet(out).collect() if q.lastProgress else []
    finally:
        q.stop()
    assert [(r["kind"], r["n_steps"], r["step"]) for r in got] == [("summary", 3, 3)]


def test_a_metric_without_a_state_is_refused_in_streams(spark):
    only = logs.PandasMetric("x", lambda r: {"x": 1.0}, "x double", ["loss"])
    with pytest.raises(ValueError, match="state"):
        ordered.stream_ordered_summary(spark.createDataFrame([], SCHEMA), metrics=(only,))


def test_mean_and_spread_merge_as_one():
    rnd = np.random.default_rng(0)
    x, there = rnd.normal(size=500), rnd.random(500) < 0.8
    whole = metrics.mean_and_spread((x, there), np.array([0]))
    parts = metrics.mean_and_spread((x, there), np.array([0, 3, 4, 200, 333]))
    state = {k: v[:1] for k, v in parts.items()}
    for i in range(1, 5):
        state = metrics.merge_mean_and_spread(state, {k: v[i:i + 1] for k, v in parts.items()})
    assert all(np.allclose(state[k], whole[k]) for k in whole)
    none = metrics.mean_and_spread((x, np.zeros(500, bool)), np.array([0]))
    assert none["n"][0] == 0 and metrics.merge_mean_and_spread(none, whole)["mean"][0] == whole["mean"][0]
