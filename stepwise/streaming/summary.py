"""Streaming log summariser and ingest.

R1 keeps, per run, only the open chunk's running statistics (count, Welford
mean/M2 of the loss, last-record fields) plus the island/position counters —
never raw records — so state stays O(1) per run.  A chunk is emitted as soon
as it closes: when it reaches ``aggregation_interval`` records, when its
flush group reaches ``flush_interval`` records, when the split changes, or
when the run ends (an end-of-run record, or the processing-time timeout).
On the same input it produces the rows of the batch summariser W1.

Rows of one run should arrive in step order across micro-batches; inside a
micro-batch they are sorted by step.  No record is dropped: one whose step was
passed already joins the chunk that is open when it arrives, and is counted in
``state.regressions``.  NaN and infinite losses count as they do in W1; null ones do not.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from stepwise.operators.logs import METRICS
from stepwise.session import ship_package
from stepwise.sources.files import JSON_TIME_FORMAT, STEP_LOG_SCHEMA

STREAM_LOG_SCHEMA = T.StructType(STEP_LOG_SCHEMA.fields + [T.StructField("end_of_run", T.BooleanType())])

#: What the state function emits for a closed chunk.  pandas turns NaN into null on the way back, so flags say which is meant.
SUMMARY_OUT = T.StructType([
    T.StructField("logger_id", T.StringType()),
    T.StructField("n_steps", T.LongType()),
    T.StructField("step", T.LongType()),
    T.StructField("time", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("loss_mean", T.DoubleType()),
    T.StructField("loss_std", T.DoubleType()),
    T.StructField("perplexity", T.DoubleType()),
    T.StructField("nan_mean", T.BooleanType()),
    T.StructField("nan_std", T.BooleanType()),
    T.StructField("__acc_n_sum", T.LongType()),
    T.StructField("__acc_k_sum", T.LongType()),
])

STATE = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("last_step", T.LongType()),
    T.StructField("regressions", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("n_loss", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("m2", T.DoubleType()),
    T.StructField("c_step", T.LongType()),
    T.StructField("c_time", T.StringType()),
    T.StructField("c_epoch", T.IntegerType()),
    T.StructField("labelled", T.LongType()),
    T.StructField("acc_n", T.LongType()),
    T.StructField("acc_k", T.LongType()),
])


def _fmt(ts) -> str | None:
    return None if pd.isna(ts) else pd.Timestamp(ts).strftime("%Y-%m-%d %H:%M:%S.%f")


class Chunk(NamedTuple):
    """Running statistics of a chunk's records; ``mean`` and ``m2`` of the non-null losses."""

    n: int = 0
    n_loss: int = 0
    mean: float = 0.0
    m2: float = 0.0
    step: int | None = None
    time: str | None = None
    epoch: int | None = None
    labelled: int = 0
    acc_n: int = 0
    acc_k: int = 0

    def plus(self, other: Chunk) -> Chunk:
        """The statistics of both; the last record is the one of the higher step, the later one of equals."""
        if not self.n:
            return other
        n_loss = self.n_loss + other.n_loss
        mean, m2 = other.mean, other.m2
        if self.n_loss and other.n_loss:
            mean = (self.mean * self.n_loss + other.mean * other.n_loss) / n_loss
            m2 = self.m2 + other.m2 + (other.mean - self.mean) ** 2 * self.n_loss * other.n_loss / n_loss
        elif self.n_loss:
            mean, m2 = self.mean, self.m2
        last = other if other.step >= self.step else self
        return Chunk(self.n + other.n, n_loss, mean, m2, last.step, last.time, last.epoch,
                     self.labelled + other.labelled, self.acc_n + other.acc_n, self.acc_k + other.acc_k)


def _row(run_id, split, c: Chunk) -> tuple:
    mean = c.mean if c.n_loss else None
    with np.errstate(all="ignore"):
        std = float(np.sqrt(c.m2 / (c.n_loss - 1))) if c.n_loss > 1 else None
        perplexity = None if mean is None else float(np.exp(mean))
    return (run_id, c.n, c.step, c.time, c.epoch, run_id, split, mean, std, perplexity,
            mean is not None and math.isnan(mean), std is not None and math.isnan(std),
            c.acc_n if c.labelled else None, c.acc_k if c.labelled else None)


def make_summariser(flush_interval: int, aggregation_interval: int, timeout_ms: int | None = None):
    """The per-run state function for ``applyInPandasWithState``.

    The records of a run in a micro-batch are cut into chunks with array operations; the first one may go on
    with the chunk that the state holds, the last one may stay open.
    """

    def chunks(rows: pd.DataFrame, begin: np.ndarray) -> list[Chunk]:
        """The statistics of the runs of rows that start at ``begin``."""
        end = np.append(begin[1:], len(rows))
        loss = rows["loss"].to_numpy("float64", na_value=np.nan)
        has = ~rows["loss_null"].to_numpy(bool) if "loss_null" in rows else rows["loss"].notna().to_numpy()
        n_loss = np.add.reduceat(has.astype("int64"), begin)
        with np.errstate(all="ignore"):
            mean = np.add.reduceat(np.where(has, loss, 0.0), begin) / n_loss
            off = np.where(has, loss - np.repeat(mean, end - begin), 0.0)
            m2 = np.add.reduceat(off * off, begin)
        sums = [np.zeros(len(begin), "int64")] * 3
        if "__acc_n" in rows:
            known = rows["__acc_n"].notna()
            sums = [np.add.reduceat(x.to_numpy("int64"), begin) for x in
                    (known, rows["__acc_n"].fillna(0), rows["__acc_k"].fillna(0))]
        last = rows.iloc[end - 1]
        return [Chunk(int(e - b), int(k), float(m) if k else 0.0, float(q) if k else 0.0, int(st), _fmt(t),
                      None if pd.isna(ep) else int(ep), int(x), int(y), int(z))
                for b, e, k, m, q, st, t, ep, x, y, z in
                zip(begin, end, n_loss, mean, m2, last["step"], last["time"], last["epoch"], *sums)]

    def fn(key, batches, state):
        run_id = key[0]
        split, pos, last_step, regressions, *held = state.get if state.exists else (None, 0, None, 0)
        chunk = Chunk(*held)
        out = []
        frames = [] if state.hasTimedOut else [b for b in batches if len(b)]
        rows = pd.concat(frames).sort_values("step", kind="stable") if frames else pd.DataFrame({"end_of_run": []})
        marks = rows["end_of_run"].eq(True).to_numpy(bool)
        rows = rows[~marks]
        if len(rows):
            step = rows["step"].to_numpy("int64")
            codes = pd.factorize(pd.concat([pd.Series([split], dtype=object), rows["split"].astype(object)]))[0]
            turn = codes[1:] != codes[:-1]
            turn[0] = turn[0] and pos > 0
            # place of every record since the last turn, in its flush group, in its chunk
            index = np.arange(len(rows))
            since = np.maximum.accumulate(np.where(turn, index, -1))
            place = np.where(since < 0, index + pos, index - since)
            in_group = place % flush_interval if flush_interval else place
            starts = turn | (in_group % aggregation_interval == 0)
            begin = np.flatnonzero(starts)
            goes_on = not starts[0]
            parts = chunks(rows, np.append(0, begin) if goes_on else begin)
            splits = rows["split"].iloc[np.append(0, begin) if goes_on else begin].tolist()
            if goes_on:
                parts[0] = chunk.plus(parts[0])
            elif chunk.n:
                out.append(_row(run_id, split, chunk))
            out += [_row(run_id, s, c) for s, c in zip(splits[:-1], parts[:-1])]
            split, chunk, pos = splits[-1], parts[-1], int(place[-1]) + 1
            full = (in_group[-1] + 1) % aggregation_interval == 0 or in_group[-1] + 1 == flush_interval
            if full:
                out.append(_row(run_id, split, chunk))
                chunk = Chunk()
            highest = np.maximum.accumulate(step if last_step is None else np.append(last_step, step))
            passed = step[1:] <= highest[:-1] if last_step is None else step <= highest[:-1]
            regressions += int(passed.sum())
            last_step = int(highest[-1])
        if state.hasTimedOut or marks.any():
            if chunk.n:
                out.append(_row(run_id, split, chunk))
            state.remove()
        else:
            state.update((split, pos, last_step, regressions, *chunk))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=SUMMARY_OUT.fieldNames()).astype(
            {"epoch": "Int32", "__acc_n_sum": "Int64", "__acc_k_sum": "Int64"})

    return fn


#: The result columns of each metric; the names are those of the batch registry.
STREAM_METRICS = {"loss": ["loss_mean", "loss_std"], "perplexity": ["perplexity"],
                  "accuracy": ["accuracy_mean", "accuracy_std"]}


def stream_count_summary(stream: DataFrame, flush_interval: int = 1000, aggregation_interval: int = 1,
                         timeout_ms: int | None = None, metrics=("loss", "perplexity")) -> DataFrame:
    """Count-window summary of a step-record stream (append mode).

    ``metrics`` are any of ``loss``, ``perplexity`` and ``accuracy`` (of ``logits`` and ``labels``).
    Runs close on an end-of-run record; with ``timeout_ms`` an idle run is
    also closed after that much processing time (the close flush).  Without a
    timeout an ``availableNow`` query ends once the input is drained.
    """
    unknown = [m for m in metrics if m not in STREAM_METRICS]
    if unknown:
        raise ValueError(f"a stream has the metrics {sorted(STREAM_METRICS)}, not {unknown}")
    ship_package(stream.sparkSession)
    if "end_of_run" not in stream.columns:
        stream = stream.withColumn("end_of_run", F.lit(None).cast("boolean"))
    cols = ["run_id", "split", "epoch", "step", "time", "loss", "end_of_run"]
    accuracy = METRICS["accuracy"]()
    if "accuracy" in metrics:
        stream = accuracy.prepare(stream)
        cols += accuracy.temp_cols
    closed = stream.select(*cols, F.col("loss").isNull().alias("loss_null")).groupBy("run_id").applyInPandasWithState(
        make_summariser(flush_interval, aggregation_interval, timeout_ms), SUMMARY_OUT, STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
    nan = F.lit(float("nan"))
    closed = (closed.withColumn("loss_mean", F.when(F.col("nan_mean"), nan).otherwise(F.col("loss_mean")))
                    .withColumn("loss_std", F.when(F.col("nan_std"), nan).otherwise(F.col("loss_std")))
                    .withColumn("perplexity", F.when(F.col("nan_mean"), nan).otherwise(F.col("perplexity"))))
    results = {"accuracy": accuracy.finish()}
    found = [c for m in metrics for c in results.get(m, STREAM_METRICS[m])]
    return closed.select("logger_id", "n_steps", "step", "time", "epoch", "run_id", "split", *found)


def stream_ingest(spark: SparkSession, path: str, schema: T.StructType = STREAM_LOG_SCHEMA,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """R2: follow a growing folder of JSON-lines step logs."""
    r = spark.readStream.schema(schema).option("timestampFormat", JSON_TIME_FORMAT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.json(path)


def stream_join_configs(stream: DataFrame, configs: DataFrame, left: str = "run_id",
                        right: str = "id") -> DataFrame:
    """Stream-static inner join of records to run configs (null keys match)."""
    c = configs.withColumn(right, F.col(right).cast("string"))
    return stream.join(c, stream[left].eqNullSafe(c[right]), "inner")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, timeout_s: int | None = None) -> None:
    """Drive a streaming query over everything available into a parquet folder; no time limit unless given."""
    q = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"streaming query did not drain its input within {timeout_s}s")
