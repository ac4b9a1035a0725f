"""Summaries of streams whose records arrive out of order, with any metric that has a state (R1, E1), and idempotent appends (S3).

``stream_ordered_summary`` keeps, per run, the open chunk (its counters, last
record and metric states) and an event-order buffer.  A record waits in the
buffer until the run's watermark, its latest event time minus ``delay``, has
passed it and all records before it; then records are summarised in step order by the rules of
the batch summary W1.  So a log whose records come up to ``delay`` late gives W1's
rows.  A record whose step was already passed, or whose run has ended, can't be put in its
place any more: it comes out as a row of kind ``rejected`` and is counted in no chunk.

The buffer is a list state of sorted Arrow blocks, the chunk a value state, and idle
runs are closed by a processing-time timer.  A run's state is as large as what it holds back, the
records of ``delay``, whatever the run's length.

``append_batches`` writes each micro-batch as JSON lines into a folder of its
own and then lists it in a manifest.  A batch that is sent again after a crash
replaces its folder, and readers only read listed folders, so a restarted
stream leaves every row once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from stepwise.functions.scalars import timestamp_str
from stepwise.operators.logs import state_metric
from stepwise.operators.metrics import StateMetric, ends_of
from stepwise.session import ship_package

SUMMARY, REJECTED = "summary", "rejected"
#: Stands for a null number on its way through pandas.
NULL = -(1 << 61)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a run remembers: the split and place of the next record, the highest step released, the latest time, the open
#: chunk's size and last record, and whether the run has ended.  Metric states follow.
RUN_STATE = "split string, pos bigint, passed bigint, latest bigint, ended boolean, n bigint, step bigint, time bigint, epoch bigint"


def cut(splits: np.ndarray, split, pos: int, flush_interval: int, aggregation_interval: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where records that follow a run's ``pos`` records of ``split`` start chunks, their places since the last turn, and whether the last chunk is full."""
    codes = pd.factorize(np.concatenate([[split], splits]).astype(object))[0]
    turn = codes[1:] != codes[:-1]
    turn[0] = turn[0] and pos > 0
    index = np.arange(len(splits))
    since = np.maximum.accumulate(np.where(turn, index, -1))
    place = np.where(since < 0, index + pos, index - since)
    in_group = place % flush_interval if flush_interval else place
    starts = turn | (in_group % aggregation_interval == 0)
    full = (in_group[-1] + 1) % aggregation_interval == 0 or in_group[-1] + 1 == flush_interval
    return starts, place, bool(full)


class OrderedSummary(StatefulProcessor):
    """The state of one run; see the module docstring."""

    def __init__(self, metrics: list[StateMetric], flush_interval: int, aggregation_interval: int, delay_us: int, idle_ms: int | None):
        self.metrics, self.flush, self.interval, self.delay, self.idle = metrics, flush_interval, aggregation_interval, delay_us, idle_ms
        self.states = [(m, n, f"state__{m.name}_{n}", k) for m in metrics for n, k in m.state.items()]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = "".join(f", {name} {kind}" for _, _, name, kind in self.states)
        self.handle = handle
        self.run = handle.getValueState("run", RUN_STATE + kinds)
        self.waiting = handle.getListState("waiting", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return
        new = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        marks = new["end_of_run"].to_numpy(bool)
        run = self.remembered()
        records = new[~marks]
        late = np.full(len(records), run["ended"]) | (records["step"].to_numpy() <= run["passed"])
        yield from self.out(key[0], [], records[late])
        table = [pa.Table.from_pandas(records[~late], preserve_index=False)] if not late.all() else []
        blocks = [pa.ipc.open_stream(b[0]).read_all() for b in self.waiting.get()] if self.waiting.exists() else []
        held = pa.concat_tables([*blocks, *table]).sort_by("step") if blocks or table else None
        if len(records):
            run["latest"] = max(run["latest"], int(records["time_us"].max()))
        yield from self.release(key[0], run, held, bool(marks.any()))
        if self.idle is not None and not run["ended"]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        blocks = [pa.ipc.open_stream(b[0]).read_all() for b in self.waiting.get()] if self.waiting.exists() else []
        yield from self.release(key[0], self.remembered(), pa.concat_tables(blocks).sort_by("step") if blocks else None, True)

    def close(self) -> None:
        pass

    def remembered(self) -> dict:
        names = [f.split()[0] for f in RUN_STATE.split(", ")] + [name for _, _, name, _ in self.states]
        if self.run.exists():
            return dict(zip(names, self.run.get()))
        return dict.fromkeys(names, 0) | {"split": None, "passed": -(1 << 62), "latest": -(1 << 62), "ended": False, "epoch": None, "time": None}

    def release(self, run_id, run: dict, held: pa.Table | None, ends: bool) -> Iterator[pd.DataFrame]:
        """Summarises what the watermark has passed, all if the run ends; keeps the rest in order."""
        closed: list[dict] = []
        if held is not None and len(held):
            ready = len(held)
            if not ends:
                early = held["time_us"].to_numpy() <= run["latest"] - self.delay
                ready = int(np.argmin(early)) if not early.all() else len(held)
            if ready:
                closed = self.summarised(run, held.slice(0, ready))
            self.waiting.clear()
            if ready < len(held):
                rest = held.slice(ready).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_table(rest)
                self.waiting.put([(sink.getvalue().to_pybytes(),)])
        if ends:
            if run["n"]:
                closed.append(self.chunk(run))
                run["n"] = 0
            run["ended"] = True
        self.run.update(tuple(run.values()))
        yield from self.out(run_id, closed, None)

    def chunk(self, run: dict) -> dict:
        return {k: run[k] for k in ("split", "n", "step", "time", "epoch")} | {name: run[name] for _, _, name, _ in self.states}

    def summarised(self, run: dict, rows: pa.Table) -> list[dict]:
        """Adds records in step order to the run; the chunks that this closes."""
        splits = rows["split"].to_numpy()
        starts, place, full = cut(splits, run["split"], run["pos"], self.flush, self.interval)
        begin = np.flatnonzero(starts)
        goes_on = not starts[0]
        begin = np.concatenate([[0], begin]) if goes_on else begin
        end = ends_of(begin, len(rows))
        at = end - 1
        part = {"split": splits[begin], "n": end - begin, **{k: rows[c].take(pa.array(at)).to_pylist() for k, c in (("step", "step"), ("time", "time_us"), ("epoch", "epoch"))}}
        for m in self.metrics:
            found = m.update(m.read(lambda n: rows[n].to_numpy()), begin)
            if goes_on:
                joined = m.merge({n: np.array([run[f"state__{m.name}_{n}"]]) for n in m.state}, {n: found[n][:1] for n in m.state})
                for n in m.state:
                    found[n] = found[n].astype(joined[n].dtype)
                    found[n][0] = joined[n][0]
            part |= {f"state__{m.name}_{n}": found[n].tolist() for n in m.state}
        chunks = [dict(zip(part, values)) for values in zip(*part.values())]
        closed = []
        if goes_on:
            chunks[0]["n"] += run["n"]
        elif run["n"]:
            closed.append(self.chunk(run))
        closed += chunks[:-1]
        run |= {**chunks[-1], "n": int(chunks[-1]["n"]), "pos": int(place[-1]) + 1, "passed": int(rows["step"][-1].as_py())}
        if full:
            closed.append(self.chunk(run))
            run["n"] = 0
        return closed

    def out(self, run_id, closed: list[dict], rejected: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        """Rows of closed chunks, or of rejected records.  Numbers go as text, since pandas would turn NaN into null."""
        text = lambda x: None if x is None else repr(float(x)) if isinstance(x, float) else str(x)
        if rejected is not None and len(rejected):
            some = [{"kind": REJECTED, "split": s, "n": 1, "step": t, "time": u, "epoch": e}
                    for s, t, u, e in zip(rejected["split"], rejected["step"], rejected["time_us"], rejected["epoch"])]
        else:
            some = [{"kind": SUMMARY, **c} for c in closed]
        if some:
            names = ["n", "step", "time", "epoch", *(name for _, _, name, _ in self.states)]
            yield pd.DataFrame([[r["kind"], run_id, r["split"], *(text(r.get(n)) for n in names)] for r in some], columns=["kind", "run_id", "split", *names], dtype=object)


def stream_ordered_summary(stream: DataFrame, flush_interval: int = 1000, aggregation_interval: int = 1, metrics=("loss",),
                           delay: float = 0.0, idle_ms: int | None = None) -> DataFrame:
    """R1 in event order: (kind, logger_id, n_steps, step, time, epoch, run_id, split, metric columns), append mode.

    ``metrics`` are names or metrics with a state; ``delay`` is how many seconds of event time (``time``) a record may
    come late.  A run ends with an ``end_of_run`` record, which must come after the run's records, or when it
    got nothing for ``idle_ms`` (Spark then runs batches without end, so such a query must be stopped); its end is remembered.  Rows of kind ``rejected`` are records that came too late,
    their metric columns are null.  A null time counts as long passed.  Needs and sets the RocksDB state store.
    """
    ms = [state_metric(m) for m in metrics]
    if any(m is None for m in ms):
        raise ValueError(f"a stream needs metrics with a state: {[m for m, s in zip(metrics, ms) if s is None]}")
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ended = F.coalesce(F.col("end_of_run"), F.lit(False)) if "end_of_run" in stream.columns else F.lit(False)
    inputs = [c for m in ms for c in m.input_columns()]
    records = stream.select("run_id", F.col("split").cast("string").alias("split"), *[F.coalesce(c, F.lit(NULL)).alias(n) for n, c in (
        ("epoch", F.col("epoch").cast("bigint")), ("step", F.col("step").cast("bigint")), ("time_us", F.unix_micros(F.col("time").cast("timestamp"))))], ended.alias("end_of_run"), *inputs)
    names = ["n", "step", "time", "epoch", *(s for m in ms for s in m.state_names())]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ["kind", "run_id", "split", *names]])
    closed = records.groupBy("run_id").transformWithStateInPandas(
        OrderedSummary(ms, flush_interval, aggregation_interval, math.ceil(delay * 1e6), idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime")
    kinds = {s: k for m in ms for s, k in zip(m.state_names(), m.state.values())}
    closed = closed.withColumns({s: F.col(s).cast(k) for s, k in kinds.items()})
    n_steps, step, us, epoch = (F.nullif(F.col(c).cast("bigint"), F.lit(NULL)) for c in ("n", "step", "time", "epoch"))
    out = closed.select("kind", F.col("run_id").alias("logger_id"), n_steps.alias("n_steps"), step.alias("step"), timestamp_str(F.timestamp_micros(us)).alias("time"),
                        epoch.cast("int").alias("epoch"), "run_id", "split", *[c for m in ms for c in m.results()])
    return out.select(*out.columns[:8], *[F.when(F.col("kind") == SUMMARY, F.col(f"`{c}`")).alias(c) for c in out.columns[8:]])


# ---------------------------------------------------------------- S3

def append_batches(stream: DataFrame, path: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Starts a query over what is there that appends every micro-batch to ``path`` as JSON lines, once.

    A batch's folder is replaced if the batch comes again, and listed in the manifest after it is whole.
    ``name`` tells streams apart that write to one path.
    """
    def write(batch: DataFrame, number: int) -> None:
        folder = f"stream={name}/batch={number}"
        batch.write.mode("overwrite").json(f"{path}/rows/{folder}")
        batch.sparkSession.createDataFrame([(name, number)], "stream string, batch bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{folder}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of all batches that the manifest lists."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    listed = spark.read.schema("stream string, batch bigint").json(f"{path}/manifest/*/*").distinct()
    keyed = T.StructType([*schema.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(keyed).json(f"{path}/rows").join(F.broadcast(listed), ["stream", "batch"], "left_semi").drop("stream", "batch")
