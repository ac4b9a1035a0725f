"""Count-window log summariser, batch form.

A buffered step logger keeps records per run and, on a flush, cuts the buffer
into chunks of ``aggregation_interval`` records and writes one summary row
per chunk.  A flush happens after ``flush_interval`` records, whenever the
split changes (train <-> val) and at the end of the run.

As a table job this is gaps-and-islands over one window per run:
``island`` = running count of split changes, ``pos`` = position inside the
island, flush group ``fg = pos div F``, chunk = ``(pos - fg*F) div A``.  One
sort-based window pass on the run key plus one hash aggregate on
``(run, island, fg, chunk)``; both use the same run partitioning, so the
operator costs a single shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.arrays import argmax
from stepwise.functions.scalars import timestamp_str
from stepwise.operators.common import join_null_safe, splits_runs
from stepwise.operators.metrics import (StateMetric, add_states, chunk_states, mean_and_spread, merge_mean_and_spread,
                                        python_by_chunk, sums)

LAST_FIELDS = ("step", "time", "epoch", "run_id")


@dataclass
class Metric:
    """A named metric = per-record preparation + chunk aggregates + final projection.

    ``state`` is the same metric as a mergeable state, for streams and beside metrics that have no aggregates.
    """

    name: str
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    aggs: Callable[[], list[Column]] = lambda: []
    finish: Callable[[], list[Column]] = lambda: []
    temp_cols: list[str] = field(default_factory=list)
    state: StateMetric | None = None


def _loss_state() -> StateMetric:
    return StateMetric(
        "loss", inputs={"loss": (lambda: F.col("loss"), "double")}, state={"n": "bigint", "mean": "double", "m2": "double"},
        update=lambda x, begin: mean_and_spread(x["loss"], begin), merge=merge_mean_and_spread,
        finish=lambda c: [F.when(c("n") > 0, c("mean")).alias("loss_mean"),
                          F.when(c("n") > 1, F.sqrt(c("m2") / (c("n") - 1))).alias("loss_std")])


def _perplexity_state() -> StateMetric:
    return StateMetric(
        "perplexity", inputs={"loss": (lambda: F.col("loss"), "double")}, state={"n": "bigint", "mean": "double", "m2": "double"},
        update=lambda x, begin: mean_and_spread(x["loss"], begin), merge=merge_mean_and_spread,
        finish=lambda c: [F.when(c("n") > 0, F.exp(c("mean"))).alias("perplexity")])


def _accuracy_state() -> StateMetric:
    def finish(c):
        n, k = c("n"), c("k")
        mean = F.try_divide(k, n)
        std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(k - n * mean * mean, n - 1))))
        return [F.when(c("labelled") > 0, mean).alias("accuracy_mean"), F.when(c("labelled") > 0, std).alias("accuracy_std")]

    known = lambda x: F.when(F.col("labels").isNotNull(), x)
    return StateMetric(
        "accuracy", inputs={"n": (lambda: known(record_correct()[0]), "bigint"), "k": (lambda: known(record_correct()[1]), "bigint")},
        state={"labelled": "bigint", "n": "bigint", "k": "bigint"},
        update=lambda x, begin: {"labelled": sums((x["n"][1].astype("int64"), x["n"][1]), begin), "n": sums(x["n"], begin), "k": sums(x["k"], begin)},
        merge=add_states, finish=finish)


def _loss_metric() -> Metric:
    """Mean and sample std of per-step losses (step-weighted)."""
    return Metric(
        "loss",
        aggs=lambda: [F.avg("loss").alias("loss_mean"), F.stddev_samp("loss").alias("loss_std")],
        finish=lambda: [F.col("loss_mean"), F.col("loss_std")],
        state=_loss_state(),
    )


def _perplexity_metric() -> Metric:
    """Exp of the mean loss of the chunk."""
    return Metric("perplexity", aggs=lambda: [F.exp(F.avg("loss")).alias("perplexity")],
                  finish=lambda: [F.col("perplexity")], state=_perplexity_state())


def record_correct(logits: str = "logits", labels: str = "labels") -> tuple[Column, Column]:
    """Per record: (samples, correctly classified samples) from a logits matrix and labels."""
    pairs = F.arrays_zip(F.col(logits).alias("l"), F.col(labels).alias("y"))
    correct = F.aggregate(pairs, F.lit(0).cast("bigint"),
                          lambda acc, p: acc + F.when(argmax(p["l"]) == p["y"], 1).otherwise(0))
    return F.size(labels).cast("bigint"), correct


def _accuracy_metric() -> Metric:
    """Accuracy over all samples of the chunk (sample-weighted), sample std of correctness."""

    def prepare(df):
        n, k = record_correct()
        return df.withColumn("__acc_n", F.when(F.col("labels").isNotNull(), n)) \
                 .withColumn("__acc_k", F.when(F.col("labels").isNotNull(), k))

    def finish():
        n, k = F.col("__acc_n_sum"), F.col("__acc_k_sum")
        mean = F.try_divide(k, n)
        std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(k - n * mean * mean, n - 1))))
        return [mean.alias("accuracy_mean"), std.alias("accuracy_std")]

    return Metric(
        "accuracy", prepare=prepare,
        aggs=lambda: [F.sum("__acc_n").alias("__acc_n_sum"), F.sum("__acc_k").alias("__acc_k_sum")],
        finish=finish, temp_cols=["__acc_n", "__acc_k"], state=_accuracy_state())


@dataclass
class PandasMetric:
    """E1 fallback: arbitrary Python over one chunk's records (a UDAF).

    ``fn`` gets the chunk's records (columns ``fields``, in step order) as a
    pandas DataFrame and returns a dict matching ``schema`` (a DDL string).
    Chunks are bounded by ``aggregation_interval`` records, so a group never
    grows with the data.
    """

    name: str
    fn: Callable
    schema: str
    fields: list[str]


METRICS: dict[str, Callable[[], Metric | StateMetric | PandasMetric]] = {
    "loss": _loss_metric,
    "accuracy": _accuracy_metric,
    "perplexity": _perplexity_metric,
}


def register_metric(name: str, factory: Callable[[], Metric | StateMetric | PandasMetric]) -> None:
    """Add a metric to the registry under a config name.

    A ``StateMetric`` runs in the batch summary, on split runs and in streams.
    """
    METRICS[name] = factory


def state_metric(metric) -> StateMetric | None:
    """The mergeable form of a metric or metric name, if it has one."""
    m = METRICS[metric]() if isinstance(metric, str) and metric in METRICS else metric
    return m if isinstance(m, StateMetric) else getattr(m, "state", None)


def chunk_keys(df: DataFrame, run_key: str, seq: str, split: str,
               flush_interval: int = 1000, aggregation_interval: int = 1) -> DataFrame:
    """Add ``__island, __fg, __chunk`` (the summary row each record belongs to)."""
    if aggregation_interval < 1:
        raise ValueError("aggregation_interval must be >= 1")
    if flush_interval < 0:
        raise ValueError("flush_interval must be >= 0")
    w = Window.partitionBy(run_key).orderBy(seq)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = F.lag(split).over(w)
    rn = F.row_number().over(w) - 1
    out = (df.withColumn("__rn", rn)
             .withColumn("__chg", F.when((F.col("__rn") > 0) & ~F.col(split).eqNullSafe(prev), 1).otherwise(0)))
    out = (out.withColumn("__island", F.sum("__chg").over(running))
              .withColumn("__start", F.max(F.when((F.col("__chg") == 1) | (F.col("__rn") == 0),
                                                   F.col("__rn"))).over(running)))
    pos = F.col("__rn") - F.col("__start")
    fg = F.floor(pos / flush_interval) if flush_interval else F.lit(0)
    out = out.withColumn("__fg", fg.cast("bigint"))
    inner = pos - F.col("__fg") * (flush_interval or 0)
    return (out.withColumn("__chunk", F.floor(inner / aggregation_interval).cast("bigint"))
               .drop("__rn", "__chg", "__start"))


def chunk_keys_skew_safe(df: DataFrame, run_key: str, seq: str, split: str,
                         flush_interval: int = 1000, aggregation_interval: int = 1) -> DataFrame:
    """``chunk_keys`` without any window partitioned by the run alone.

    Records are range-partitioned on (run, seq) — a hot run is split over many
    partitions — and written to the shared checkpoint folder so partition
    contents are fixed.  Each (partition, run) *slice* is numbered locally;
    a small slice table (one row per slice) carries the offsets across
    partitions: rows before the slice, the split at the slice boundary,
    split changes before it and the position of the last change.
    """
    from stepwise.operators.common import bounded_broadcast, range_parts
    from stepwise.session import ensure_checkpoint_dir

    if aggregation_interval < 1 or flush_interval < 0:
        raise ValueError("aggregation_interval must be >= 1 and flush_interval >= 0")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = (df.repartitionByRange(range_parts(spark), run_key, seq)
               .withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True))
    w = Window.partitionBy("__pid", run_key).orderBy(seq)
    run_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (parts.withColumn("__lrn", F.row_number().over(w) - 1)
                  .withColumn("__lchg", F.when((F.col("__lrn") > 0) & ~F.col(split).eqNullSafe(F.lag(split).over(w)),
                                               1).otherwise(0)))
    first = F.min_by(F.col(split), F.col(seq))
    last = F.max_by(F.col(split), F.col(seq))
    slices = local.groupBy(run_key, "__pid").agg(
        F.count(F.lit(1)).alias("__cnt"), first.alias("__first"), last.alias("__last"),
        F.sum("__lchg").alias("__nchg"),
        F.max(F.when(F.col("__lchg") == 1, F.col("__lrn"))).alias("__lastchg"))
    sw = Window.partitionBy(run_key).orderBy("__pid")
    before = sw.rowsBetween(Window.unboundedPreceding, -1)
    slices = (slices.withColumn("__off", F.coalesce(F.sum("__cnt").over(before), F.lit(0)))
                    .withColumn("__prev", F.lag("__last").over(sw)))
    slices = slices.withColumn("__bchg", F.when((F.col("__off") > 0) & ~F.col("__first").eqNullSafe(F.col("__prev")),
                                                1).otherwise(0))
    # global position of the last change inside each slice (boundary change counts at local 0)
    slices = slices.withColumn("__slast", F.coalesce(
        F.col("__off") + F.col("__lastchg"), F.when(F.col("__bchg") == 1, F.col("__off"))))
    slices = (slices.withColumn("__isl_off", F.coalesce(F.sum(F.col("__nchg") + F.col("__bchg")).over(before), F.lit(0)))
                    .withColumn("__start_off", F.coalesce(F.max("__slast").over(before), F.lit(0)))
                    .select(run_key, "__pid", "__off", "__bchg", "__isl_off", "__start_off"))
    slices = bounded_broadcast(slices, 500_000)
    j = join_null_safe(local, slices, [run_key, "__pid"])
    chg = F.when(F.col("__lrn") == 0, F.col("__bchg")).otherwise(F.col("__lchg"))
    rn = F.col("__off") + F.col("__lrn")
    j = j.withColumn("__rn", rn).withColumn("__chg", chg)
    j = (j.withColumn("__island", F.col("__isl_off") + F.sum("__chg").over(run_to))
          .withColumn("__start", F.greatest(F.col("__start_off"),
                                            F.coalesce(F.max(F.when(F.col("__chg") == 1, F.col("__rn"))).over(run_to),
                                                       F.lit(0)))))
    pos = F.col("__rn") - F.col("__start")
    fg = F.floor(pos / flush_interval) if flush_interval else F.lit(0)
    j = j.withColumn("__fg", fg.cast("bigint"))
    inner = pos - F.col("__fg") * (flush_interval or 0)
    return (j.withColumn("__chunk", F.floor(inner / aggregation_interval).cast("bigint"))
             .drop("__pid", "__lrn", "__lchg", "__off", "__bchg", "__isl_off", "__start_off",
                   "__rn", "__chg", "__start"))


def count_window_summary(df: DataFrame, run_key: str = "run_id", seq: str = "step",
                         split: str = "split", flush_interval: int = 1000,
                         aggregation_interval: int = 1, metrics=("loss",),
                         logger_id: Column | None = None, skew_safe: bool | None = None) -> DataFrame:
    """One summary row per chunk with n_steps (A10), last-record fields (A9) and metrics.

    Output: logger_id, n_steps, step, time (string, microseconds), epoch,
    run_id, split, then each metric's columns.  ``skew_safe`` splits very
    long runs across tasks (see ``chunk_keys_skew_safe``); None measures the runs and decides.
    """
    skew_safe = splits_runs(df, run_key, skew_safe)
    asked = [METRICS[m]() if isinstance(m, str) else m for m in metrics]
    py = [m for m in asked if isinstance(m, PandasMetric)]
    # beside a metric that only has a state, all that have one share its pass
    mergeable = [m for m in asked if state_metric(m)] if any(isinstance(m, StateMetric) for m in asked) else []
    ms = [m for m in asked if m not in py and m not in mergeable]
    for m in ms:
        df = m.prepare(df)
    keys_fn = chunk_keys_skew_safe if skew_safe else chunk_keys
    keyed = keys_fn(df, run_key, seq, split, flush_interval, aggregation_interval)
    last_cols = [c for c in LAST_FIELDS if c in df.columns]
    if split not in last_cols:
        last_cols.append(split)
    keys = [run_key, "__island", "__fg", "__chunk"]
    grouped = None
    if mergeable:
        grouped = chunk_states(keyed, keys, seq, last_cols, [state_metric(m) for m in mergeable])
    if ms or not mergeable:
        last = F.max_by(F.struct(*[F.col(c).alias(c) for c in last_cols]), F.col(seq))
        own = [] if mergeable else [F.count(F.lit(1)).cast("bigint").alias("n_steps"), last.alias("__last")]
        native = keyed.groupBy(*keys).agg(*own, *[a for m in ms for a in m.aggs()])
        grouped = native if grouped is None else join_null_safe(grouped, native, keys)
    lid = logger_id if logger_id is not None else F.col(run_key).cast("string")
    sel = [lid.alias("logger_id"), F.col("n_steps")]
    for c in last_cols:
        v = F.col("__last")[c]
        sel.append(timestamp_str(v).alias(c) if c == "time" else v.alias(c))
    if run_key not in last_cols:
        sel.append(F.col(run_key))
    for m in asked:
        if m in py:
            # the windows of the default path leave a run, so a chunk, in one partition
            records = keyed.repartition(*keys) if skew_safe else keyed
            grouped = join_null_safe(grouped, python_by_chunk(records, keys, seq, m.fields, m.fn, m.schema), keys)
            sel += [F.col(f.split()[0]) for f in m.schema.split(",")]
        else:
            sel += state_metric(m).results() if m in mergeable else m.finish()
    return grouped.select(*sel)


def collect_field_lists(df: DataFrame, keys, seq: str, fields) -> DataFrame:
    """Per chunk, each field's values (in sequence order) from the records that have it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    aggs = []
    for f in fields:
        items = F.collect_list(F.when(F.col(f).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(f).alias("v"))))
        aggs.append(F.transform(F.array_sort(items), lambda x: x["v"]).alias(f))
    return df.groupBy(*keys).agg(*aggs)
