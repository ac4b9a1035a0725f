"""Training of a whole parameter grid with one pass over the samples a step (M1).

Every grid row is a classifier of dense layers: an input layer, ``depth`` layers of
``width`` with ReLU, an output layer, cross-entropy loss, ``sgd`` or ``adam``.  All runs see the same batches.
A step is one Spark job: each task computes the gradients of all runs over its
samples, runs of one shape in stacked matrix products, and sends partial sums
in pieces of bounded size; they are added in two levels.  The driver then moves
all runs' weights at once, as stacked arrays, and broadcasts them for the next
step.  Grids whose weights exceed ``MAX_WEIGHTS`` numbers are trained in several blocks of runs.

Small batches don't need a job each: steps of ``LOT_ROWS`` rows together are one job, in which every task
moves some of the runs through the lot's steps and keeps their weights at the validations;
a second job then validates all of these weights in one pass over the held-out rows.

The result is the run log: one row for each run and step, and one for each
validation, which follows every ``val_interval``-th step as W5 has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.operators.common import parallelism
from stepwise.operators.rank import epoch_shuffle
from stepwise.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Weights of all runs of a block that are broadcast and held by the driver (three times with adam's moments).
MAX_WEIGHTS = 1 << 23
#: Numbers in a piece of a gradient; numbers of one layer's activations that a task holds at once.
PIECE, ACTIVATIONS = 1 << 12, 1 << 22
#: Train rows of the steps that one job takes.
LOT_ROWS = 1 << 14
#: Partial sums that are added in one group.
FAN_IN = 64
# adam's decay rates and the term that keeps its divisor from zero.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8

LOG = "run_id long, split string, epoch int, step long, loss double, n_samples long, n_correct long, accuracy double"


def shapes(width: int, depth: int, input_dim: int, n_classes: int) -> list[tuple[int, int]]:
    return [(input_dim, width), *[(width, width)] * depth, (width, n_classes)]


def n_weights(layers: list[tuple[int, int]]) -> int:
    return sum(i * o + o for i, o in layers)


def first_weights(run_id: int, layers: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Uniform within 1 / sqrt(inputs of the layer); each layer's matrix, row by row, then its biases."""
    rnd = np.random.default_rng([seed, run_id])
    return np.concatenate([rnd.uniform(-1, 1, i * o + o) / math.sqrt(i) for i, o in layers])


def _unpacked(flat: np.ndarray, layers: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at, runs = 0, len(flat)
    for i, o in layers:
        yield flat[:, at:at + i * o].reshape(runs, i, o), flat[:, at + i * o:at + i * o + o][:, None, :]
        at += i * o + o


def losses(flat: np.ndarray, layers: list[tuple[int, int]], x: np.ndarray, y: np.ndarray, want_gradient: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Summed loss, right answers and summed gradient of every run of one shape."""
    weights = list(_unpacked(flat, layers))
    inputs, h = [], np.broadcast_to(x, (len(flat), *x.shape))
    for k, (w, b) in enumerate(weights):
        inputs.append(h)
        h = h @ w + b
        if 0 < k < len(weights) - 1:
            h = np.maximum(h, 0.0)
    top = h - h.max(axis=2, keepdims=True)
    logs = top - np.log(np.exp(top).sum(axis=2, keepdims=True))
    at = np.arange(len(y))
    loss, right = -logs[:, at, y].sum(axis=1), (h.argmax(axis=2) == y).sum(axis=1)
    if not want_gradient:
        return loss, right, None
    d = np.exp(logs)
    d[:, at, y] -= 1.0
    out = []
    for k in reversed(range(len(weights))):
        out.append(np.concatenate([(inputs[k].transpose(0, 2, 1) @ d).reshape(len(flat), -1), d.sum(axis=1)], axis=1))
        if k:
            d = d @ weights[k][0].transpose(0, 2, 1)
            if k > 1:
                d = d * (inputs[k] > 0)
    return loss, right, np.concatenate(out[::-1], axis=1)


@dataclass
class Block:
    """Runs that are trained together: by shape, the runs and their stacked weights."""

    groups: list[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]


def _partial_sums(rows: DataFrame, shared, want_val: bool, want_gradient: bool = True) -> DataFrame:
    """(run, piece, values): piece -1 has loss, rows and right answers of train, then of validation; the others the gradient."""
    def run(batches):
        block: Block = shared.value
        total = {}
        for batch in batches:
            if not len(batch):
                continue
            width = block.groups[0][0][0][0]
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), width)
            y, val = batch.column(2).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for g, (layers, _, flat) in enumerate(block.groups):
                step = max(1, ACTIVATIONS // (len(flat) * max(max(s) for s in layers)))
                for part in ([False, True] if want_val else [False]):
                    own = np.flatnonzero(val == part)
                    for lo in range(0, len(own), step):
                        some = own[lo:lo + step]
                        loss, right, grad = losses(flat, layers, x[some], y[some], not part)
                        heads, sums = total.setdefault(g, (np.zeros((len(flat), 6)), np.zeros(flat.shape if want_gradient else (len(flat), 0))))
                        heads[:, 3 * part:3 * part + 3] += np.stack([loss, np.full(len(flat), len(some)), right], axis=1)
                        if grad is not None:
                            sums += grad
        for g, (heads, sums) in total.items():
            runs = block.groups[g][1]
            for r, head, s in zip(runs, heads, sums):
                pieces = [head, *(s[i:i + PIECE] for i in range(0, len(s), PIECE))]
                yield pa.record_batch([pa.array([r] * len(pieces), pa.int64()), pa.array(np.arange(-1, len(pieces) - 1, dtype=np.int32)), pa.array([p.tolist() for p in pieces], pa.list_(pa.float64()))],
                                      ["run", "piece", "values"])

    return rows.select("val", "x", "y").mapInArrow(run, "run long, piece int, values array<double>")


def _added(parts: DataFrame, tasks: int) -> DataFrame:
    """Sums of the pieces; more than ``FAN_IN`` of them are added in two levels."""
    def add(table: pa.Table) -> pa.Table:
        lists = table["values"].combine_chunks()
        total = lists.flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
        return pa.table({"run": table["run"].slice(0, 1), "piece": table["piece"].slice(0, 1), "values": pa.array([total.tolist()], pa.list_(pa.float64()))})

    kind = "run long, piece int, values array<double>"
    if tasks > FAN_IN:
        parts = parts.withColumn("lot", F.spark_partition_id() % math.ceil(tasks / FAN_IN)).groupBy("run", "piece", "lot").applyInArrow(
            lambda t: add(t), kind)
    return parts.groupBy("run", "piece").applyInArrow(add, kind)


def train_grid(samples: DataFrame, grid: DataFrame, id_col: str, features: str, label: str, input_dim: int, n_classes: int,
               epochs: int = 10, batch_size: int | None = None, val_interval: int = 1, seed: int = 42) -> DataFrame:
    """M1: the log (``LOG``) of training every row of ``grid`` (run_id, width, depth, optimizer, learning_rate) on ``samples``.

    ``samples`` have ``split`` train or val.  Batches of ``batch_size`` are dealt anew each epoch (W6); without a
    size every step takes all train rows.  Rows without a label or a whole vector of ``input_dim`` take no part; a label outside the classes is an error.
    ``loss`` and ``accuracy`` of a train row are those of its batch before the step, of a val row those after it.
    """
    spark = samples.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    x = F.transform(features, lambda v: v.cast("double"))
    y = F.col(label).cast("int")
    good = F.coalesce((F.size(features) == input_dim) & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    checked = F.when((y >= 0) & (y < n_classes), y).otherwise(F.raise_error(F.concat(F.lit("no such class: "), y.cast("string"))).cast("int"))
    rows = samples.where(good & y.isNotNull() & F.col("split").isin("train", "val")).select(F.col(id_col).alias("id"), (F.col("split") == "val").alias("val"), x.alias("x"), checked.alias("y"))
    path = scratch_path(spark, "samples")
    train, val = rows.where("not val"), rows.where("val")
    if batch_size is None:
        train.drop("id").write.parquet(f"{path}/all")
        per_epoch = 1
    else:
        n = train.count()
        per_epoch = max(1, math.ceil(n / batch_size))
    blocks = list(_blocks(grid.select("run_id", "width", "depth", "optimizer", "learning_rate").orderBy("run_id").collect(), input_dim, n_classes, seed))
    lot_steps = 1 if batch_size is None else _lot_steps(blocks, batch_size, val_interval)
    if batch_size is not None:
        step = F.col("epoch") * per_epoch + F.floor(F.col("position") / batch_size) + 1
        steps = epoch_shuffle(train, "id", epochs, seed).select("val", "x", "y", step.cast("long").alias("step"))
        lots = steps.withColumn("lot", F.floor((F.col("step") - 1) / lot_steps))
        lots.repartition("lot").write.partitionBy("lot").parquet(path)
    val.drop("id").repartition(parallelism(spark)).write.parquet(f"{path}/val")
    kind = "val boolean, x array<double>, y int, step long"
    held_out = spark.read.schema(kind).parquet(f"{path}/val")

    def rows_of(lot: int) -> DataFrame:
        return spark.read.schema(kind).parquet(f"{path}/all" if batch_size is None else f"{path}/lot={lot}")

    log: list[tuple] = []
    for block in blocks:
        if lot_steps > 1:
            log += _train_lots(spark, *block, rows_of, held_out, epochs * per_epoch, per_epoch, val_interval, lot_steps, n > 0)
        else:
            log += _train(spark, *block, lambda step: rows_of(step - 1), held_out, epochs * per_epoch, per_epoch, val_interval)
    return spark.createDataFrame(log, LOG)


def _lot_steps(blocks: list[tuple], batch_size: int, val_interval: int) -> int:
    """Steps of a lot: its rows are bounded, and so are the weights, moments and kept weights of its runs together."""
    most = max((sum(w.size for w in block[2]) for block in blocks), default=1)
    return max(1, min(LOT_ROWS // batch_size, (MAX_WEIGHTS // most - 3) * val_interval))


def _blocks(grid: list, input_dim: int, n_classes: int, seed: int) -> Iterator[tuple]:
    """Blocks of runs within the bound: shapes of the groups, run ids, weights, adam flags and rates, all stacked by group."""
    block: dict[tuple, list] = {}
    held = 0
    for r in grid:
        if r["optimizer"] not in ("sgd", "adam"):
            raise ValueError(f"unknown optimizer {r['optimizer']}")
        layers = shapes(r["width"], r["depth"], input_dim, n_classes)
        if block and held + n_weights(layers) > MAX_WEIGHTS:
            yield _stacked(block, seed)
            block, held = {}, 0
        block.setdefault(tuple(layers), []).append(r)
        held += n_weights(layers)
    if block:
        yield _stacked(block, seed)


def _stacked(block: dict, seed: int) -> tuple:
    layers = [list(k) for k in block]
    runs = [np.array([r["run_id"] for r in v]) for v in block.values()]
    weights = [np.stack([first_weights(i, k, seed) for i in ids.tolist()]) for k, ids in zip(layers, runs)]
    adam = [np.array([r["optimizer"] == "adam" for r in v])[:, None] for v in block.values()]
    rate = [np.array([float(r["learning_rate"]) for r in v])[:, None] for v in block.values()]
    return layers, runs, weights, adam, rate


def moved(w: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, adam: np.ndarray, rate: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and moments of all runs after one step with the mean gradient ``g``."""
    m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
    by_moments = m / (1 - BETA1 ** step) / (np.sqrt(v / (1 - BETA2 ** step)) + EPSILON)
    return w - rate * np.where(adam, by_moments, g), m, v


def _train(spark, layers, runs, weights, adam, rate, rows_of, held_out, steps: int, per_epoch: int, val_interval: int) -> list[tuple]:
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    place = {int(r): (g, i) for g, ids in enumerate(runs) for i, r in enumerate(ids)}
    log: list[tuple] = []
    for step in range(1, steps + 2):
        validate = step > 1 and (step - 1) % val_interval == 0
        if step > steps and not validate:
            break
        shared = spark.sparkContext.broadcast(Block(list(zip(layers, runs, weights))))
        rows = held_out if step > steps else rows_of(step).unionByName(held_out) if validate else rows_of(step)
        parts = rows.rdd.getNumPartitions()
        gradients = [np.zeros_like(w) for w in weights]
        heads = np.zeros((sum(map(len, runs)), 6))
        first = np.cumsum([0, *map(len, runs)])
        for r in _added(_partial_sums(rows, shared, validate), parts).toLocalIterator(prefetchPartitions=True):
            g, i = place[r["run"]]
            if r["piece"] < 0:
                heads[first[g] + i] = r["values"]
            else:
                gradients[g][i, r["piece"] * PIECE:r["piece"] * PIECE + len(r["values"])] = r["values"]
        ids = np.concatenate(runs).tolist()
        if validate:
            log += [(i, "val", (step - 2) // per_epoch, step - 1, *_means(h[3:])) for i, h in zip(ids, heads)]
        if step <= steps:
            log += [(i, "train", (step - 1) // per_epoch, step, *_means(h[:3])) for i, h in zip(ids, heads)]
            if heads[0, 1]:
                for g in range(len(layers)):
                    weights[g], *moments[g] = moved(weights[g], gradients[g] / heads[0, 1], *moments[g], adam[g], rate[g], step)
        shared.destroy()
    return log


STATE = "run long, step long, head array<double>, weights array<double>, m array<double>, v array<double>"


def _lot(rows: DataFrame, shared, val_interval: int) -> DataFrame:
    """(run, step, head, weights, m, v) of every step of the rows: head as in ``_partial_sums``; weights where they are validated, with moments at the end (step 0)."""
    def train(table: pa.Table) -> pa.Table:
        layers, runs, w, m, v, adam, rate = shared.value[table["part"][0].as_py()]
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), layers[0][0])
        y, steps = table["y"].to_numpy(), table["step"].to_numpy()
        order = np.argsort(steps, kind="stable")
        ends = np.flatnonzero(np.diff(steps[order], append=-1)) + 1
        out: list[tuple] = []
        for lo, hi in zip([0, *ends[:-1]], ends):
            some, step = order[lo:hi], int(steps[order[lo]])
            loss, right, total = losses(w, layers, x[some], y[some], True)
            w, m, v = moved(w, total / len(some), m, v, adam, rate, step)
            kept = w.tolist() if step % val_interval == 0 else [None] * len(w)
            out += [(r, step, [a, len(some), b], k, None, None) for r, a, b, k in zip(runs.tolist(), loss, right, kept)]
        out += [(r, 0, None, *state) for r, *state in zip(runs.tolist(), w.tolist(), m.tolist(), v.tolist())]
        many = pa.list_(pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), many, many, many, many])], names=["run", "step", "head", "weights", "m", "v"])

    parts = F.explode(F.sequence(F.lit(0), F.lit(len(shared.value) - 1))).alias("part")
    return rows.select(parts, "step", "x", "y").repartition(len(shared.value), "part").groupBy("part").applyInArrow(train, STATE)


def _train_lots(spark, layers, runs, weights, adam, rate, rows_of, held_out, steps: int, per_epoch: int, val_interval: int, lot_steps: int, any_rows: bool) -> list[tuple]:
    """The log of ``_train``, with two jobs for a lot of steps: one moves the weights, one validates all that are kept."""
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    ids = np.concatenate(runs).tolist()
    place = {int(r): (g, i) for g, own in enumerate(runs) for i, r in enumerate(own)}
    share = -(-len(ids) // parallelism(spark))
    log: list[tuple] = []
    for lot, first in enumerate(range(1, steps + 1, lot_steps)):
        last = min(steps, first + lot_steps - 1)
        checked = [s for s in range(first, last + 1) if s % val_interval == 0]
        # weights that nothing moves are validated as they are
        kept = {s: [w.copy() for w in weights] for s in checked}
        heads = {(i, s): np.zeros(3) for i in ids for s in range(first, last + 1)}
        if any_rows:
            shared = spark.sparkContext.broadcast([(layers[g], runs[g][i:i + share], weights[g][i:i + share], *(z[i:i + share] for z in moments[g]), adam[g][i:i + share], rate[g][i:i + share])
                                                   for g in range(len(runs)) for i in range(0, len(runs[g]), share)])
            for r in _lot(rows_of(lot), shared, val_interval).toLocalIterator():
                g, i = place[r["run"]]
                if r["step"] == 0:
                    weights[g][i], moments[g][0][i], moments[g][1][i] = r["weights"], r["m"], r["v"]
                    continue
                heads[r["run"], r["step"]] = np.array(r["head"])
                if r["weights"] is not None:
                    kept[r["step"]][g][i] = r["weights"]
            shared.destroy()
        log += [(i, "train", (s - 1) // per_epoch, s, *_means(h)) for (i, s), h in heads.items()]
        if checked:
            # the weights of a run at every validation count as a run of their own
            own = [np.array([place[int(r)][1] + sum(map(len, runs[:g])) + k * len(ids) for k in range(len(checked)) for r in runs[g]]) for g in range(len(runs))]
            shared = spark.sparkContext.broadcast(Block([(layers[g], own[g], np.concatenate([kept[s][g] for s in checked])) for g in range(len(runs))]))
            found = {r["run"]: r["values"] for r in _added(_partial_sums(held_out, shared, True, False), held_out.rdd.getNumPartitions()).toLocalIterator()}
            log += [(i, "val", (s - 1) // per_epoch, s, *_means(found.get(at + k * len(ids), [0.0] * 6)[3:])) for k, s in enumerate(checked) for at, i in enumerate(ids)]
            shared.destroy()
    return log


def _means(head: np.ndarray) -> tuple:
    loss, n, right = head
    return (float(loss / n), int(n), int(right), float(right / n)) if n else (None, 0, 0, None)
