"""Metrics as mergeable states (E1): one definition for batch, split runs and streams.

A ``StateMetric`` says what it needs of a record (``inputs``, Spark columns),
what it keeps of a set of records (``state``, named numbers), how the states of
many segments of records are made at once with array operations (``update``),
how two states become one (``merge``), and what is reported (``finish``, Spark columns).

``chunk_states`` runs any number of them over the records of a log in one
Arrow pass: every batch holds many chunks, cut by offsets.  A chunk that
reaches over several batches, or over several tasks when long runs are split,
has several partial states, which are merged in order afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.session import ship_package

#: Values of one input: numbers (0 where null) and whether each is there.
Values = tuple[np.ndarray, np.ndarray]
State = dict[str, np.ndarray]


@dataclass(frozen=True)
class StateMetric:
    """A metric by its mergeable state.

    ``inputs``: name -> (column maker, ``bigint`` or ``double``); ``state``: name -> ``bigint`` or ``double``.
    ``update(inputs, begin)`` gives one state for each run of records that starts at ``begin``;
    ``merge(a, b)`` joins states place by place, a before b; ``finish(col)`` gives the result columns from ``col(state name)``.
    """

    name: str
    inputs: dict[str, tuple[Callable[[], Column], str]]
    state: dict[str, str]
    update: Callable[[dict[str, Values], np.ndarray], State]
    merge: Callable[[State, State], State]
    finish: Callable[[Callable[[str], Column]], list[Column]]

    def input_columns(self) -> list[Column]:
        """Every input with nulls as 0, and beside it whether it is there."""
        out = []
        for name, (make, kind) in self.inputs.items():
            value = make().cast(kind)
            out += [F.coalesce(value, F.lit(0).cast(kind)).alias(f"in__{self.name}_{name}"), value.isNotNull().alias(f"in__{self.name}_{name}_is")]
        return out

    def read(self, column: Callable[[str], np.ndarray]) -> dict[str, Values]:
        return {n: (column(f"in__{self.name}_{n}"), column(f"in__{self.name}_{n}_is").astype(bool)) for n in self.inputs}

    def state_names(self) -> list[str]:
        return [f"state__{self.name}_{n}" for n in self.state]

    def results(self, column: Callable[[str], Column] = F.col) -> list[Column]:
        return self.finish(lambda n: column(f"state__{self.name}_{n}"))


def ends_of(begin: np.ndarray, rows: int) -> np.ndarray:
    return np.append(begin[1:], rows)


def mean_and_spread(values: Values, begin: np.ndarray) -> State:
    """Count, mean and sum of squared differences from it, of the values that are there."""
    x, there = values
    n = np.add.reduceat(there.astype(np.int64), begin)
    with np.errstate(all="ignore"):
        mean = np.add.reduceat(np.where(there, x, 0.0), begin) / n
        off = np.where(there, x - np.repeat(mean, ends_of(begin, len(x)) - begin), 0.0)
        m2 = np.add.reduceat(off * off, begin)
    return {"n": n, "mean": np.where(n > 0, mean, 0.0), "m2": np.where(n > 0, m2, 0.0)}


def merge_mean_and_spread(a: State, b: State) -> State:
    n = a["n"] + b["n"]
    with np.errstate(all="ignore"):
        mean = (a["mean"] * a["n"] + b["mean"] * b["n"]) / n
        m2 = a["m2"] + b["m2"] + (b["mean"] - a["mean"]) ** 2 * a["n"] * b["n"] / n
    one = lambda x: np.where(b["n"] == 0, a[x], b[x])
    both = (a["n"] > 0) & (b["n"] > 0)
    return {"n": n, "mean": np.where(both, mean, one("mean")), "m2": np.where(both, m2, one("m2"))}


def add_states(a: State, b: State) -> State:
    """The merge of states that are sums."""
    return {k: a[k] + b[k] for k in a}


def sums(values: Values, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.where(values[1], values[0], 0), begin)


def _kind(name: str) -> pa.DataType:
    return pa.int64() if name == "bigint" else pa.float64()


def changes(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """First rows of the runs of rows with equal keys (the first ``n_keys`` columns; nulls are equal)."""
    if not len(batch):
        return np.zeros(0, np.int64)
    new = np.zeros(len(batch), bool)
    new[0] = True
    for i in range(n_keys):
        codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def chunk_states(records: DataFrame, keys: list[str], seq: str, last: list[str], metrics: list[StateMetric]) -> DataFrame:
    """One row for each value of ``keys``: n_steps, the last record's ``last`` columns, every metric's state.

    Records of a chunk may lie in several partitions; each partition's are sorted here.
    """
    ship_package(records.sparkSession)
    inputs = [c for m in metrics for c in m.input_columns()]
    rows = records.select(*keys, F.col(seq).alias("__seq"), F.struct(*last).alias("__last"), *inputs).sortWithinPartitions(*keys, "__seq")
    kinds = dict(rows.dtypes)
    states = {s: k for m in metrics for s, k in zip(m.state_names(), m.state.values())}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"__seq {kinds['__seq']}", f"__last {kinds['__last']}", "n_steps bigint", *(f"{s} {k}" for s, k in states.items())])

    def run(batches):
        for batch in batches:
            begin = changes(batch, len(keys))
            if not len(begin):
                continue
            end = ends_of(begin, len(batch))
            place = {n: i for i, n in enumerate(batch.schema.names)}
            found = [m.update(m.read(lambda n: batch.column(place[n]).to_numpy(zero_copy_only=False)), begin) for m in metrics]
            at = pa.array(end - 1)
            out = [*(batch.column(i).take(pa.array(begin)) for i in range(len(keys))), batch.column(place["__seq"]).take(at), batch.column(place["__last"]).take(at), pa.array(end - begin)]
            out += [pa.array(f[s]).cast(_kind(k)) for m, f in zip(metrics, found) for s, k in m.state.items()]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "__seq", "__last", "n_steps", *states])

    pieces = rows.mapInArrow(run, schema).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__seq", "n_steps", *states))).alias("__pieces"),
                                                           F.max_by("__last", "__seq").alias("__last"))
    if not metrics:
        n = F.aggregate("__pieces", F.lit(0).cast("bigint"), lambda a, x: a + x["n_steps"])
        return pieces.select(*keys, "__last", n.alias("n_steps"))
    whole = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"__last {kinds['__last']}", "n_steps bigint", *(f"{s} {k}" for s, k in states.items())])

    def merge(batches):
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(len(keys))
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            flat = lists.flatten()
            field = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("n_steps", *states)}
            done = {n: v[first].copy() for n, v in field.items()}
            for j in range(1, int(size.max())):
                who = np.flatnonzero(size > j)
                at = first[who] + j
                done["n_steps"][who] += field["n_steps"][at]
                for m in metrics:
                    names = dict(zip(m.state, m.state_names()))
                    got = m.merge({k: done[n][who] for k, n in names.items()}, {k: field[n][at] for k, n in names.items()})
                    for k, n in names.items():
                        done[n][who] = got[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), batch.column(len(keys) + 1), *(pa.array(v) for v in done.values())],
                                             names=[*keys, "__last", *done])

    return pieces.select(*keys, "__pieces", "__last").mapInArrow(merge, whole)


def python_by_chunk(records: DataFrame, keys: list[str], seq: str, fields: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn`` (records of one chunk as pandas, in order -> dict) for every value of ``keys``.

    All records of a chunk must be in one partition.  A batch is turned to pandas once and cut by offsets; the last
    chunk of a batch waits for the next one.
    """
    ship_package(records.sparkSession)
    out_cols = [f.split()[0] for f in schema.split(",")]
    rows = records.select(*keys, F.col(seq).alias("__seq"), *[F.col(f).alias(f"__f_{f}") for f in fields]).sortWithinPartitions(*keys, "__seq")
    kinds = dict(rows.dtypes)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def results(table: pa.RecordBatch, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            pdf = table.select([f"__f_{f}" for f in fields]).rename_columns(fields).to_pandas()
            found = [fn(pdf.iloc[b:e].reset_index(drop=True)) for b, e in zip(begin, end)]
            at = pa.array(begin)
            values = pa.RecordBatch.from_pylist([{c: f.get(c) for c in out_cols} for f in found], schema=wanted) if found else wanted.empty_table().to_batches()[0]
            return pa.RecordBatch.from_arrays([*(table.column(i).take(at) for i in range(len(keys))), *values.columns], names=[*keys, *out_cols])

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            begin = changes(table, len(keys))
            if len(begin) > 1:
                yield results(table, begin[:-1], begin[1:])
            held = [table.slice(begin[-1])]
        if held:
            table = held[0]
            yield results(pa.Table.from_batches([table]).combine_chunks().to_batches()[0], np.zeros(1, np.int64), np.array([len(table)]))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)
