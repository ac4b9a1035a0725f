"""Parameter sweeps as tables.

A sweep is a list of *axes* in key order.  An axis is a small table
``(pos, <columns>)``: a plain parameter has one column, a paired group
(G2) carries several columns that move together.  The grid is generated
from a distributed ``range(total)``: run ``i`` takes position
``(i div stride_k) mod size_k`` on axis ``k`` (mixed radix, last axis
fastest), and each axis is attached with an equi join on that position —
no cartesian product and no global sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwise.operators.common import bounded_broadcast

# Run states, in lifecycle order.
STATES = ("new", "running", "finished", "failed")


def axis_from_values(df: DataFrame, name: str, order=None) -> DataFrame:
    """A one-column axis ``(pos, name)`` from a column of values, positions in ``order``."""
    order = order or [name]
    w = Window.partitionBy(F.lit(name)).orderBy(*order)
    return df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).select("pos", name)


def drop_null_params(axes: list[tuple[str, DataFrame]]) -> list[tuple[str, DataFrame]]:
    """Drop parameters whose only value is NULL (a null scalar in the config)."""
    kept = []
    for name, ax in axes:
        cols = [c for c in ax.columns if c != "pos"]
        probe = ax.limit(2).collect()
        if len(probe) == 1 and all(probe[0][c] is None for c in cols):
            continue
        kept.append((name, ax))
    return kept


def grid_expand(spark: SparkSession, axes: list[tuple[str, DataFrame]],
                max_axis_rows: int = 100_000) -> DataFrame:
    """One row per combination with ``run_id`` from 1 (last axis varies fastest)."""
    axes = drop_null_params(axes)
    sizes = [ax.count() for _, ax in axes]
    total = reduce(lambda a, b: a * b, sizes, 1) if axes else 0
    grid = spark.range(total).withColumnRenamed("id", "__i")
    stride = total
    for k, ((name, ax), size) in enumerate(zip(axes, sizes)):
        stride = stride // size if size else 0
        pos = F.floor(F.col("__i") / F.lit(stride)) % F.lit(size)
        grid = grid.withColumn(f"__p{k}", pos.cast("bigint"))
        a = bounded_broadcast(ax.withColumnRenamed("pos", f"__p{k}"), max_axis_rows)
        grid = grid.join(a, f"__p{k}", "inner").drop(f"__p{k}")
    return grid.withColumn("run_id", (F.col("__i") + 1).cast("bigint")).drop("__i")


def axes_from_table(params: DataFrame, param: str = "param", ord_col: str = "ord",
                    values: str = "values", types: dict[str, str] | None = None) -> list[tuple[str, DataFrame]]:
    """Axes from a long params table ``(param, ord, values array)`` in key order.

    The table holds values of every parameter in one type (strings); ``types`` names the SQL type
    that a parameter's values are turned back into.

    Only the parameter names and their order reach the driver (one row per
    parameter); each axis is a ``posexplode`` of that parameter's list, so a
    scalar is a one-element list and an empty list yields no runs.
    """
    names = [r[param] for r in params.select(param, ord_col).distinct().orderBy(ord_col).collect()]
    axes = []
    for name in names:
        ax = (params.filter(F.col(param) == name)
                    .select(F.posexplode(values).alias("pos", name))
                    .withColumn("pos", F.col("pos").cast("bigint")))
        if types and name in types:
            ax = ax.withColumn(name, F.col(f"`{name}`").cast(types[name]))
        axes.append((name, ax))
    return axes


def paired_axis(df: DataFrame, names: list[str], order) -> DataFrame:
    """Several parameters that move together, one position per row of ``df``.

    Axes are parameter lists (bounded by the sweep definition), so numbering
    them with one window is fine.
    """
    w = Window.partitionBy(F.lit("paired")).orderBy(*order)
    return df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).select("pos", *names)


def pending_runs(runs: DataFrame, state: str = "state") -> DataFrame:
    """G3."""
    return runs.filter(F.col(state) == "new")


def run_state(transitions: DataFrame, run: str, state: str, order) -> DataFrame:
    """Current state of each run = state of its latest transition (by ``order``)."""
    order = [order] if isinstance(order, str) else list(order)
    latest = F.max_by(F.col(state), F.struct(*[F.col(c) for c in order]))
    return transitions.groupBy(run).agg(latest.alias("state"))


def default_params(configs: DataFrame, defaults: dict) -> DataFrame:
    """Missing settings take defaults (absent columns are added)."""
    out = configs
    for k, v in defaults.items():
        if k in out.columns:
            out = out.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
        else:
            out = out.withColumn(k, F.lit(v))
    return out
