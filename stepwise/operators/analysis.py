"""Sweep analysis: joins, unions, facets, per-run summaries (J1, J2, U1, U2,
A1-A5, A11, P4-P6, W3, W4, L3).

All per-run work is keyed by the run column, so a plan that smooths, masks
and summarises shares one hash partitioning on ``run_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.operators.common import bounded_broadcast, join_null_safe

# Better-direction of each known metric (E4).  Fixed values: the metric
# names and their directions as the analysis code defines them.
METRIC_DIRECTIONS = {
    "loss_mean": "lower",
    "accuracy_mean": "higher",
}


def metric_direction(name: str) -> str:
    base = name[len("smoothed_"):] if name.startswith("smoothed_") else name
    if base in METRIC_DIRECTIONS:
        return METRIC_DIRECTIONS[base]
    if "loss" in base or "perplexity" in base:
        return "lower"
    if "acc" in base:
        return "higher"
    raise KeyError(f"no better-direction known for metric {name!r}")


# ---------------------------------------------------------------- joins

def join_logs_configs(logs: DataFrame, configs: DataFrame, left: str = "run_id",
                      right: str = "id", suffixes=("_x", "_y"),
                      max_broadcast_rows: int = 200_000) -> DataFrame:
    """Inner join, null keys match each other, clashing names get suffixes.

    Keys are compared as strings.  The config side is broadcast only when a
    bounded count proves it small; otherwise both sides shuffle on the key.
    """
    clash = (set(logs.columns) & set(configs.columns)) - ({left} & {right})
    lsel = [F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in logs.columns]
    rsel = [F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in configs.columns]
    lk = left + suffixes[0] if left in clash else left
    rk = right + suffixes[1] if right in clash else right
    l = logs.select(*lsel).withColumn(lk, F.col(lk).cast("string"))
    r = configs.select(*rsel).withColumn(rk, F.col(rk).cast("string"))
    r = bounded_broadcast(r, max_broadcast_rows)
    if lk == rk:
        r = r.withColumnRenamed(rk, "__rkey")
        return l.join(r, l[lk].eqNullSafe(r["__rkey"]), "inner").drop("__rkey")
    return l.join(r, l[lk].eqNullSafe(r[rk]), "inner")


def join_summary(series: DataFrame, summary: DataFrame, on: str = "run_id") -> DataFrame:
    """Attach each run's summary row to its series (equi join on the run key; null runs match)."""
    return join_null_safe(series, summary, [on])


# ---------------------------------------------------------------- unions

def union_runs(*dfs: DataFrame) -> DataFrame:
    """Bag union by name; columns missing on one side become NULL."""
    if not dfs:
        raise ValueError("union_runs needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def tag_constant(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant column such as ``sweep_name``."""
    return df.withColumn(name, F.lit(value))


def distinct_values(df: DataFrame, col: str, cond: Column | None = None) -> DataFrame:
    """Distinct values of a column after an optional filter."""
    if cond is not None:
        df = df.filter(F.coalesce(cond, F.lit(False)))
    return df.select(col).distinct()


# ---------------------------------------------------------------- predicates

def pd_cmp(c, op: str, value) -> Column:
    """A comparison with pandas semantics: missing values compare False, except ``!=`` (True)."""
    c = F.col(c) if isinstance(c, str) else c
    v = value if isinstance(value, Column) else F.lit(value)
    expr = {">=": c >= v, ">": c > v, "<=": c <= v, "<": c < v, "==": c == v, "!=": c != v}[op]
    return F.coalesce(expr, F.lit(op == "!="))


def filter_not(df: DataFrame, cond: Column) -> DataFrame:
    """Keep the rows for which ``cond`` is not true (NULL counts as not true)."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def fill_null(df: DataFrame, values: dict) -> DataFrame:
    """P5."""
    return df.fillna(values)


def not_null_mask(df: DataFrame, col: str) -> DataFrame:
    """Rows whose metric is present (not NULL and, for doubles, not NaN)."""
    c = F.col(col)
    dtype = dict(df.dtypes)[col]
    cond = c.isNotNull() & ~F.isnan(c) if dtype in ("double", "float") else c.isNotNull()
    return df.filter(cond)


# ---------------------------------------------------------------- aggregates

def facet_series(df: DataFrame, keys, series: str, step: str, value: str,
                 keep_null: bool = False) -> DataFrame:
    """A1/A2 long form: (facet keys, series, step, value); null keys dropped unless kept."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keep_null:
        df = df.dropna(subset=keys)
    return df.select(*keys, series, step, value)


def facet_summary(df: DataFrame, keys, series: str, step: str, value: str,
                  keep_null: bool = False) -> DataFrame:
    """A1/A2 per facet: rows, series, step range and mean value of each group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keep_null:
        df = df.dropna(subset=keys)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(series).alias("n_series"),
        F.min(step).alias("first_step"),
        F.max(step).alias("last_step"),
        F.avg(value).alias("mean_value"),
    )


def distinct_count(df: DataFrame, cols, count_null: bool = False) -> DataFrame:
    """A3: number of distinct values per column (optionally counting NULL as a value)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    aggs = []
    for c in cols:
        n = F.countDistinct(c)
        if count_null:
            n = n + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))
        aggs.append(n.cast("bigint").alias(f"n_{c}"))
    return df.agg(*aggs)


def check_single_value(df: DataFrame, lhs, rhs: str) -> DataFrame:
    """A4: groups of ``lhs`` with more than one distinct ``rhs`` (violations table)."""
    lhs = [lhs] if isinstance(lhs, str) else list(lhs)
    return (df.groupBy(*lhs).agg(F.countDistinct(rhs).alias("n_values"))
              .filter(F.col("n_values") > 1))


def best_per_run(df: DataFrame, run_key, step: str, metrics: dict) -> DataFrame:
    """A5: per run and metric, the step and value of the best row.

    ``metrics`` maps column -> 'lower' | 'higher'.  NULL and NaN never win;
    ties go to the smallest step; a run without any value gets NULLs.
    One hash aggregate with partial (map-side) aggregation.
    """
    keys = [run_key] if isinstance(run_key, str) else list(run_key)
    aggs = []
    for m, better in metrics.items():
        v = F.col(m).cast("double")
        ok = v.isNotNull() & ~F.isnan(v)
        if better == "lower":
            best = F.min(F.when(ok, F.struct(v.alias("v"), F.col(step).alias("s"))))
        elif better == "higher":
            best = F.max(F.when(ok, F.struct(v.alias("v"), (-F.col(step)).alias("s"))))
        else:
            raise ValueError(f"better must be 'lower' or 'higher', got {better!r}")
        aggs.append(best.alias(f"__best_{m}"))
    out = df.groupBy(*keys).agg(*aggs)
    sel = [F.col(k) for k in keys]
    for m, better in metrics.items():
        b = F.col(f"__best_{m}")
        s = b["s"] if better == "lower" else -b["s"]
        sel += [s.alias(f"best_{m}_step"), b["v"].alias(f"best_{m}")]
    return out.select(*sel)


def elapsed(df: DataFrame, run_key, step: str, ts: str) -> DataFrame:
    """Last minus first timestamp of a run (by step), in seconds."""
    keys = [run_key] if isinstance(run_key, str) else list(run_key)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.groupBy(*keys).agg(
        ((F.max_by(t, F.col(step)) - F.min_by(t, F.col(step))) / 1e6).alias("elapsed_sec"))


# ---------------------------------------------------------------- windows

def nth_from_end(df: DataFrame, keys, order: str, col: str, n: int = 31,
                 skew_safe: bool = False) -> DataFrame:
    """Per series, the value ``n`` rows from the end (1 = last row)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if skew_safe:
        from stepwise.operators.smooth import run_positions
        pos = run_positions(df, keys, order)
        return (pos.filter(F.col("__n") - F.col("__rn") == n)
                   .select(*keys, F.col(order).alias(f"{order}_at"), F.col(col).alias(f"{col}_at")))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return (df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == n)
              .select(*keys, F.col(order).alias(f"{order}_at"), F.col(col).alias(f"{col}_at")))


def first_in_group(df: DataFrame, keys, order: str, cols) -> DataFrame:
    """Columns of the first row (smallest ``order``) of each group, one aggregate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [cols] if isinstance(cols, str) else list(cols)
    first = F.min(F.struct(F.col(order).alias("__o"), *[F.col(c).alias(c) for c in cols]))
    return (df.groupBy(*keys).agg(first.alias("__f"))
              .select(*keys, *[F.col("__f")[c].alias(f"first_{c}") for c in cols]))


# ---------------------------------------------------------------- reports

def report_head(df: DataFrame, cond: Column | None, cols, order, n: int = 30) -> DataFrame:
    """L3: filter, project, order and keep the first ``n`` rows (a top-k report)."""
    if cond is not None:
        df = df.filter(F.coalesce(cond, F.lit(False)))
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return select_cols(df, cols).orderBy(*order).limit(n)


def apply_transforms(df: DataFrame, transforms) -> DataFrame:
    """An ordered chain of DataFrame -> DataFrame transforms (folded with ``transform``)."""
    return reduce(lambda acc, t: acc.transform(t), transforms, df)


def select_cols(df: DataFrame, cols) -> DataFrame:
    """P11."""
    return df.select(*cols)
