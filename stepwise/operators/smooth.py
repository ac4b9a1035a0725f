"""Savitzky-Golay smoothing per run (W2) and the edge mask.

A degree-``d`` least-squares polynomial fit over a ``w``-row block is a
linear map of the block's moments, the sums of value times powers of the
position.  Rows in the first/last ``w // 2`` positions of a run use the block at
the run edge (the polynomial-fit edge rule); the others use the centred block.

Spark form: window sums over the ``w`` rows around each row, and over the first
and last ``w`` rows of the run, all in one window spec partitioned by the run keys and
ordered by step; no values are collected.  Positions are taken relative to the
nearest of two interleaved rows of origins, one of which is never crossed by a block, so powers stay
small in runs of any length; the moments are then moved to the block's centre.
All metrics share the window, so the whole operator is a single shuffle on the run keys.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.operators.common import bounded_broadcast, join_null_safe, range_parts, splits_runs
from stepwise.session import ensure_checkpoint_dir

WINDOW = 51
DEGREE = 3
EDGE_MARGIN = 30


@lru_cache(maxsize=8)
def fit_matrix(window: int = WINDOW, degree: int = DEGREE) -> tuple[tuple[float, ...], ...]:
    """M with fitted(p) = sum of p^a M[a][b] moment_b, positions relative to the block's centre."""
    half = window // 2
    v = np.vander(np.arange(-half, half + 1, dtype=np.float64), degree + 1, increasing=True)
    return tuple(tuple(float(x) for x in row) for row in np.linalg.inv(v.T @ v))


def _power(x: Column, u: Column, d: int) -> Column:
    """x * u ** d by multiplication."""
    for _ in range(d):
        x = x * u
    return x


def _fitted(moments: list[Column], origin: Column, centre: Column, at: Column, window: int) -> Column:
    """The fit at position ``at`` of the block around ``centre``, from its moments about ``origin``."""
    off = (centre - origin).cast("double")
    own = [sum((_power(F.lit(float(math.comb(d, k))) * moments[k], -off, d - k) for k in range(1, d + 1)), _power(moments[0], -off, d)) if d else moments[0]
           for d in range(len(moments))]
    p = (at - centre).cast("double")
    m = fit_matrix(window, len(moments) - 1)
    rows = [sum((F.lit(m[a][b]) * own[b] for b in range(1, len(own))), F.lit(m[a][0]) * own[0]) for a in range(len(own))]
    return sum((_power(rows[a], p, a) for a in range(1, len(own))), rows[0])


def _smoothed(df: DataFrame, cols, w, whole, rn: Column, n: Column, window: int, degree: int, prefix: str) -> DataFrame:
    """``df`` with the smoothed columns; ``rn`` and ``n`` are a row's place in its run and the run's length, as columns of ``df``.

    ``w`` is the ordered window, ``whole`` its whole partition, which holds all blocks of the rows asked for.
    """
    half, span = window // 2, 4 * window
    near = w.rowsBetween(-half, half)
    # origins every ``span`` rows, and half-way between; a block fits between two of one kind
    origins = [(F.floor(rn / span) * span + span // 2), (F.floor((rn + span // 2) / span) * span)]
    last = n - window
    tmp, powers, sums, keep = "__m", {}, {}, df.columns
    for i, c in enumerate(cols):
        y = F.col(f"`{c}`").cast("double")
        for d in range(degree + 1):
            # the terms are columns before the window, so a frame only adds them up
            for kind, u in (("0", rn - origins[0]), ("1", rn - origins[1]), ("first", rn - half), ("last", rn - last - half))[d == 0:]:
                powers[f"{tmp}p{i}_{d}_{kind}"] = _power(y, u.cast("double"), d)
            for kind in ("0", "1")[d == 0:]:
                sums[f"{tmp}{i}_{d}_{kind}"] = F.sum(f"{tmp}p{i}_{d}_{kind}").over(near)
            sums[f"{tmp}{i}_{d}_first"] = F.sum(F.when(rn < window, F.col(f"{tmp}p{i}_{d}_first"))).over(whole)
            sums[f"{tmp}{i}_{d}_last"] = F.sum(F.when(rn >= last, F.col(f"{tmp}p{i}_{d}_last"))).over(whole)
        sums[f"{tmp}{i}_n"] = F.count(y).over(near)
        sums[f"{tmp}{i}_n_first"] = F.count(F.when(rn < window, y)).over(whole)
        sums[f"{tmp}{i}_n_last"] = F.count(F.when(rn >= last, y)).over(whole)
    out = df.withColumns(powers).withColumns(sums)
    shift = rn % span
    whole_in_first = (shift >= half) & (shift < span - half)
    for i, c in enumerate(cols):
        m = lambda d, kind: F.col(f"{tmp}{i}_{d}_{kind}")  # noqa: B023, E731
        near_kind = lambda kind: [m(0, 1), *(m(d, kind) for d in range(1, degree + 1))]  # noqa: B023, E731
        inner = F.when(whole_in_first, _fitted(near_kind(0), origins[0], rn, rn, window)).otherwise(_fitted(near_kind(1), origins[1], rn, rn, window))
        edge = lambda kind, at: _fitted([m(d, kind) for d in range(degree + 1)], F.lit(0), F.lit(0), at, window)  # noqa: B023, E731
        value = (F.when(rn < half, F.when(F.col(f"{tmp}{i}_n_first") == window, edge("first", rn - half)))
                  .when(rn >= n - half, F.when(F.col(f"{tmp}{i}_n_last") == window, edge("last", rn - last - half)))
                  .otherwise(F.when(F.col(f"{tmp}{i}_n") == window, inner)))
        out = out.withColumn(prefix + c, F.when(n >= window, value))
    return out.select(*[F.col(f"`{c}`") for c in keep if c not in {prefix + x for x in cols}], *[F.col(f"`{prefix + c}`") for c in cols])


def savgol_smooth(df: DataFrame, keys, order: str, cols, window: int = WINDOW,
                  degree: int = DEGREE, prefix: str = "smoothed_") -> DataFrame:
    """Add ``smoothed_<col>`` for every col present; NULL for runs shorter than ``window``.

    A null or NaN inside the fitted block makes that row's smoothed value
    NULL/NaN (the fit is undefined there).
    """
    if window % 2 == 0 or window <= degree:
        raise ValueError("window must be odd and larger than degree")
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({"__sg_rn": F.row_number().over(w) - 1, "__sg_n": F.count(F.lit(1)).over(whole).cast("int")})
    return _smoothed(out, cols, w, whole, F.col("__sg_rn"), F.col("__sg_n"), window, degree, prefix).drop("__sg_rn", "__sg_n")


def run_positions(df: DataFrame, keys, order) -> DataFrame:
    """Add ``__rn`` (0-based position in its run) and ``__n`` (run length) without a
    window partitioned by the run: range partitions split hot runs, and a small
    per-(run, partition) slice table carries the offsets."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = (df.repartitionByRange(range_parts(spark), *keys, *order)
               .withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True))
    w = Window.partitionBy("__pid", *keys).orderBy(*order)
    local = parts.withColumn("__lrn", F.row_number().over(w) - 1)
    slices = local.groupBy(*keys, "__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    sw = Window.partitionBy(*keys).orderBy("__pid")
    slices = slices.select(*keys, "__pid",
                           F.coalesce(F.sum("__cnt").over(sw.rowsBetween(Window.unboundedPreceding, -1)),
                                      F.lit(0)).alias("__off"),
                           F.sum("__cnt").over(sw.rowsBetween(Window.unboundedPreceding,
                                                              Window.unboundedFollowing)).alias("__n"))
    j = join_null_safe(local, bounded_broadcast(slices, 500_000), [*keys, "__pid"])
    return (j.withColumn("__rn", (F.col("__off") + F.col("__lrn")).cast("int"))
             .withColumn("__n", F.col("__n").cast("int"))
             .drop("__pid", "__lrn", "__off"))


def savgol_smooth_skew_safe(df: DataFrame, keys, order: str, cols, window: int = WINDOW,
                            degree: int = DEGREE, prefix: str = "smoothed_",
                            bucket_rows: int = 4096) -> DataFrame:
    """W2 for runs of any length: rows are bucketed by position (``bucket_rows``
    per bucket) and the ``window - 1`` rows at each bucket edge are copied into
    the neighbouring bucket, so every window partition is (run, bucket)-sized.
    Same values as ``savgol_smooth``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    halo = window - 1
    if bucket_rows <= halo:
        raise ValueError("bucket_rows must exceed window - 1")
    pos = run_positions(df, keys, order)
    home = F.floor(F.col("__rn") / bucket_rows).cast("int")
    off = F.col("__rn") % bucket_rows
    copies = F.array_compact(F.array(
        home, F.when(off < halo, home - 1), F.when(off >= bucket_rows - halo, home + 1)))
    ex = (pos.withColumn("__home", home)
             .withColumn("__bucket", F.explode(copies))
             .filter(F.col("__bucket") >= 0))
    w = Window.partitionBy(*keys, "__bucket").orderBy("__rn")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = _smoothed(ex, cols, w, whole, F.col("__rn"), F.col("__n"), window, degree, prefix)
    return out.filter(F.col("__bucket") == F.col("__home")).drop("__rn", "__n", "__home", "__bucket")


def mask_outside_agg(df: DataFrame, cols, keys, step: str = "step", margin: int = EDGE_MARGIN) -> DataFrame:
    """P7 with the run maximum from a partially aggregated group-by (no run-keyed window)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    mx = bounded_broadcast(df.groupBy(*keys).agg(F.max(step).alias("__mx")), 500_000)
    out = join_null_safe(df, mx, keys)
    for c in cols:
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(step).between(F.lit(margin), F.col("__mx") - margin), F.col(c)))
    return out.drop("__mx")


def mask_outside(df: DataFrame, cols, keys, step: str = "step",
                 margin: int = EDGE_MARGIN) -> DataFrame:
    """NULL out ``cols`` where step is outside [margin, max(step) - margin] of its run."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    run_max = F.max(step).over(Window.partitionBy(*keys))
    out = df.withColumn("__mx", run_max)
    for c in cols:
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(step).between(F.lit(margin), F.col("__mx") - margin), F.col(c)))
    return out.drop("__mx")


def smooth_and_mask(df: DataFrame, keys, cols, step: str = "step", window: int = WINDOW,
                    degree: int = DEGREE, margin: int = EDGE_MARGIN, skew_safe: bool | None = None) -> DataFrame:
    """The per-run read path of a sweep: W2 followed by P7 on the smoothed columns.

    ``skew_safe`` avoids every window partitioned by the run alone, so a run
    holding a large share of all rows is spread over many tasks; None measures the runs and decides.
    """
    skew_safe = splits_runs(df, keys, skew_safe)
    present = [c for c in cols if c in df.columns]
    if skew_safe:
        out = savgol_smooth_skew_safe(df, keys, step, present, window, degree)
        return mask_outside_agg(out, [f"smoothed_{c}" for c in present], keys, step, margin)
    out = savgol_smooth(df, keys, step, present, window, degree)
    return mask_outside(out, [f"smoothed_{c}" for c in present], keys, step, margin)
