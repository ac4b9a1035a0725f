"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of rows that are broadcast at most.
MAX_BROADCAST_BYTES = 64 << 20
_FIXED = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def row_bytes(df: DataFrame):
    """About the bytes of a row: fixed sizes, and the length of text, binary and (as JSON) nested values."""
    total = F.lit(8)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind.startswith(("array", "struct", "map")):
            total = total + F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + _FIXED.get(kind, 8)
    return total


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if a bounded probe proves that it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    The probe reads ``max_rows + 1`` rows at most.  Above a bound the DataFrame is returned
    unchanged and the join shuffles both sides (AQE may still convert it
    from runtime statistics).
    """
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


#: Rows of the longest run that one task sorts; logs with longer runs take the paths that split runs.
HOT_RUN_ROWS = 1 << 22


def splits_runs(df: DataFrame, keys, skew_safe: bool | None) -> bool:
    """``skew_safe`` as given; if None, whether the longest run, counted over the key columns, has more than ``HOT_RUN_ROWS`` rows."""
    if skew_safe is not None:
        return skew_safe
    keys = [keys] if isinstance(keys, str) else list(keys)
    longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (longest or 0) > HOT_RUN_ROWS


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal or both-null keys; the keys come from ``left``."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = one if cond is None else cond & one
    return left.join(other, cond, how).drop(*[f"__r_{k}" for k in keys])


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double/float column (for engine-independent comparison)."""
    sel = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("double", "float"):
            sel.append((F.round(c.cast("double"), places) + F.lit(0.0)).alias(name))
        else:
            sel.append(c.alias(name))
    return df.select(*sel)


def parallelism(spark) -> int:
    """Task slots of the cluster (total executor cores)."""
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash-repartition ``df`` to the cluster's parallelism if it has fewer partitions.

    Large inputs already arrive in many file splits and are left alone; a
    table stored as one big row group would otherwise run all per-row work
    (regex tokenisation, Python UDFs) in a single task.
    """
    target = parallelism(df.sparkSession)
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


def range_parts(spark) -> int:
    """Partitions for range-partitioned passes: at least 4 per task slot and at
    least the configured shuffle partitions (sized for the cluster's data)."""
    return max(parallelism(spark) * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
