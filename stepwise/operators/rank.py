"""Exact global ranks without a one-partition sort (K1) and what builds on
them: seeded splits (X1), batches (X2), materialisation (X3), index subsets
(X4), step schedules (W5), per-epoch shuffles (W6), stride samples (P8),
head / range subsets (P9) and flattened label batches (F6).

Two rank schemes, both exact and deterministic:

* ``hash_rank``: rows are ordered by ``md5(seed)`` (ties by the seed string).
  The first three hex digits split rows into 4,096 buckets of equal expected
  size; per-bucket counts (a tiny table) give each bucket its offset, and a
  ``row_number`` inside each bucket finishes the rank.  Because the seed is
  unique per row, a hot key cannot pile up in one bucket.
* ``ordered_rank``: rows get range buckets of the (unique) order columns by
  fixed splitters (see ``ranges``), are counted per bucket, and numbered inside
  buckets plus offsets.  Nothing is stored; the input is read once for the sample, once
  for the counts and once for the rows, so it must be the same every time.  Range
  buckets on a unique order split hot key values too.  Order columns that are
  expressions or of nested types are range-partitioned and checkpointed instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.operators.common import bounded_broadcast, join_null_safe, range_parts
from stepwise.operators.ranges import sortable, splitters
from stepwise.session import ensure_checkpoint_dir

BUCKET_DIGITS = 3
MAX_OFFSET_ROWS = 1_000_000


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def _with_offsets(df: DataFrame, part: list[str], group: list[str], out: str,
                  order: list[Column], parts: int) -> DataFrame:
    """rank = rows of the same group in earlier parts + row_number inside the part.

    There are at most ``parts`` parts: without groups this bounds the broadcast offsets, with groups a
    count of them does.
    """
    counts = df.groupBy(*group, *part).agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.partitionBy(*group).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, *part, F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"))
    if not group and parts <= MAX_OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    else:
        offsets = bounded_broadcast(offsets, MAX_OFFSET_ROWS)
    keys = group + part
    inner = Window.partitionBy(*keys).orderBy(*order)
    ranked = join_null_safe(df, offsets, keys)
    return ranked.withColumn(out, (F.col("__off") + F.row_number().over(inner) - 1).cast("bigint")).drop("__off")


def bucket_digits(n_rows: int, rows_per_bucket: int = 1_000_000) -> int:
    """Hex digits of the md5 prefix so a bucket holds about ``rows_per_bucket`` rows (3..8)."""
    d = BUCKET_DIGITS
    while d < 8 and n_rows > rows_per_bucket * 16 ** d:
        d += 1
    return d


def hash_rank(df: DataFrame, seed: Column, group=None, out: str = "rank",
              n_rows: int | None = None) -> DataFrame:
    """K1, hash order: 0-based rank by (md5(seed), seed) within ``group``; seed must be unique.

    Rows without a seed are kept: they are seeded with a hash of their columns, so that many of
    them spread over the buckets; null groups are a group.

    The number of buckets grows with the row count (counted if not given), so
    the per-bucket sort stays about a million rows at any scale.
    """
    group = [c if isinstance(c, str) else c for c in _cols(group)]
    digits = bucket_digits(df.count() if n_rows is None else n_rows)
    plain = [F.col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    s = F.coalesce(seed.cast("string"), F.concat(F.lit("\0null:"), F.xxhash64(*plain).cast("string")))
    h = F.md5(s)
    tmp = (df.withColumn("__seed", s).withColumn("__h", h)
             .withColumn("__b", F.conv(F.substring("__h", 1, digits), 16, 10).cast("bigint")))
    ranked = _with_offsets(tmp, ["__b"], group, out, [F.col("__h"), F.col("__seed")], 16 ** digits)
    return ranked.drop("__seed", "__h", "__b")


def ordered_rank(df: DataFrame, order, group=None, out: str = "rank",
                 partitions: int | None = None) -> DataFrame:
    """K1, key order: 0-based rank by ``order`` (unique within group) within ``group``."""
    order, group = _cols(order), _cols(group)
    spark = df.sparkSession
    if sortable(df, [*group, *order]):
        cut = splitters(df, [*group, *order], partitions or range_parts(spark))
        return _with_offsets(cut.bucket_of(df, "__pid"), ["__pid"], group, out, [F.col(c) for c in order], cut.buckets).drop("__pid")
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = (df.repartitionByRange(n, *group, *order)
               .withColumn("__pid", F.spark_partition_id())
               .checkpoint(eager=True))
    return _with_offsets(parts, ["__pid"], group, out, [F.col(c) if isinstance(c, str) else c for c in order], n) \
        .drop("__pid")


# ---------------------------------------------------------------- X1

def split_sizes(n: int, fractions) -> list[int]:
    """Exact part sizes: floor(n*f) per part, the remainder part round(1 - sum f, 3),
    leftovers dealt one by one from the first part."""
    fractions = list(fractions)
    rest = round(1 - sum(fractions), 3)
    if rest < 0:
        raise ValueError(f"fractions sum to more than 1: {fractions}")
    fr = fractions + [rest]
    sizes = [math.floor(n * f) for f in fr]
    for i in range(n - sum(sizes)):
        sizes[i % len(sizes)] += 1
    return sizes


def random_split(df: DataFrame, id_col: str, fractions, names=None, seed: int = 42,
                 keep_remainder: bool = False) -> DataFrame:
    """Seeded exact split; adds ``split`` (names, default part0..), drops the remainder part."""
    fractions = list(fractions)
    names = list(names) if names else [f"part{i}" for i in range(len(fractions))]
    n = df.count()
    sizes = split_sizes(n, fractions)
    ranked = hash_rank(df, F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), out="__r", n_rows=n)
    expr, start = None, 0
    labels = names + ["remainder"]
    for name, size in zip(labels, sizes):
        cond = (F.col("__r") >= start) & (F.col("__r") < start + size)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        start += size
    out = ranked.withColumn("split", expr).drop("__r")
    return out if keep_remainder else out.filter(F.col("split") != "remainder")


# ---------------------------------------------------------------- X2, W5, W6

def make_batches(df: DataFrame, order, batch_size: int, shuffle_seed: Column | None = None,
                 group=None) -> DataFrame:
    """Fixed-size batches (short last batch kept), in ``order`` or shuffled by a seed."""
    if shuffle_seed is not None:
        ranked = hash_rank(df, shuffle_seed, group, out="__r")
    else:
        ranked = ordered_rank(df, order, group, out="__r")
    return ranked.withColumn("batch", F.floor(F.col("__r") / batch_size).cast("bigint")) \
                 .withColumnRenamed("__r", "position")


def epoch_shuffle(df: DataFrame, id_col: str, epochs: int, seed: int = 42) -> DataFrame:
    """One copy per epoch (from 0, as in W5), reshuffled per epoch: rank by md5(seed:epoch:id)."""
    if epochs < 1:
        raise ValueError("epochs must be >= 1")
    ex = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    s = F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(id_col).cast("string"))
    return hash_rank(ex, s, group="epoch", out="position")


def step_schedule(n_rows: int, epochs: int, batch_size: int, val_interval: int, spark) -> DataFrame:
    """One row per (epoch, batch): global step, samples in the batch, validate-after flag.

    The (epoch, batch) grid comes from a distributed ``range``, never from one
    long array in a single row.
    """
    per_epoch = math.ceil(n_rows / batch_size) if n_rows else 0
    grid = spark.range(epochs * per_epoch)
    epoch = F.floor(F.col("id") / F.lit(max(per_epoch, 1))).cast("bigint")
    batch = (F.col("id") % F.lit(max(per_epoch, 1))).cast("int")
    step = F.col("id") + 1
    size = F.least(F.lit(batch_size), F.lit(n_rows) - batch * batch_size)
    return grid.select(epoch.alias("epoch"), batch.alias("batch"), step.cast("bigint").alias("step"),
                       size.cast("bigint").alias("n_samples"), ((step % val_interval) == 0).alias("validate"))


def schedule_for(df: DataFrame, epochs: int, batch_size: int, val_interval: int) -> DataFrame:
    """W5 over a table: the schedule of its row count."""
    return step_schedule(df.count(), epochs, batch_size, val_interval, df.sparkSession)


# ---------------------------------------------------------------- X3, X4

def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Compute a transformed split once and keep it (reliable checkpoint, or a parquet table)."""
    if path is None:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def subset_by_index(df: DataFrame, indices: DataFrame, key: str, index_col: str | None = None) -> DataFrame:
    """Rows whose key is in an index table (left semi join)."""
    idx = indices.select(F.col(index_col or key).alias(key)).distinct()
    return df.join(idx, key, "left_semi")


# ---------------------------------------------------------------- P8, P9

def stride_sample(df: DataFrame, order, n: int) -> DataFrame:
    """Every n-th row in ``order`` starting with the first."""
    return ordered_rank(df, order, out="__r").filter(F.col("__r") % n == 0).drop("__r")


def head_n(df: DataFrame, order, n: int) -> DataFrame:
    """First n rows in ``order`` (a top-k: TakeOrderedAndProject)."""
    return df.orderBy(*_cols(order)).limit(n)


def range_subset(df: DataFrame, order, start: int, stop: int) -> DataFrame:
    """Rows [start, stop) in ``order``.

    Only the range buckets that these ranks lie in are read beyond their order columns, sorted and numbered.
    """
    order = _cols(order)
    if not sortable(df, order):
        return ordered_rank(df, order, out="__r").filter(F.col("__r").between(start, stop - 1)).drop("__r")
    cut = splitters(df, order, range_parts(df.sparkSession))
    counts = {r["__b"]: r["count"] for r in cut.bucket_of(df.select(*order), "__b").groupBy("__b").count().collect()}
    before, own = 0, {}
    for b in sorted(counts):
        if before < stop and before + counts[b] > start:
            own[b] = before
        before += counts[b]
    if not own or start >= stop:
        return df.limit(0)
    bounds = cut.scan_bounds(min(own), max(own))
    some = cut.bucket_of(df if bounds is None else df.where(bounds), "__b").where(F.col("__b").isin(list(own)))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), F.col("__b"))
    rank = offset + F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return some.withColumn("__r", rank).where(F.col("__r").between(start, stop - 1)).drop("__r", "__b")


# ---------------------------------------------------------------- E3, F6

def collate(df: DataFrame, batch: str, order: str, cols) -> DataFrame:
    """One row per batch: ``n_rows`` and, for each column, its values as an array in ``order``.

    A group is a batch, so its size is the batch size whatever the input.
    """
    cols = _cols(cols)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *[F.col(c).alias(c) for c in cols])))
    g = df.groupBy(batch).agg(rows.alias("__rows"))
    arrays = [F.col("__rows").getField(c).alias(c) for c in cols]
    return g.select(batch, F.size("__rows").cast("int").alias("n_rows"), *arrays)



def flatten_labels(df: DataFrame, batch: str, pos: str, ids: str, shift: bool = False) -> DataFrame:
    """one flat row-major label array per batch (rows x seq_len); optional shift by one."""
    g = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(ids).alias("v"))))
                              .alias("__rows"))
    flat = F.flatten(F.transform("__rows", lambda x: x["v"]))
    if shift:
        flat = F.slice(flat, 2, F.size(flat))
    return g.select(batch, F.size("__rows").cast("int").alias("n_rows"), flat.alias("labels"))
