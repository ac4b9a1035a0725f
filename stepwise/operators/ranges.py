"""Range buckets by fixed splitters: a total order over a table without moving or storing its rows (K1 in key order).

A sample of the order keys, chosen by their hash, gives the splitters; it and so
the buckets depend on the data alone, not on partitions or on the run.  A row's
bucket is found by two short searches, among the coarse splitters (constants of the plan)
and among the fine ones of its coarse bucket (a small broadcast table).  Any
splitters give exact ranks, since rows are counted by bucket; good ones make the buckets even.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets at most; sampled keys for each; the hash range that the sample is a share of.
MOST_BUCKETS, SAMPLED, HASH_RANGE = 1 << 14, 16, 1 << 30
#: Types whose values come back unchanged from text.
PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "string", "boolean", "date", "timestamp", "timestamp_ntz")


def sortable(df: DataFrame, cols: list) -> bool:
    """Whether ``cols`` are column names of types that splitters can be made of."""
    kinds = dict(df.dtypes)
    return all(isinstance(c, str) and (kinds.get(c) in PLAIN or kinds.get(c, "").startswith("decimal")) for c in cols)


@dataclass(frozen=True)
class Splitters:
    """Ascending splitters of the order columns; bucket i has the keys from splitter i - 1 (inclusive) up to splitter i."""

    cols: list[str]
    kinds: list[str]
    values: list[tuple]  # as text, None for null

    @property
    def buckets(self) -> int:
        return len(self.values) + 1

    def literal(self, i: int) -> Column:
        return F.struct(*[F.lit(v).cast(k).alias(c) for c, k, v in zip(self.cols, self.kinds, self.values[i])])

    def bucket_of(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the bucket of every row; nulls come first, as in an ascending order."""
        key = F.struct(*[F.col(c) for c in self.cols])
        if not self.values:
            return df.withColumn(name, F.lit(0))
        wide = math.ceil(math.sqrt(self.buckets))
        count = lambda splitters: F.size(F.filter(splitters, lambda s: s <= key))
        coarse = count(F.array(*[self.literal(i) for i in range(wide - 1, len(self.values), wide)]))
        if self.buckets <= 16:
            return df.withColumn(name, count(F.array(*[self.literal(i) for i in range(len(self.values))])).cast("int"))
        spark = df.sparkSession
        n = len(self.values)
        table = spark.createDataFrame(pa.table({"__coarse": pa.array([i // wide for i in range(n)], pa.int32()),
                                                **{f"c{j}": pa.array([v[j] for v in self.values], pa.string()) for j in range(len(self.cols))}}))
        fine = table.groupBy("__coarse").agg(F.collect_list(F.struct(*[F.col(f"c{i}").cast(k).alias(c) for i, (c, k) in enumerate(zip(self.cols, self.kinds))])).alias("__fine"))
        # a coarse bucket's own last splitter is its upper end, so no key of it reaches that one
        found = df.withColumn("__coarse", coarse).join(F.broadcast(fine), "__coarse", "left")
        inner = F.when(F.col("__fine").isNull(), 0).otherwise(count(F.col("__fine")))
        return found.withColumn(name, (F.col("__coarse") * wide + inner).cast("int")).drop("__coarse", "__fine")

    def scan_bounds(self, first: int, last: int) -> Column | None:
        """A condition on the first order column that all rows of the buckets meet, for the scan to prune by."""
        col, kind = self.cols[0], self.kinds[0]
        if kind in ("float", "double", "boolean"):
            return None
        low = self.values[first - 1][0] if first > 0 else None
        high = self.values[last][0] if last < len(self.values) else None
        cond = None if low is None else F.col(col) >= F.lit(low).cast(kind)
        if high is not None:
            upper = F.col(col) <= F.lit(high).cast(kind)
            # without a lower end the first keys, nulls, belong to the buckets
            cond = (F.col(col).isNull() | upper) if cond is None else cond & upper
        return cond


def splitters(df: DataFrame, cols: list[str], buckets: int) -> Splitters:
    """Splitters of about ``buckets`` even buckets, from a sample of the keys by their hash."""
    buckets = min(buckets, MOST_BUCKETS)
    kinds = [dict(df.dtypes)[c] for c in cols]
    keys = df.select(*cols)
    n = keys.count()
    wanted = buckets * SAMPLED
    if n > wanted:
        keys = keys.where(F.pmod(F.xxhash64(*cols), F.lit(HASH_RANGE)) < max(1, math.ceil(HASH_RANGE / n * wanted)))
    rows = keys.orderBy(*cols).select(*[F.col(c).cast("string").alias(c) for c in cols]).collect()
    at = sorted({round(i * len(rows) / buckets) for i in range(1, buckets)} - {0}) if rows else []
    out: list[tuple] = []
    for i in at:
        v = tuple(rows[min(i, len(rows) - 1)])
        if not out or out[-1] != v:
            out.append(v)
    return Splitters(list(cols), kinds, out)
