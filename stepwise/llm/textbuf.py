"""Vectorised views of Arrow text columns, and helpers shared by the operators of this folder.

Python workers see a text column as one UTF-8 byte buffer with offsets; words,
n-grams and counts are computed on the whole buffer with numpy, so no Python
string is made per word.  Batches are cut into slices of bounded bytes (one
longer text forms a slice of its own), which bounds the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.session import scratch_path

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 1 << 20
#: Bytes of rows after which an Arrow batch for the Python workers is closed.
BATCH_BYTES = 2 << 20

_U64 = np.uint64
_ODD = _U64(0x9E3779B97F4A7C15)


def byte_table(allowed: bytes | range | set[int]) -> np.ndarray:
    """256 booleans: whether a byte is one of ``allowed``."""
    t = np.zeros(256, dtype=bool)
    t[list(allowed)] = True
    return t


#: Bytes of words delimited by ASCII white space ([^\x20\x09-\x0D]+).
NOT_SPACE = byte_table({b for b in range(256) if b != 0x20 and not 9 <= b <= 13})


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds) of consecutive runs of rows of at most ``max_bytes`` or one row.

    Null rows are empty.  ``bounds`` has one more entry than the rows and
    starts at 0.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    buf = texts.buffers()
    off = np.frombuffer(buf[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(buf[2], dtype=np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, broken at row bounds."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(mask[:-1], out=first[1:])
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = True
    first &= mask
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(mask[1:], out=last[:-1])
    last[inner - 1] = True
    last &= mask
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over 64 bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE64 = mix64((np.arange(1, 257, dtype=np.uint64)) * _ODD)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (polynomial in the position, then mixed with the length)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum()), dtype=np.int64)
    at = pos - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), 0x100000001B3, dtype=np.uint64))
    terms = _BYTE64[data[at + np.repeat(starts, size)]] * power[at]
    return mix64(np.add.reduceat(terms, first) + size.astype(np.uint64) * _ODD)


def rows_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row number of each position."""
    return np.searchsorted(bounds, starts, side="right") - 1


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Number of entries of each of ``n`` rows."""
    return np.bincount(rows, minlength=n).astype(np.int64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the cluster's shared folder, and read back.

    Cuts the lineage: later stages and retried tasks read the files.  The
    folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session closes an Arrow batch at ``BATCH_BYTES`` (one longer row forms a batch of its own).

    Spark's limits (10,000 rows, 64 MB or more) let a task's buffers, the rows that wait for
    the worker's answer and the worker's copies grow with the length of the texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


#: A side of a join is sent whole to every executor up to this many bytes of rows.
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a stored table for broadcast if its counted rows times ``row_bytes`` are within the bound.

    ``table`` must be cheap to count (written to storage).  A larger one is
    returned as it is: the join then shuffles both sides, and AQE splits
    skewed partitions.
    """
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def with_result(df: DataFrame, **results) -> DataFrame:
    """``df`` with the result columns added; an input column of the same name (in any case) is replaced."""
    names = {k.lower() for k in results}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*keep, *[c.alias(k) for k, c in results.items()])


def spread_files(df: DataFrame) -> DataFrame:
    """Deals out a table stored in fewer splits than the cluster has task slots, without a key.

    ``df`` must be a plain scan: its split count is then known without a job.
    """
    slots = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)
