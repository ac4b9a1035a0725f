"""Sharding by minimax contiguous partition of ordered atomic groups.

Groups are equal texts, in the order of a 64-bit hash of the text.  The shards are runs of
this order; the largest shard is as small as any cut into that many runs allows.

The smallest feasible capacity is found by binary search, each value checked by greedy
filling.  The driver does that on a histogram of the order, not on the
groups: a block is the total size of a range of hashes.  Blocks that some
cut may fall into are split into finer ones by a further aggregate, until every cut
lies at the edge of a block or in a block of a single group.  Each level
adds a bounded number of blocks; the rows move only as partial sums.

Defined results: a null text is the empty text with size ``OVERHEAD``; repeated rows are single
members of their group; an empty table gives no rows; groups whose hashes are equal are one group.
Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.textbuf import broadcast_if_small, stored, with_result

SHARDS = 24
#: Bytes that every document takes besides its text.
OVERHEAD = 8
#: Bits of the hash that the first histogram resolves, and bits added to the blocks split by each next one.
FIRST_BITS, MORE_BITS = 12, 8
KEY_BITS = 64
#: Rows numbered by one window partition.
SLOT_ROWS = 20_000


def doc_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def group_key(text: Column) -> Column:
    """Order of the groups, a signed 64-bit hash."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _block(bits: int) -> Column:
    """The block of a key at a resolution, numbered in the order of the signed keys."""
    return F.shiftright("key", KEY_BITS - bits)


def _histogram(rows: DataFrame, bits: int) -> list[tuple[int, int, bool]]:
    """(block, size, whether it is a single group) in order."""
    got = rows.groupBy(_block(bits).alias("block")).agg(F.sum("size").alias("n"), (F.min("key") == F.max("key")).alias("atom")).collect()
    return sorted((r["block"], r["n"], r["atom"]) for r in got)


class Blocks:
    """Ordered blocks with their end positions; ``hard`` ends are where a cut may be."""

    def __init__(self, blocks: list[tuple[int, int, int, bool]]):
        """blocks: (first key, bits, size, atom) in the order of the keys."""
        self.blocks = blocks
        self.ends, at = [], 0
        for b in blocks:
            at += b[2]
            self.ends.append(at)
        self.total = at

    def cut(self, limit: int, loose: bool) -> int:
        """The largest place for a cut that is at most ``limit``; ``loose`` lets it fall anywhere in a block that can be split."""
        if limit >= self.total:
            return self.total
        i = bisect_right(self.ends, limit)
        if loose and not self.blocks[i][3]:
            return limit
        return self.ends[i - 1] if i else 0

    def greedy(self, capacity: int, shards: int, loose: bool) -> list[int] | None:
        """Ends of the shards that greedy filling makes; None if they hold not everything."""
        ends, at = [], 0
        for _ in range(shards):
            at = self.cut(at + capacity, loose)
            ends.append(at)
        return ends if at >= self.total else None

    def smallest(self, shards: int, loose: bool) -> int:
        """Binary search for the smallest capacity that holds everything."""
        lo, hi = -(-self.total // shards), max(self.total, 1)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.greedy(mid, shards, loose) is None:
                lo = mid + 1
            else:
                hi = mid
        return lo


def cuts(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The minimax capacity, and the first key of each shard after the first (in order; fewer if shards stay empty).

    ``rows`` (key, size) is stored.
    """
    low = -(1 << (KEY_BITS - 1))
    blocks = Blocks([(b << (KEY_BITS - FIRST_BITS), FIRST_BITS, n, atom) for b, n, atom in _histogram(rows, FIRST_BITS)])
    while True:
        bound = blocks.smallest(shards, loose=True)
        sure = blocks.smallest(shards, loose=False)
        split = set()
        if bound < sure:
            # every cut for a capacity between the two lies between these places
            first, last, a, b = [], [], 0, 0
            for _ in range(shards):
                a, b = blocks.cut(a + bound, False), blocks.cut(b + sure, True)
                first.append(a)
                last.append(b)
            for a, b in zip(first, last, strict=True):
                i, j = bisect_right(blocks.ends, a), bisect_right(blocks.ends, b)
                split.update(k for k in range(i, min(j, len(blocks.blocks) - 1) + 1) if not blocks.blocks[k][3])
        if not split:
            break
        finer = {}
        for bits in sorted({blocks.blocks[k][1] for k in split}):
            mine = [blocks.blocks[k][0] for k in split if blocks.blocks[k][1] == bits]
            wanted = rows.sparkSession.createDataFrame(pa.table({"at": pa.array([k >> (KEY_BITS - bits) for k in mine], pa.int64())}))
            more = min(KEY_BITS, bits + MORE_BITS)
            inside = rows.join(F.broadcast(wanted), _block(bits) == F.col("at"), "left_semi")
            for b, n, atom in _histogram(inside, more):
                finer.setdefault((b >> (more - bits)) << (KEY_BITS - bits), []).append((b << (KEY_BITS - more), more, n, atom or more == KEY_BITS))
        blocks = Blocks([x for k, b in enumerate(blocks.blocks) for x in (finer[b[0]] if k in split else [b])])
    ends = blocks.greedy(sure, shards, loose=False)
    starts = []
    for e in ends[:-1]:
        i = bisect_right(blocks.ends, e)
        if i < len(blocks.blocks):
            starts.append(max(low, blocks.blocks[i][0]))
    return sure, starts


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Every row without its text, with size, text_crc32, law, shard, slot and grown_shard.

    Slots number the rows of a shard without gaps; they are dealt by a hash of id and text
    into parts of bounded size, so no shard has to be sorted in one task.
    """
    full = docs.withColumn("__key", group_key(F.col(text))).withColumn("__size", doc_size(F.col(text)))
    full = stored(full.withColumn("__crc", F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))).drop(text), "keys")
    slim = full.select(F.col("__key").alias("key"), F.col("__size").alias("size"))
    _, starts = cuts(slim, shards)
    number = F.lit(0)
    for k in starts:
        number = number + (F.col("__key") >= F.lit(k)).cast("int")
    parts = 1 + full.count() // SLOT_ROWS
    full = full.withColumn("__shard", number).withColumn("__part", F.pmod(F.xxhash64(F.col(doc_id), F.col("__key"), F.lit("slot")), F.lit(parts)))
    sums = stored(full.groupBy("__shard", "__part").agg(F.count("*").alias("n")), "slots")
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select(F.col("__shard").alias("s"), F.col("__part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")), "slots")
    order = Window.partitionBy("__shard", "__part").orderBy(F.col(doc_id), "__key", "__crc")
    out = full.withColumn("__n", F.row_number().over(order))
    out = out.join(broadcast_if_small(sums, 48), (F.col("__shard") == F.col("s")) & (F.col("__part") == F.col("p")))
    out = with_result(
        out, size=F.col("__size"), text_crc32=F.col("__crc"), law=F.lit("bytes"), shard=F.col("__shard"),
        slot=(F.col("__before") + F.col("__n") - 1).cast("long"), grown_shard=F.lit(None).cast("int"),
    )
    return out.drop("__key", "__size", "__crc", "__shard", "__part", "__n", "__before", "s", "p")
