"""Hard-negative mining with Fagin's threshold algorithm.

Candidates are dealt into blocks of bounded rows.  A block keeps, for every
component, its rows sorted by that component.  An anchor's best rows by inner
product are found by sorted access: each list is read from the end that the
sign of the anchor's component favours, a row met for the first time is scored
at once by random access, in whole numbers.  After t rows of every list no
row that wasn't met can score above the threshold, the sum of the anchor's
components times the last values read.  A search has windows (least and greatest score, rows
wanted) and ends as soon as the threshold is strictly below the last wanted
score of each of them, or below its least score.

Two searches are made: the first positives (rows of the anchor's label), whose
scores then give the windows of the second, over rows of other labels.  Each
block gives its own best; a window by anchor picks the best of all blocks.
Anchors are sent to every block and read there as a stream; candidates never meet each other.

Defined results: rows with a null id, a null label, a null vector or a null or
non-finite component take no part; of rows with the same id the smallest label,
then vector, takes part; vectors of different lengths count as if the shorter
ended in zeros; ties go to the smaller id; an anchor without positives, and a
positive without negatives in its window, give no rows; an empty table gives
none.  Components beyond 2**27 after scaling raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.llm.centroids import LARGEST, finite, whole_vectors
from stepwise.llm.textbuf import stored

#: Rows of a block on average; rows of each list that the first step reads, doubled by every further one.
BLOCK_ROWS, FIRST_DEPTH = 1 << 14, 32


class SortedBlock:
    """Candidates and their rows sorted by every component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float, int]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (least, greatest, wanted): ids and scores of the best allowed rows; and how many rows were scored."""
        n, d = len(self.ids), len(anchor)
        used = np.flatnonzero(anchor)
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, done = 0, 0
        front = np.where(anchor > 0, n - 1, 0)
        step = np.where(anchor > 0, -1, 1)
        while True:
            to = min(n, max(FIRST_DEPTH, 2 * depth)) if len(used) else n
            before = seen.copy()
            if len(used):
                at = front[used] + step[used] * np.arange(depth, to)[:, None]
                seen[self.order[at, used].ravel()] = True
            else:
                seen[:] = True
            new = np.flatnonzero(seen & ~before)
            done += len(new)
            new = new[allowed[new]]
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.vectors[new][:, :d] @ anchor])
            depth = to
            best = [_best(self.ids, rows, scores, *w) for w in windows]
            if depth >= n:
                return best, done
            last = self.values[front[used] + step[used] * (depth - 1), used]
            threshold = int(last @ anchor[used])
            if all(threshold < w[0] or (len(b[1]) >= w[2] and threshold < b[1][-1]) for w, b in zip(windows, best)):
                return best, done


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, least: float, greatest: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` best of rows with a score in the window: higher scores first, then smaller ids."""
    fit = np.flatnonzero((scores >= least) & (scores <= greatest))
    if len(fit) > wanted:
        floor = np.partition(scores[fit], len(fit) - wanted)[len(fit) - wanted]
        fit = fit[scores[fit] >= floor]
    fit = fit[np.lexsort((ids[rows[fit]], -scores[fit]))][:wanted]
    return ids[rows[fit]], scores[fit]


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if flat.size and max(flat.max(), -flat.min()) > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} after scaling")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


SEARCHED = "anchor_id long, window long, id long, score long"


def _search(candidates: DataFrame, anchors: DataFrame, blocks: int, width: int, same_label: bool, wanted: int) -> DataFrame:
    """The best of every block for every window of every anchor (``windows`` array of (key, least, greatest)); of all blocks, the ``wanted`` first."""
    spread = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "vector", "windows")
    both = candidates.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "label", "vector",
                             F.lit(None).cast("array<struct<key:bigint,least:bigint,greatest:bigint>>").alias("windows")).unionByName(spread)
    dealt = both.repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def run(batches):
        held: list = []
        current, ready = None, None
        for batch in batches:
            block = batch.column(0).to_numpy()
            kind = batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                part = batch.slice(lo, hi - lo)
                if block[lo] != current:
                    current, held, ready = block[lo], [], None
                if kind[lo] == 0:
                    held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), _padded(part.column(4), width)))
                    continue
                if not held and ready is None:
                    continue
                if ready is None:
                    ready = SortedBlock(*(np.concatenate(x) for x in zip(*held)))
                    held = []
                found: list[list] = [[], [], [], []]
                vectors = _padded(part.column(4), width)
                for i, (who, label, windows) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(5).to_pylist())):
                    allowed = ((ready.labels == label) == same_label) & (ready.ids != who)
                    got, _ = ready.search(vectors[i], allowed, [(w["least"], w["greatest"], wanted) for w in windows])
                    for w, (ids, scores) in zip(windows, got):
                        found[0].append(np.full(len(ids), who, np.int64))
                        found[1].append(np.full(len(ids), w["key"], np.int64))
                        found[2].append(ids)
                        found[3].append(scores)
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in found], names=["anchor_id", "window", "id", "score"])

    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return dealt.mapInArrow(run, SEARCHED).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def mine(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, anchor: Column | None = None,
         positives: int = 5, negatives: int = 10, least_pct: int = 30, greatest_pct: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each anchor and positive the first negatives whose score is ``least_pct`` to ``greatest_pct`` percent of the positive's.

    ``label``: the labels (the column of that name), ``anchor``: which rows are anchors (all).
    """
    vec, id_ = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    label = F.col("label") if label is None else label
    anchor = F.lit(True) if anchor is None else anchor
    valid = table.where(id_.isNotNull() & label.isNotNull() & finite(vec)).select(
        id_.cast("long").alias("id"), F.struct(label.cast("long").alias("label"), whole_vectors(vec, scale).alias("vector"), anchor.alias("anchor")).alias("row"))
    rows = stored(valid.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*"), "negatives_rows")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks, width = max(1, -(-n // block_rows)), max(1, width or 0)
    # any score lies within these
    any_score = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(-(1 << 62)).alias("least"), F.lit(1 << 62).alias("greatest")))
    anchors = rows.where("anchor").select("id", "label", "vector")
    best = stored(_search(rows, anchors.withColumn("windows", any_score), blocks, width, True, positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # least_pct * p <= 100 * s <= greatest_pct * p, in whole numbers; never true for p < 0
    limits = best.where("positive_score >= 0").withColumns({
        "least": F.expr(f"({least_pct} * positive_score + 99) div 100"), "greatest": F.expr(f"({greatest_pct} * positive_score) div 100")})
    limits = limits.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("positive_id").alias("key"), "least", "greatest"))).alias("windows"))
    asking = anchors.join(limits.withColumnRenamed("anchor_id", "id"), "id")
    found = _search(rows, asking, blocks, width, False, negatives)
    return found.select("anchor_id", F.col("window").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(best, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows by scoring all of them for every anchor.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10
"""
