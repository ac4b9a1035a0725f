"""Centroid clustering with the equal-average equal-variance nearest-neighbour search.

Vectors and centroids are whole numbers.  The centroids are kept sorted by the
sum (the mean) of their components.  A vector's search starts where its own sum
belongs and goes outwards, the nearer side first.  With d components, sum s and
deviation v = sqrt(d * sum of squares - s * s) the squared distance D of two vectors satisfies

    d * D >= (s - s')^2                      (equal average)
    d * D >= (s - s')^2 + (v - v')^2         (equal variance)

so a centroid whose first bound is above the best distance so far ends the
scan, one whose second bound is above it is passed over, and all others are
measured in whole numbers.  Bounds are in floating point and give way by a
relative 1e-9; what they reject is strictly worse, so the result is that of
measuring every centroid.

A round is one pass over a stored table: tasks add up their vectors by
cluster, and k * d sums reach the driver.

Defined results: a vector that is null, of another length, or with a null or
non-finite component is left out; ties go to the smaller centroid number;
fewer vectors than centroids give as many centroids as vectors; repeated rows
count each; a null id is hashed as ``null``; an empty table gives no rows.
Components beyond 2**27 after scaling, whose squared distance a long can't
hold, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwise.llm.textbuf import stored

#: Largest component after scaling.
LARGEST = 1 << 27
SLACK = 1 - 1e-9


def whole_vectors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equally long lists of whole numbers."""
    values = column.flatten().to_numpy().reshape(len(column), width)
    if values.size and max(values.max(), -values.min()) > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} after scaling")
    return values


class Centroids:
    """Centroids in the order of their sums, ready for searches."""

    def __init__(self, numbers: np.ndarray):
        """``numbers``: k rows of d whole numbers, row i is centroid i."""
        self.k, self.d = numbers.shape
        total = numbers.sum(axis=1)
        self.number = np.lexsort((np.arange(self.k), total))
        self.rows, self.total = numbers[self.number], total[self.number]
        self.spread = _deviation(self.rows, self.total)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of every vector's nearest centroid, and how many distances were measured."""
        n = len(x)
        total = x.sum(axis=1)
        spread = _deviation(x, total)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, self.k)
        right = np.searchsorted(self.total, total)
        left = right - 1
        live, measured = np.arange(n), 0
        while len(live):
            lo, hi = left[live], right[live]
            down = np.where(lo >= 0, total[live] - self.total[np.maximum(lo, 0)], np.iinfo(np.int64).max)
            up = np.where(hi < self.k, self.total[np.minimum(hi, self.k - 1)] - total[live], np.iinfo(np.int64).max)
            at = np.where(down <= up, lo, hi)
            gap = np.minimum(down, up).astype(np.float64)
            limit = best[live].astype(np.float64) * self.d
            go = ((lo >= 0) | (hi < self.k)) & (gap * gap * SLACK <= limit)
            live, at, gap, limit, down, up = live[go], at[go], gap[go], limit[go], down[go], up[go]
            near = (gap * gap + (spread[live] - self.spread[at]) ** 2) * SLACK <= limit
            rows, c = live[near], at[near]
            off = x[rows] - self.rows[c]
            dist = np.einsum("ij,ij->i", off, off)
            measured += len(rows)
            better = (dist < best[rows]) | ((dist == best[rows]) & (self.number[c] < who[rows]))
            best[rows[better]], who[rows[better]] = dist[better], self.number[c[better]]
            from_left = down <= up
            left[live[from_left]] -= 1
            right[live[~from_left]] += 1
        return who, best, measured


def _deviation(rows: np.ndarray, total: np.ndarray) -> np.ndarray:
    x, t = rows.astype(np.float64), total.astype(np.float64)
    return np.sqrt(np.maximum(rows.shape[1] * np.einsum("ij,ij->i", x, x) - t * t, 0))


def _steps(batch: pa.RecordBatch, column: int, width: int, rows: int = 1 << 13):
    for lo in range(0, len(batch), rows):
        part = batch.slice(lo, rows)
        yield part, matrix(part.column(column), width)


def _sums(vectors: DataFrame, centroids: Centroids) -> list:
    """By cluster and component: number of vectors and sum."""
    k, d = centroids.k, centroids.d
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def add(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for _, x in _steps(batch, 0, d):
                who, _, _ = shared.value.nearest(x)
                n += np.bincount(who, minlength=k)
                order = np.argsort(who, kind="stable")
                first = np.flatnonzero(np.diff(who[order], prepend=-1))
                total[who[order[first]]] += np.add.reduceat(x[order], first, axis=0)
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.repeat(used, d)), pa.array(np.tile(np.arange(d), len(used))), pa.array(np.repeat(n[used], d)), pa.array(total[used].ravel())],
                              ["cluster", "component", "n", "total"])

    parts = vectors.select("vector").mapInArrow(add, "cluster long, component long, n long, total long")
    return parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10,
            seed: str = "3:", on_start: Callable[[np.ndarray], None] | None = None) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector.

    The first centroids are the ``k`` vectors with the smallest sha256 of seed and id; ``rounds`` times
    every vector goes to the nearest one and every centroid that has vectors becomes their mean, rounded down.
    ``on_start`` hears the first centroids.
    """
    vec = F.col(f"`{vector_col}`")
    kept = table.where((F.size(vec) == width) & finite(vec)).select(F.col(f"`{id_col}`").alias("id"), whole_vectors(vec, scale).alias("vector"))
    vectors = stored(kept, "vectors")
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    first = vectors.orderBy(order, "vector").limit(k).select("vector").collect()
    schema = f"{id_col} {dict(kept.dtypes)['id']}, cluster int, distance long"
    if not first:
        return vectors.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    numbers = np.array([r["vector"] for r in first], dtype=np.int64)
    if on_start:
        on_start(numbers)
    for _ in range(rounds):
        for r in _sums(vectors, Centroids(numbers)):
            numbers[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
    shared = vectors.sparkSession.sparkContext.broadcast(Centroids(numbers))

    def assign(batches):
        for batch in batches:
            for part, x in _steps(batch, 1, width):
                who, dist, _ = shared.value.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who.astype(np.int32)), pa.array(dist)], names=[id_col, "cluster", "distance"])

    assigned = stored(vectors.select("id", "vector").mapInArrow(assign, schema), "assigned")
    spent = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, n, sum(spent.values()), hashlib.sha256(",".join(map(str, numbers[c])).encode()).hexdigest()) for c, n in sorted(spent.items())]
    clusters = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """DuckDB SQL of the query: every round spelled out."""
    dist = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
             f"WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
             f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}' || vec_id)) - 1 AS BIGINT) AS cid, v FROM v ORDER BY sha256('{seed}' || vec_id) LIMIT {k})"]
    for r in range(rounds + 1):
        # distance and number in one value: the smallest is the nearest, then the smallest number
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, any_value(v.v) AS v, min(CAST({dist} AS BIGINT) * {k} + c.cid) AS m FROM v, c{r} c GROUP BY v.vec_id)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT cid, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m % {k} AS cid, unnest(v) AS x, unnest(range(1, {width} + 1)) AS i FROM a{r}) GROUP BY cid, i)")
            parts.append(f"m{r} AS (SELECT cid, list((s - ((s % n + n) % n)) // n ORDER BY i) AS v FROM s{r} GROUP BY cid)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cid, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON c{r}.cid = m{r}.cid)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(m % {k} AS INT) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
  CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.m % {k} = c.cid
"""
