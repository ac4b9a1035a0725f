"""Vector scoring and evaluation as table jobs (M2-M4).

* M2 applies dense layers to a table of vectors in Arrow batches
  (``mapInPandas`` + NumPy matmul); the weight matrices are broadcast once —
  their size is the model's, not the data's.
* M3 gathers embedding rows for token ids (an equi join on the id; hot ids apart).
* M4 turns logits + labels into per-batch loss and accuracy (F9 + A6) with
  one hash aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwise.functions.arrays import argmax, cross_entropy
from stepwise.operators.common import MAX_BROADCAST_BYTES, bounded_broadcast, range_parts
from stepwise.session import ensure_checkpoint_dir, ship_package


def score_mlp(df: DataFrame, features: str, layers: list[tuple[np.ndarray, np.ndarray]],
              keep: list[str], out: str = "logits") -> DataFrame:
    """M2: input layer (no activation), hidden layers with ReLU, output layer.

    ``layers`` is [(W, b), ...] with W shaped (in, out); the first is the input
    layer, the last the output layer, the ones between are dense + ReLU.
    """
    if len(layers) < 2:
        raise ValueError("need at least an input and an output layer")
    mats = [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in layers]
    ship_package(df.sparkSession)
    b_layers = df.sparkSession.sparkContext.broadcast(mats)
    schema = T.StructType([f for f in df.select(*keep).schema.fields]
                          + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        ls = b_layers.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[features]])
            x = x @ ls[0][0] + ls[0][1]
            for w, b in ls[1:-1]:
                x = np.maximum(x @ w + b, 0.0)
            x = x @ ls[-1][0] + ls[-1][1]
            res = pdf[keep].copy()
            res[out] = list(x)
            yield res

    return df.select(*keep, features).mapInPandas(run, schema)


def class_centroids(df: DataFrame, features: str, label: str, dim: int) -> DataFrame:
    """Per-class mean vector (label, centroid array<double>) as one grouped aggregate."""
    return df.groupBy(label).agg(
        F.array(*[F.avg(F.element_at(features, i + 1).cast("double")) for i in range(dim)]).alias("centroid"))


def embed_tokens(encoded: DataFrame, ids: str, keys, table: DataFrame, id_col: str,
                 vec_col: str, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """M3: one row per token position with its embedding vector; an id missing from the table raises.

    A table within the bound is broadcast.  Beyond it, its rows of the ids that occur are, if they are within the bound.
    Else the positions are joined by shuffle, but for ids that are more than half a partition's share of all
    positions: there are at most twice as many of these as partitions, and their vectors are broadcast.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ex = encoded.select(*keys, F.posexplode(ids).alias("pos", "token_id"))
    emb = table.select(F.col(id_col).cast("int").alias("token_id"), F.col(vec_col).alias("vector")).withColumn("__known", F.lit(True))
    small, used = bounded_broadcast(emb, 1 << 20, max_broadcast_bytes), None
    if small is emb:
        ensure_checkpoint_dir(ex.sparkSession)
        counts = ex.groupBy("token_id").count().checkpoint()
        used = emb.join(counts.select("token_id"), "token_id", "left_semi")
        small = bounded_broadcast(used, 1 << 20, max_broadcast_bytes)
    if small is not emb and small is not used:
        found = ex.join(small, "token_id", "left")
    else:
        total = counts.agg(F.sum("count")).first()[0] or 0
        hot = [r["token_id"] for r in counts.where((F.col("count") > total / (2 * range_parts(ex.sparkSession))) & F.col("token_id").isNotNull()).collect()]
        is_hot = F.coalesce(F.col("token_id").isin(hot), F.lit(False)) if hot else F.lit(False)
        found = ex.where(~is_hot).join(emb.where(~is_hot), "token_id", "left")
        if hot:
            found = found.unionByName(ex.where(is_hot).join(F.broadcast(emb.where(is_hot)), "token_id", "left"))
    missing = F.raise_error(F.concat(F.lit("token id without an embedding: "), F.coalesce(F.col("token_id").cast("string"), F.lit("null"))))
    return found.withColumn("vector", F.when(F.col("__known"), F.col("vector")).otherwise(missing)).drop("__known")


def evaluate(df: DataFrame, logits: str, label: str, group) -> DataFrame:
    """M4: per group (split, batch): samples, mean cross-entropy loss, accuracy."""
    group = [group] if isinstance(group, str) else list(group)
    ce = cross_entropy(logits, label)
    ok = (argmax(logits) == F.col(label)).cast("double")
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(ce).alias("loss"),
        F.avg(ok).alias("accuracy"),
    )


def centroid_layers(centroids: pd.DataFrame, n_classes: int, dim: int, depth: int = 1):
    """Weights of a small scorer from class centroids: input = centroid similarity,
    ``depth`` identity hidden layers (ReLU), identity output."""
    w_in = np.zeros((dim, n_classes))
    for _, row in centroids.iterrows():
        w_in[:, int(row["label"])] = np.asarray(row["centroid"], dtype=np.float64)
    eye = np.eye(n_classes)
    zero = np.zeros(n_classes)
    return [(w_in, zero)] + [(eye, zero)] * depth + [(eye, zero)]


# ---------------------------------------------------------------- M2, weights as tables

#: Side of a weight block and rows of a row block: 512 kB each; row blocks that meet a weight block in one group.
BLOCK, GROUPED = 256, 64
_BLOCKS = "rb long, ib int, lot int, ids binary, x binary"


def weight_blocks(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, w) entries as dense blocks (ib, jb, w binary); entries that aren't there are 0, equal ones add up."""
    def pack(table: pa.Table) -> pa.Table:
        m = np.zeros((block, block))
        np.add.at(m, (table["i"].to_numpy() % block, table["j"].to_numpy() % block), table["w"].to_numpy())
        return pa.table({"ib": table["ib"].slice(0, 1), "jb": table["jb"].slice(0, 1), "w": pa.array([m.tobytes()], pa.binary())})

    cells = weights.select((F.col("i") / block).cast("int").alias("ib"), (F.col("j") / block).cast("int").alias("jb"), F.col("i").cast("int"), F.col("j").cast("int"), F.col("w").cast("double"))
    return cells.groupBy("ib", "jb").applyInArrow(pack, "ib int, jb int, w binary")


def score_mlp_tables(df: DataFrame, features: str, layers: list[tuple[DataFrame, DataFrame]], dims: list[int], keep: list[str], out: str = "logits",
                     block: int = BLOCK, grouped: int = GROUPED) -> DataFrame:
    """M2 for layers of any size: ``layers`` are tables ((i, j, w), (j, b)), ``dims`` the widths from the features to the logits.

    A blocked matrix product: row blocks meet weight blocks by (input block, output block, lot of row blocks), the
    products are summed by (row block, output block), which adds the bias and, between the first and the last
    layer, applies ReLU.  No layer is broadcast, and no task holds more than ``grouped`` row blocks or the
    products of one output block.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    checked = F.when(F.size(features) == dims[0], F.col(features)).otherwise(F.raise_error(F.lit(f"a row doesn't have {dims[0]} features")).cast(dict(df.dtypes)[features]))
    rows = df.select(*keep, checked.alias("__x")).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    n_blocks = rows.rdd.getNumPartitions() + rows.count() // block
    lots = max(1, -(-n_blocks // grouped))

    def cut(batches):
        from pyspark import TaskContext
        n = 0
        for batch in batches:
            for lo in range(0, len(batch), block):
                part = batch.slice(lo, block)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), dims[0])
                rb = (TaskContext.get().partitionId() << 32) + n
                n += 1
                ids = part.column(0).to_numpy().tobytes()
                for ib, at in enumerate(range(0, dims[0], block)):
                    yield pa.RecordBatch.from_arrays([pa.array([rb]), pa.array([ib], pa.int32()), pa.array([hash(rb) % lots], pa.int32()), pa.array([ids], pa.binary()),
                                                      pa.array([_padded(x[:, at:at + block], block).tobytes()], pa.binary())], names=["rb", "ib", "lot", "ids", "x"])

    h = rows.select("__id", "__x").mapInArrow(cut, _BLOCKS)
    for k, (weights, bias) in enumerate(layers):
        inputs, outputs = -(-dims[k] // block), -(-dims[k + 1] // block)

        def multiply(xs: pa.Table, ws: pa.Table) -> pa.Table:
            if not len(xs) or not len(ws):
                return xs.select(["rb", "jb", "lot", "ids"]).slice(0, 0).append_column("x", pa.array([], pa.binary()))
            w = np.frombuffer(ws["w"][0].as_py()).reshape(block, block)
            done = [(np.frombuffer(x).reshape(-1, block) @ w).tobytes() for x in xs["x"].to_pylist()]
            return xs.select(["rb", "jb", "lot", "ids"]).append_column("x", pa.array(done, pa.binary()))

        def pack(table: pa.Table) -> pa.Table:
            b = np.zeros(block)
            np.add.at(b, table["j"].to_numpy() % block, table["b"].to_numpy())
            return pa.table({"jb": table["jb"].slice(0, 1), "b": pa.array([b.tobytes()], pa.binary())})

        # entries of 0 make every block of the layer be there
        frame = spark.range(inputs * outputs).select((F.col("id") % inputs * block).alias("i"), (F.floor(F.col("id") / inputs) * block).alias("j"), F.lit(0.0).alias("w"))
        blocks = weight_blocks(weights.select("i", "j", "w").unionByName(frame), block).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        asked = h.withColumn("jb", F.explode(F.sequence(F.lit(0), F.lit(outputs - 1))))
        parts = asked.groupBy("ib", "jb", "lot").cogroup(blocks.groupBy("ib", "jb", "lot")).applyInArrow(multiply, "rb long, jb int, lot int, ids binary, x binary")
        nothing = spark.range(outputs).select((F.col("id") * block).alias("j"), F.lit(0.0).alias("b"))
        biases = bias.select("j", "b").unionByName(nothing).select((F.col("j") / block).cast("int").alias("jb"), F.col("j").cast("int"), F.col("b").cast("double")).groupBy("jb").applyInArrow(pack, "jb int, b binary")
        h = parts.join(biases, "jb").select("rb", "jb", "lot", "ids", "x", "b").groupBy("rb", "jb").applyInArrow(_adder(block, 0 < k < len(layers) - 1), _BLOCKS)

    def spread_rows(batches):
        for batch in batches:
            for ib, ids, x in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(x).reshape(len(ids), block)[:, :dims[-1] - ib * block]
                off = np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), ib, np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(x).ravel()))],
                                                 names=["__id", "ib", "part"])

    parts = h.mapInArrow(spread_rows, "__id long, ib int, part array<double>")
    whole = parts.groupBy("__id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ib", "part"))), lambda p: p["part"])).alias(out))
    return rows.drop("__x").join(whole, "__id").drop("__id")


def _adder(block: int, relu: bool):
    """Sums the products of one row block and output block, with the bias."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x).reshape(-1, block) for x in table["x"].to_pylist()) + np.frombuffer(table["b"][0].as_py())
        total = np.maximum(total, 0.0) if relu else total
        one = table.slice(0, 1)
        return pa.table({"rb": one["rb"], "ib": one["jb"], "lot": one["lot"], "ids": one["ids"], "x": pa.array([total.tobytes()], pa.binary())})

    return add


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, width - x.shape[1]))))
