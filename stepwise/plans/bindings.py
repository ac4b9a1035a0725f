"""Roles played by the generated test tables.

The engine works on experiment tables (step logs, run configs, corpora,
vectors).  The test data is a generic star schema, so these functions map
its tables onto those roles.  Every mapping is a pure projection or a
per-run window, so it scales with the input and keeps parquet pushdown.

Fixed mapping choices (the SQL oracles in ``plans/oracle_sql.py`` restate them):

* step log    <- events:   run_id = user_id (string), step = 1-based order of
  (ts, event_id) inside the run, loss = ln(1 + value), split = 'val' for event types
  error and signup else 'train', time = ts, epoch = 1 + (day of month - 1) div 7
* run configs <- customer: id = c_custkey (string); optimizer = lower(segment)
  except NULL when c_nationkey % 7 = 0; learning_rate = c_acctbal / 10000,
  NULL for a negative balance; depth = c_nationkey % 5 + 1;
  width = 16 * (1 + c_custkey % 4); train_frac = (1 + c_nationkey % 3) / 10;
  exp_name = 'sweep_b' for segments BUILDING and MACHINERY else 'sweep_a'
* logits      <- embeddings: logits = first 10 entries of embedding, label
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

INPUT_DIM = 64
OUTPUT_DIM = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def step_log(spark: SparkSession, sf_dir: str, skew_safe: bool = False) -> DataFrame:
    """events -> raw step records (one record per step, no logits).

    The step numbering window is partitioned by the string ``run_id`` itself,
    so every later per-run window or aggregate reuses this one hash
    partitioning instead of shuffling the log again.
    """
    ev = table(spark, sf_dir, "events")
    run = Window.partitionBy("run_id").orderBy("ts", "event_id")
    base = ev.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("event_type").isin("error", "signup"), F.lit("val"))
         .otherwise(F.lit("train")).alias("split"),
        (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("int").alias("epoch"),
        "ts", "event_id",
        F.col("ts").cast("timestamp").alias("time"),
        F.log(F.lit(1.0) + F.col("value")).alias("loss"),
    )
    if skew_safe:
        from stepwise.operators.smooth import run_positions
        pos = run_positions(base, ["run_id"], ["ts", "event_id"])
        return pos.select("run_id", "split", "epoch", (F.col("__rn") + 1).cast("bigint").alias("step"),
                          "time", "loss")
    return base.select("run_id", "split", "epoch", F.row_number().over(run).cast("bigint").alias("step"),
                       "time", "loss")


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> flat run configs (one row per run)."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_nationkey") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.lower("c_mktsegment")).alias("optimizer"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal") / 10000).alias("learning_rate"),
        (F.col("c_nationkey") % 5 + 1).cast("int").alias("depth"),
        (F.lit(16) * (F.col("c_custkey") % 4 + 1)).cast("int").alias("width"),
        ((F.col("c_nationkey") % 3 + 1) / 10.0).alias("train_frac"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("sweep_b"))
         .otherwise(F.lit("sweep_a")).alias("exp_name"),
    )


def nested_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nested run configs, three levels deep."""
    f = run_configs(spark, sf_dir)
    return f.select(
        "id",
        F.struct(F.col("depth").alias("epochs")).alias("trainer"),
        F.struct(F.lit("mlp").alias("architecture"),
                 F.lit(INPUT_DIM).alias("input_dim"),
                 F.lit(OUTPUT_DIM).alias("output_dim"),
                 "depth", "width").alias("model"),
        F.struct(F.col("optimizer").alias("name"), "learning_rate").alias("optimizer"),
        F.struct(F.lit("embeddings").alias("dataset"), "train_frac",
                 F.struct(F.col("exp_name").alias("name")).alias("sweep")).alias("loader"),
    )


def logits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (vec_id, logits array<double>, label int, features)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.transform(F.slice("embedding", 1, OUTPUT_DIM), lambda x: x.cast("double")).alias("logits"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").alias("features"),
    )



def batch_step_log(spark: SparkSession, sf_dir: str, batch: int = 10,
                   steps_per_run: int = 10) -> DataFrame:
    """embeddings -> step records carrying a logits matrix and labels.

    Samples are dealt to batches of ``batch`` consecutive vec_ids; a batch is
    one step; ``steps_per_run`` consecutive batches form a run; every fourth
    batch is a validation step.  loss = mean cross-entropy of the batch.
    Grouping is per batch, so no group exceeds ``batch`` rows.
    """
    from stepwise.functions.arrays import cross_entropy

    lt = logits_table(spark, sf_dir)
    b = F.floor(F.col("vec_id") / batch).cast("bigint")
    items = F.array_sort(F.collect_list(F.struct(
        F.col("vec_id"), F.col("logits"), F.col("label"),
        cross_entropy("logits", "label").alias("ce"))))
    g = lt.groupBy(b.alias("batch")).agg(items.alias("items"))
    return g.select(
        F.floor(F.col("batch") / steps_per_run).cast("bigint").cast("string").alias("run_id"),
        F.when(F.col("batch") % 4 == 3, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.lit(1).alias("epoch"),
        (F.col("batch") + 1).alias("step"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.expr("make_dt_interval(0, 0, 0, batch)"))
        .cast("timestamp").alias("time"),
        (F.aggregate(F.col("items"), F.lit(0.0).cast("double"), lambda a, x: a + x["ce"])
         / F.size("items")).alias("loss"),
        F.transform("items", lambda x: x["logits"]).alias("logits"),
        F.transform("items", lambda x: x["label"]).alias("labels"),
    )
