"""Sweep training re-aimed as distributed fits (M1).

Each grid row trains one ``MultilayerPerceptronClassifier`` (pyspark.ml) on
the train split; every fit is a distributed job over the samples.  The
differences from a mini-batch GPU trainer are deliberate and stated: hidden
units are sigmoid (not ReLU), the solver is L-BFGS on full batches (not
mini-batch SGD/Adam), and the per-iteration objective history is the run log.
"""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWEEP_RESULT = "run_id bigint, width int, depth int, iterations int, final_loss double, val_accuracy double"


def sweep_train(spark: SparkSession, samples: DataFrame, grid: list[dict], features: str, label: str,
                input_dim: int, n_classes: int, max_iter: int = 50, seed: int = 42) -> DataFrame:
    """M1: one fit per grid row (keys run_id, width, depth); samples carry ``split`` train/val."""
    data = samples.select(array_to_vector(F.col(features)).alias("features"),
                          F.col(label).cast("double").alias("label"), "split").cache()
    train = data.filter(F.col("split") == "train")
    val = data.filter(F.col("split") == "val")
    rows = []
    for g in grid:
        layers = [input_dim] + [int(g["width"])] * int(g["depth"]) + [n_classes]
        model = MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed,
                                               featuresCol="features", labelCol="label").fit(train)
        hist = model.summary().objectiveHistory
        pred = model.transform(val)
        acc = pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        rows.append((int(g["run_id"]), int(g["width"]), int(g["depth"]), len(hist),
                     float(hist[-1]) if hist else None, acc))
    data.unpersist()
    return spark.createDataFrame(rows, SWEEP_RESULT)
