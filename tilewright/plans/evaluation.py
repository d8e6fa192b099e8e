"""Patch scores to image metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import metrics as m


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    curves: DataFrame


def evaluate(patches: DataFrame, labels: DataFrame, image: str = "image_id") -> Evaluation:
    """``patches``: image, logit; ``labels``: image, y_true.  Images without a patch are left out."""
    predictions = m.image_scores(patches, image).join(labels, image)
    one = lambda df: df.withColumn("_one", F.lit(1))
    table = one(m.binary_metrics(predictions)).join(one(m.ranking_metrics(predictions)), "_one").drop("_one")
    table = table.withColumn("images", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return Evaluation(predictions, table, m.confusion_matrix(predictions), m.curve_points(predictions))
