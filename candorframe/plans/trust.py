"""The evaluation question in one place: how far can these scores be trusted?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candorframe.functions.labels import label_class
from candorframe.operators.evaluation import calibration_metrics, expected_calibration_error, roc_auc


def trust_report(predictions: DataFrame, label: str, pct: str, threshold: float = 50.0, bins: int = 10) -> DataFrame:
    """One row: the calibration metrics with the calibration error and the AUC of the same pairs."""
    one = F.lit(1).alias("_one")
    base = calibration_metrics(predictions, label, pct, threshold).select("*", one)
    ece = expected_calibration_error(predictions, label, pct, bins).select("ece", one)
    auc = roc_auc(predictions.withColumn("_y", label_class(F.col(label))), pct, "_y").select("auc", one)
    return base.join(ece, "_one", "left").join(auc, "_one", "left").drop("_one")
