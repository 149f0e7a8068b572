"""Golden-set metrics and acceptance gates over (expected, actual) id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CodedError


def judged(samples: DataFrame) -> DataFrame:
    """``samples`` (expected, actual arrays) with passed (equal as ordered lists), relevant and retrieved sizes and hits."""
    size = lambda c: F.size(F.array_distinct(c))
    return samples.withColumns({
        "passed": F.col("expected") == F.col("actual"),
        "relevant": size("expected"),
        "returned": size("actual"),
        "hits": F.size(F.array_intersect("expected", "actual")),
        "asked": F.greatest(F.size("expected"), F.lit(1)),
    })


def measures(samples: DataFrame) -> DataFrame:
    """One row: samples, passed, accuracy, precision, business_precision, recall.

    Precision divides by what was returned, business precision by what was expected (one at least a sample); with
    nothing to divide by, they and recall are 1.
    """
    found = lambda below: F.coalesce(F.try_divide(F.sum("hits"), F.sum(below)), F.lit(1.0))
    return judged(samples).agg(
        F.count("*").alias("samples"),
        F.count_if("passed").alias("passed"),
        F.avg(F.col("passed").cast("int")).alias("accuracy"),
        found("returned").alias("precision"),
        found("asked").alias("business_precision"),
        found("relevant").alias("recall"),
    )


def metrics(samples: DataFrame, mode: str = "technical") -> DataFrame:
    """``measures`` with the precision of the mode alone."""
    precision = "business_precision" if mode == "business" else "precision"
    return measures(samples).select("samples", "passed", "accuracy", F.col(precision).alias("precision"), "recall")


def gate(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value, threshold) of thresholds that aren't reached; a metric not measured counts as 0."""
    out = thresholds.join(measured, "metric", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return out.where(F.col("value") < F.col("threshold")).select("metric", "value", "threshold")


def require(measured: DataFrame, thresholds: DataFrame) -> None:
    failed = [r.metric for r in gate(measured, thresholds).orderBy("metric").collect()]  # one row a threshold
    if failed:
        raise CodedError("ACCEPTANCE_GATE_FAILED", metrics=failed)
