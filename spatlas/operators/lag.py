"""Spatial lag over edges: one join and one aggregation for a vector, many variables or a panel alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spatial_lag(edges: DataFrame, values: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """``values`` (id, keys, value) with ``lag``; ids without neighbours lag 0. Constant values are allowed."""
    keys = keys or []
    near = edges.join(values.select(F.col("id").alias("j"), *keys, F.col(value).cast("double").alias("_v")), "j")
    lags = near.groupBy(F.col("i").alias("id"), *keys).agg(F.sum(F.col("w") * F.col("_v")).alias("lag"))
    return values.join(lags, ["id", *keys], "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)) + F.lit(0.0))
