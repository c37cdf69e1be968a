"""Synthetic points and panels, seeded by id so that they don't depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.functions import hashed_int
from spatlas.schema import ValidationError


def uniform(*parts) -> Column:
    """In (0, 1), from the hash of the parts."""
    return (hashed_int(*[p if isinstance(p, Column) else F.lit(p) for p in parts]) + 0.5) / float(1 << 52)


def normal(*parts) -> Column:
    return F.sqrt(-2 * F.log(uniform(*parts, "a"))) * F.cos(2 * math.pi * uniform(*parts, "b"))


def synthetic_coordinates(spark: SparkSession, n: int, kind: str = "random", seed: int = 12345) -> DataFrame:
    """(id, coords): uniform in the unit square, clustered about max(2, sqrt(n) / 2) centres, or the first n of a square grid."""
    ids = spark.range(n)
    if kind == "random":
        return ids.select("id", F.array(uniform(seed, "x", F.col("id")), uniform(seed, "y", F.col("id"))).alias("coords"))
    if kind == "grid":
        side = math.ceil(math.sqrt(n))
        return ids.select("id", F.array(F.expr(f"cast(id div {side} as double)"), F.expr(f"cast(id % {side} as double)")).alias("coords"))
    if kind == "clustered":
        centre = hashed_int(F.lit(seed), F.lit("c"), F.col("id")) % max(2, int(math.sqrt(n) / 2))
        part = lambda axis: uniform(seed, f"centre{axis}", centre) + 0.03 * normal(seed, axis, F.col("id"))
        return ids.select("id", F.array(part("x"), part("y")).alias("coords"))
    raise ValidationError("kind must be random, clustered or grid")


def synthetic_panel(spark: SparkSession, n: int, variables: int = 1, periods: int = 1, seed: int = 12345, missing: bool = False) -> DataFrame:
    """(id, variable, period, value): standard normal; ``missing`` makes every max(1, n // 10)-th value of variable 0, period 0 NaN."""
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(variables - 1))).alias("variable"))
    rows = rows.select("id", "variable", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("period"))
    value = normal(seed, F.col("id"), F.col("variable"), F.col("period"))
    if missing:
        gap = (F.col("variable") == 0) & (F.col("period") == 0) & (F.col("id") % max(1, n // 10) == 0)
        value = F.when(gap, float("nan")).otherwise(value)
    return rows.withColumn("value", value)
