"""Checks of inputs: each is one aggregation, raised on the driver before anything else runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(ValueError):
    """Input that no statistic is defined for."""


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValidationError(f"{what} lacks the columns {missing}; it has {df.columns}")


def require_numeric(df: DataFrame, column: str) -> None:
    kind = df.schema[column].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{column} must be numeric, not {kind.simpleString()}")


def is_finite(value: Column) -> Column:
    x = value.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def validate_values(values: DataFrame, keys: list[str] | None = None, *, value: str = "value", n: int | None = None, allow_constant: bool = False) -> None:
    """Values by id (and variable, period): numeric, finite, ``n`` in each group, not constant. Missing values are never zero."""
    require_columns(values, ["id", value, *(keys or [])], "values")
    require_numeric(values, value)
    x = F.col(value).cast("double")
    groups = values.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if(~is_finite(F.col(value))).alias("bad"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_distinct("id").alias("ids"))
    found = groups.agg(F.sum("bad").alias("bad"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("low") == F.col("high")).alias("constant"), F.count_if(F.col("ids") != F.col("n")).alias("repeated")).first()
    if not found.least:
        raise ValidationError("no values")
    if found.bad:
        raise ValidationError(f"{found.bad} values are missing, NaN or infinite")
    if found.repeated:
        raise ValidationError("ids repeat within a variable and period")
    if found.least != found.most or n is not None and found.most != n:
        raise ValidationError(f"every variable and period needs {n or found.most} values; one has {found.least}")
    if found.constant and not allow_constant:
        raise ValidationError("constant values have no autocorrelation")


def validate_edges(edges: DataFrame, ids: DataFrame) -> int:
    """The number of ids of a square weights table whose endpoints are all among them."""
    require_columns(edges, ["i", "j", "w"], "weights")
    ends = edges.select(F.col("i").alias("id")).union(edges.select(F.col("j").alias("id"))).distinct()
    if ends.join(ids.select("id"), "id", "left_anti").limit(1).count():
        raise ValidationError("weights have ids that aren't in the id table, so they aren't square")
    return ids.count()


def validate_coordinates(points: DataFrame) -> tuple[int, int]:
    """Rows and dimensions of points (id, coords): at least two, of one dimension at least, finite, none twice."""
    require_columns(points, ["id", "coords"], "coordinates")
    size = F.size("coords")
    bad = F.exists("coords", lambda x: ~is_finite(x))
    found = points.agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.count_if(bad).alias("bad")).first()
    if found.n < 2 or found.low != found.high or found.low < 1:
        raise ValidationError("coordinates need two rows and one dimension at least, the same for all")
    if found.bad:
        raise ValidationError("coordinates must be finite")
    if points.groupBy("coords").count().where("count > 1").limit(1).count():
        raise ValidationError("coordinates repeat")
    return found.n, found.low


def require_permutations(permutations: int, seed: int | None) -> None:
    if permutations < 1:
        raise ValidationError("permutations must be at least 1")
    if seed is None:
        raise ValidationError("permutations need a seed")
