"""Rasters from two Parquet tables: the grid's topology, and one day's values by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.schema import ValidationError, is_finite, require_columns


def one_to_one(grid: DataFrame, daily: DataFrame, key: str = "cell_id") -> DataFrame:
    """One row: ids that repeat in either table, and ids that are in one of them only."""
    twice = lambda df, n: df.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias(n))
    lone = lambda a, b, n: a.select(key).join(b.select(key), key, "left_anti").agg(F.count("*").alias(n))
    left = twice(grid, "grid_repeats").crossJoin(twice(daily, "daily_repeats"))
    return left.crossJoin(lone(grid, daily, "grid_only")).crossJoin(lone(daily, grid, "daily_only"))


def raster(grid: DataFrame, daily: DataFrame, value: str = "ntl", check: bool = True) -> DataFrame:
    """Cells (cell_id, grid_row, grid_col, row, col, value, valid). Rows and columns count from the grid's corner; a null or
    non-finite value is NoData (valid = false), zero is a value; a hole has no row."""
    require_columns(grid, ["cell_id", "grid_row", "grid_col"], "grid")
    require_columns(daily, ["cell_id", value], "daily table")
    grid, daily = grid.select("cell_id", "grid_row", "grid_col"), daily.select("cell_id", F.col(value).cast("double").alias("value"))
    if check:
        found = one_to_one(grid, daily).first().asDict()
        if any(found.values()):
            raise ValidationError(f"grid and daily cells aren't one to one: {found}")
        if grid.groupBy("grid_row", "grid_col").count().where("count > 1").limit(1).count():
            raise ValidationError("grid positions repeat")
    corner = grid.agg(F.min("grid_row").alias("_r"), F.min("grid_col").alias("_c"))
    cells = grid.join(daily, "cell_id").crossJoin(corner)
    valid = is_finite(F.col("value"))
    place = [(F.col("grid_row") - F.col("_r")).alias("row"), (F.col("grid_col") - F.col("_c")).alias("col")]
    return cells.select("cell_id", "grid_row", "grid_col", *place, F.when(valid, F.col("value")).alias("value"), valid.alias("valid"))


def read_raster(spark: SparkSession, grid_path: str, daily_path: str, value: str = "ntl") -> DataFrame:
    """Only the columns that a raster needs are read; a daily path may be a ``year=/month=`` folder, which is pruned as such."""
    return raster(spark.read.parquet(grid_path), spark.read.parquet(daily_path), value)


def transformed(cells: DataFrame, name: str = "log1p", scale: float = 1.0, value: str = "value") -> DataFrame:
    """The raster with log(scale * value + 1); a negative valid value raises."""
    if name != "log1p":
        raise ValidationError("the only transform is log1p")
    if cells.where(F.col("valid") & (F.col(value) < 0)).limit(1).count():
        raise ValidationError("log1p needs values that aren't negative")
    return cells.withColumn(value, F.log1p(F.col(value) * scale if scale != 1 else F.col(value)))


def summary(cells: DataFrame) -> DataFrame:
    """One row: cells, valid and missing ones, origin and shape."""
    r, c = F.col("grid_row"), F.col("grid_col")
    return cells.agg(
        F.count("*").alias("n_cells"), F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_missing"), F.min(r).alias("origin_row"), F.min(c).alias("origin_col"),
        (F.max(r) - F.min(r) + 1).alias("height"), (F.max(c) - F.min(c) + 1).alias("width"),
    )
