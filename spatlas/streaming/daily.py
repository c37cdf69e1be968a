"""Observed global Moran's I of each day that arrives: an extension, not part of the batch surface.

Each micro-batch holds whole days (one file a day), so the statistic of a day needs no state between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.operators.moran import moran_global_raster
from spatlas.operators.stencil import RasterOperator, Stencil, queen


def stream_days(spark: SparkSession, folder: str, schema: str, grid: DataFrame, output: str, checkpoint: str, stencil: Stencil | None = None, value: str = "ntl"):
    """Starts a query that appends (day, n, islands, s0, I, EI) to ``output``; ``schema`` names cell_id, day and the value."""
    days = spark.readStream.schema(schema).parquet(folder)

    def each(batch: DataFrame, epoch: int) -> None:
        cells = batch.join(grid.select("cell_id", F.col("grid_row").alias("row"), F.col("grid_col").alias("col")), "cell_id")
        known = cells.withColumn("valid", F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        moran_global_raster(RasterOperator(known, stencil or queen(), keys=("day",)), value).write.mode("append").parquet(f"{output}/epoch={epoch}")

    return days.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
