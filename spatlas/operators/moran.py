"""Global and local Moran statistics over edge tables and rasters, for one variable or a whole panel in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatlas.functions import quadrant, quadrant_label, two_sided_p
from spatlas.operators.lag import spatial_lag
from spatlas.operators.stencil import RasterOperator
from spatlas.operators.weights import weight_moments
from spatlas.schema import is_finite, require_columns, require_numeric


def _checked_sums(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard deviation and size of each group. A group that no statistic is defined for fails the plan as it is read: values
    must be finite, at least two, and not all equal. The check is part of the same aggregation, so it costs no further pass."""
    x = F.col(value).cast("double")
    sums = values.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"), F.count("*").alias("_n"), F.count_if(~is_finite(F.col(value))).alias("_bad"), F.min(x).alias("_low"), F.max(x).alias("_high"))
    fault = F.when(F.col("_bad") > 0, "values are missing, NaN or infinite").when(F.col("_n") < 2, "two values are needed at least").when(F.col("_low") == F.col("_high"), "constant values have no autocorrelation")
    return sums.withColumn("_mean", F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("_mean"))).drop("_bad", "_low", "_high")


def _with_sums(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values with their group's checked sums; one row a group, joined back (a small table of groups)."""
    require_columns(values, ["id", value, *keys], "values")
    require_numeric(values, value)
    sums = _checked_sums(values, keys, value)
    return values.join(sums, keys) if keys else values.crossJoin(sums)


def _analytic(n: Column, s0: Column, s1: Column, s2: Column, m2: Column, m4: Column, i: Column) -> list[Column]:
    """EI, both variances, and z of the normal one. m2, m4: mean square and mean fourth power of the deviations."""
    ei = -1.0 / (n - 1)
    normal = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n - 1) * (n + 1) * s0 * s0) - ei * ei
    kurtosis = m4 / (m2 * m2)
    top = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - kurtosis * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    random = F.when(n > 3, top / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - ei * ei).otherwise(float("nan"))
    return [ei.alias("EI"), normal.alias("VI_norm"), random.alias("VI_rand"), ((i - ei) / F.sqrt(normal)).alias("z_norm")]


def moran(edges: DataFrame, values: DataFrame, keys: list[str] | None = None, value: str = "value", with_p: bool = True) -> DataFrame:
    """One row a group of ``keys``: n, I, EI, VI_norm, VI_rand, z_norm, and p_norm (two-sided). Weight moments are taken once for all groups."""
    keys = keys or []
    centred = _with_sums(values, keys, value).withColumn("z", F.col(value).cast("double") - F.col("_mean")).select("id", *keys, "z")
    lagged = spatial_lag(edges, centred, keys, "z")
    z = F.col("z")
    sums = lagged.groupBy(*keys).agg(F.sum(z * F.col("lag")).alias("_zl"), F.sum(z * z).alias("_zz"), F.sum(z * z * z * z).alias("_z4"))
    moments = weight_moments(edges, values.select("id").distinct())
    moments = moments.withColumn("s0", F.when(F.coalesce("s0", F.lit(0.0)) == 0, F.raise_error(F.lit("all weights sum to zero")).cast("double")).otherwise(F.col("s0")))
    both = sums.crossJoin(moments)
    n, s0 = F.col("n").cast("double"), F.col("s0")
    found = both.withColumn("I", n / s0 * F.col("_zl") / F.col("_zz"))
    out = found.select(*keys, "n", "I", *_analytic(n, s0, F.col("s1"), F.col("s2"), F.col("_zz") / n, F.col("_z4") / n, F.col("I")))
    return out.withColumn("p_norm", two_sided_p("z_norm")) if with_p else out


def moran_local(edges: DataFrame, values: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Each id's z, lag, local_i and quadrant (an island's lag of 0 puts it in 3 or 4)."""
    keys = keys or []
    scaled = _with_sums(values, keys, value).withColumn("z", (F.col(value).cast("double") - F.col("_mean")) / F.col("_sd"))
    lagged = spatial_lag(edges, scaled.select("id", *keys, "z", "_n"), keys, "z")
    # z has unit variance, so its squares sum to n
    local = (F.col("_n") - 1) * F.col("z") * F.col("lag") / F.col("_n") + F.lit(0.0)
    code = quadrant(F.col("z"), F.col("lag"))
    return lagged.select("id", *keys, "z", F.col("lag").alias("spatial_lag"), local.alias("local_i"), code.alias("quadrant_code"), quadrant_label(code).alias("quadrant"))


# ---------------------------------------------------------------- rasters
def raster_components(operator: RasterOperator, value: str = "value") -> DataFrame:
    """Cells with z (population scale over valid cells) and its lag: what global and local statistics share."""
    keys = operator.keys
    valid = operator.cells.where("valid")
    sums = _checked_sums(valid, keys, value)
    cells = operator.cells.join(sums, keys) if keys else operator.cells.crossJoin(sums)
    z = F.when(F.col("valid"), (F.col(value).cast("double") - F.col("_mean")) / F.col("_sd"))
    return RasterOperator(cells.withColumn("z", z), operator.stencil, operator.normalization, tuple(keys)).apply("z")


def _global(components: DataFrame, operator: RasterOperator) -> DataFrame:
    weight = F.when(F.col("raw_weight") > 0, 1.0).otherwise(0.0) if operator.normalization == "row" else F.col("raw_weight")
    z = F.col("z")
    sums = components.where("valid").groupBy(*operator.keys).agg(F.count("*").alias("n"), F.sum(weight).alias("s0"), F.count_if("island").alias("islands"), F.sum(z * F.col("lag")).alias("_zl"), F.sum(z * z).alias("_zz"))
    moran_i = F.col("n") / F.col("s0") * F.col("_zl") / F.col("_zz")
    return sums.select(*operator.keys, "n", "islands", "s0", moran_i.alias("I"), (-1.0 / (F.col("n") - 1)).alias("EI"))


def _local(components: DataFrame) -> DataFrame:
    z, lag, n = F.col("z"), F.col("lag"), F.col("_n")
    local = F.when(F.col("valid"), (n - 1) * z * lag / n + F.lit(0.0))
    code = F.when(F.col("valid") & ~F.col("island"), quadrant(z, lag)).otherwise(0).cast("byte")
    label = quadrant_label(F.when(F.col("island"), 5).otherwise(code))
    return components.withColumn("local_i", local).withColumn("spatial_lag", F.when(F.col("valid"), lag)).withColumn("quadrant_code", code).withColumn("quadrant", label).drop("_mean", "_sd", "_n", "lag")


def moran_global_raster(operator: RasterOperator, value: str = "value") -> DataFrame:
    return _global(raster_components(operator, value), operator)


def moran_local_raster(operator: RasterOperator, value: str = "value") -> DataFrame:
    """Cells with z, spatial_lag, local_i, quadrant_code (0: island or not valid), quadrant and island; invalid cells' statistics are null."""
    return _local(raster_components(operator, value))


def moran_observed(operator: RasterOperator, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Global and local statistics from one lag, which is written once and read by both."""
    from spatlas.storage import stored

    shared = stored(raster_components(operator, value), "components")
    return _global(shared, operator), _local(shared)


def quadrant_histogram(local: DataFrame) -> DataFrame:
    """(quadrant_code, n) for codes 0 to 4, zeros included."""
    codes = local.sparkSession.range(5).select(F.col("id").cast("byte").alias("quadrant_code"))
    return codes.join(local.groupBy("quadrant_code").agg(F.count("*").alias("n")), "quadrant_code", "left").select("quadrant_code", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_counts(local: DataFrame, selection: Column) -> DataFrame:
    """One row: how many of the selected cells are HH, LH, LL, HL."""
    return local.agg(*[F.count_if(selection & (F.col("quadrant_code") == k)).alias(n) for k, n in ((1, "HH"), (2, "LH"), (3, "LL"), (4, "HL"))])
