"""Jobs that compose the operators: observed runs over transforms and stencils, permutation runs, panels, diagnostics, timings."""

from __future__ import annotations

import platform
import statistics
import time
from collections.abc import Callable
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.operators import moran as m
from spatlas.operators import permute
from spatlas.operators.stencil import RasterOperator, inverse_distance, queen, rook
from spatlas.schema import validate_edges
from spatlas.sinks import write_local_parquet
from spatlas.sources.raster import transformed
from spatlas.storage import stored, with_positions

def observed_run(cells: DataFrame, output: str | None = None, scale: float = 1.0) -> DataFrame:
    """Global statistics and quadrant counts of the raw and log1p values under rook, queen and inverse distance; local results go to ``output``."""
    out = None
    for name, raster in (("raw", cells), ("log1p", transformed(cells, "log1p", scale))):
        for stencil in (rook(), queen(), inverse_distance(2)):
            whole, local = m.moran_observed(RasterOperator(raster, stencil))
            counts = m.class_counts(local, F.col("valid") & ~F.col("island"))
            row = whole.crossJoin(counts).select(F.lit(name).alias("transform"), F.lit(stencil.name).alias("stencil"), "*")
            out = row if out is None else out.unionByName(row)
            if output:
                write_local_parquet(local, f"{output}/{name}_{stencil.name}")
    return out


def raster_global_permutations(operator: RasterOperator, permutations: int = 999, seed: int = 12345, value: str = "value", keep: bool = False) -> DataFrame:
    """Values are shuffled over valid cells only. ``keep`` gives the replicates (rep, sim) instead; rep -1 is the observed statistic."""
    cells = stored(with_positions(operator.cells.where("valid"), ["row", "col"]).select("row", "col", "pos", F.col(value).alias("value"), F.lit(True).alias("valid")), "positions")
    edges = RasterOperator(cells, operator.stencil, operator.normalization).edges("pos")
    return _vector_permutations(stored(edges, "edges"), cells, permutations, seed, keep)


def _vector_permutations(edges: DataFrame, values: DataFrame, permutations: int, seed: int, keep: bool) -> DataFrame:
    if keep:
        return permute.simulate_global(edges, values.withColumn("series", F.lit(0)), permutations, seed).select("rep", "sim")
    return permute.global_permutations(edges, values, permutations, seed)


def _placed(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids with dense positions, and edges between positions."""
    ids = stored(with_positions(values.select("id").distinct(), ["id"]), "ids")
    validate_edges(edges, ids)
    near = edges.join(ids.select(F.col("id").alias("i"), F.col("pos").alias("pi")), "i").join(ids.select(F.col("id").alias("j"), F.col("pos").alias("pj")), "j")
    return ids, stored(near.select(F.col("pi").alias("i"), F.col("pj").alias("j"), "w"), "edges")


def moran_permutations(edges: DataFrame, values: DataFrame, permutations: int = 999, seed: int = 12345, keep: bool = False) -> DataFrame:
    """Global Moran's I of a vector (id, value) with analytic moments and permutation inference in one row; ``keep`` gives the replicates (rep, sim)."""
    ids, placed = _placed(edges, values)
    found = _vector_permutations(placed, values.join(ids, "id").select("pos", "value"), permutations, seed, keep)
    return found if keep else m.moran(edges, values).crossJoin(found.drop("observed"))


def raster_local(operator: RasterOperator, permutations: int = 0, seed: int | None = 12345, fdr: bool = True, alpha: float = 0.05, draws: str = "shared", value: str = "value") -> DataFrame:
    """Local results, with inference if permutations are asked for. Each group of the raster's batch axes shuffles and is adjusted by itself."""
    shared = stored(m.raster_components(operator, value), "components")
    local = m._local(shared)
    if not permutations:
        return local
    keys = operator.keys
    tests = permute.local_raster_permutations(operator, shared, permutations, seed, draws).select(*keys, "row", "col", "n_at_least", "p_sim", "permutation_mean", "permutation_std", "min_sim", "max_sim", "z_sim")
    return local.join(permute.with_inference(stored(tests, "tests"), alpha, fdr, keys), [*keys, "row", "col"], "left")


def moran_local_inference(edges: DataFrame, values: DataFrame, permutations: int = 999, seed: int = 12345, fdr: bool = True, alpha: float = 0.05, keys: list[str] | None = None, draws: str = "shared") -> DataFrame:
    """Local Moran of a vector (id, value) or, with ``keys``, of a panel, with conditional permutations.

    Each variable and period shuffles under the seed plus its index in their order, and is a family of tests of its own."""
    keys = keys or []
    ids, placed = _placed(edges, values)
    card = placed.where("i <> j").groupBy("i").count().agg(F.max("count")).first()[0] or 0
    series = permute.batches(values, keys)
    local = m.moran_local(edges, values, keys).join(ids, "id")
    local = local.join(F.broadcast(series), keys) if keys else local.withColumn("series", F.lit(0))
    none = F.array_repeat(F.lit(0.0), card)
    cells = local.join(permute.padded_neighbours(placed, card), "pos", "left").withColumns({"weights": F.coalesce("weights", none), "own": F.coalesce("own", F.lit(0.0)), "obs": F.col("local_i")})
    cells = stored(cells, "focal")
    tests = stored(permute.local_permutations(cells, cells.select("series", "pos", "z"), card, permutations, seed, draws), "tests")
    return permute.with_inference(tests.drop("weights", "own", "obs", "pos", "series"), alpha, fdr, keys)


def moran_panel(edges: DataFrame, values: DataFrame, permutations: int = 0, seed: int = 12345) -> DataFrame:
    """One row a variable and period (id, variable, period, value); each series shuffles under seed + its index in their order."""
    keys = ["variable", "period"]
    found = m.moran(edges, values, keys)
    if not permutations:
        return found
    ids, placed = _placed(edges, values)
    series = F.broadcast(permute.batches(values, keys))
    placed_values = stored(values.join(series, keys).join(ids, "id").select("series", "pos", "value"), "series")
    tests = permute.panel_permutations(placed, placed_values, permutations, seed).join(series, "series").drop("series", "observed")
    return found.join(tests, keys)


def benchmark_call(action: Callable[[], DataFrame], repetitions: int = 5) -> dict:
    """Cold and warm seconds of running a plan to its end without a sink."""
    seconds = []
    for _ in range(repetitions + 1):
        began = time.perf_counter()
        action().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    warm = seconds[1:] or seconds
    return {"repetitions": repetitions, "cold": seconds[0], "median": statistics.median(warm), "min": min(warm), "max": max(warm), "mean": statistics.fmean(warm), "std": statistics.pstdev(warm)}


def diagnostics(spark: SparkSession) -> dict:
    """Versions, layout and memory of the session."""
    packages = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        packages[name] = metadata.version(name)
    conf = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.checkpoint.dir", "spark.executor.memory", "spark.driver.memory")}
    return {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "packages": packages, "conf": conf}
