"""Result frames, one-line summaries, and the runs that check and time the engine on small inputs."""

from __future__ import annotations

import platform
import time

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spatlas.operators import lag, moran, weights
from spatlas.plans import runners
from spatlas.schema import ValidationError
from spatlas.sources.synthetic import synthetic_coordinates, synthetic_panel
from spatlas.storage import stored

FRAME = ["id", "local_I", "z", "lag", "quadrant_code", "quadrant", "p_sim", "p_fdr", "significant", "significant_fdr", "cluster", "cluster_fdr", "backend"]
#: Observations of a run that is checked against dense matrices on the driver.
DENSE = 3000


def local_frame(found: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Local inference as a table of 13 columns. ``labels`` (id, label) must name every observation once; its labels replace the ids."""
    out = found.withColumnsRenamed({"local_i": "local_I", "spatial_lag": "lag"}).withColumn("backend", F.lit("spark"))
    if labels is not None:
        n, met = found.count(), found.join(labels, "id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
        if not n == met.n == met.ids == labels.count():
            raise ValidationError("labels must match the observations one to one")
        out = out.join(labels, "id").withColumn("id", F.col("label")).drop("label")
    return out.select(*FRAME)


def local_summary(found: DataFrame) -> str:
    row = found.agg(F.count("*").alias("n"), F.count_if("significant").alias("k")).first()
    return f"local Moran: n = {row.n}, significant = {row.k}"


def global_summary(row: Row) -> str:
    p = row.p_sim if "p_sim" in row else None
    return f"Moran: I = {row.I:.6g}, EI = {row.EI:.6g}, p_sim = {p}"


def memory_diagnostics(spark: SparkSession) -> dict:
    """Free and total bytes of storage memory over the driver and all executors."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().toList()
    sizes = [(status.apply(k)._1(), status.apply(k)._2()) for k in range(status.size())]
    return {"backend": "spark", "holders": len(sizes), "total_bytes": sum(t for t, _ in sizes), "free_bytes": sum(f for _, f in sizes)}


def validation_run(edges: DataFrame, values: DataFrame, permutations: int = 999, seed: int = 12345) -> dict:
    """Differences of lag, global and local statistics from dense NumPy matrices, and of shared from independent draws' p-values.
    ``deterministic`` says that the first three are below 1e-10. For up to 3,000 observations."""
    ids = [r.id for r in values.select("id").orderBy("id").limit(DENSE + 1).collect()]
    if len(ids) > DENSE:
        raise ValidationError(f"a validation run is for up to {DENSE} observations")
    at, w = {i: k for k, i in enumerate(ids)}, np.zeros((len(ids), len(ids)))
    for r in edges.collect():
        w[at[r.i], at[r.j]] = r.w
    y = np.zeros(len(ids))
    for r in values.collect():
        y[at[r.id]] = r.value
    z = (y - y.mean()) / y.std()
    began = time.perf_counter()
    whole = runners.moran_permutations(edges, values, permutations, seed).first()
    seconds = {"global": time.perf_counter() - began}
    began = time.perf_counter()
    local = {at[r.id]: r for r in runners.moran_local_inference(edges, values, permutations, seed).collect()}
    seconds["local"] = time.perf_counter() - began
    own = {at[r.id]: r.p_sim for r in runners.moran_local_inference(edges, values, permutations, seed, draws="independent").select("id", "p_sim").collect()}
    lags = {at[r.id]: r.lag for r in lag.spatial_lag(edges, values).collect()}
    n, near = len(ids), w @ z
    code = np.where(z > 0, np.where(near > 0, 1, 4), np.where(near > 0, 2, 3))
    out = {
        "n": n, "seed": seed, "lag_max_abs_difference": float(max(abs(lags[k] - (w @ y)[k]) for k in range(n))), "global_I": whole.I, "global_p_sim": whole.p_sim,
        "global_I_abs_difference": float(abs(whole.I - n / w.sum() * (z @ near) / (z @ z))), "local_I_max_abs_difference": float(max(abs(local[k].local_i - (n - 1) * z[k] * near[k] / n) for k in range(n))),
        "quadrant_mismatches": int(sum(local[k].quadrant_code != code[k] for k in range(n))), "local_p_mean_abs_difference": float(np.mean([abs(local[k].p_sim - own[k]) for k in range(n)])), "timings": seconds,
    }
    out["deterministic"] = all(out[c] < 1e-10 for c in ("lag_max_abs_difference", "global_I_abs_difference", "local_I_max_abs_difference"))
    return out


def baseline_run(kinds: dict[str, DataFrame], values: DataFrame, permutations: tuple[int, ...] = (99, 999), seed: int = 12345) -> list[dict]:
    """A row for each weights table and number of permutations: size, density, statistics, significant observations and seconds."""
    out, n = [], values.count()
    for name, edges in kinds.items():
        edges = stored(edges, "edges")
        nnz = edges.count()
        for r in permutations:
            began = time.perf_counter()
            whole = runners.moran_permutations(edges, values, r, seed).first()
            significant = runners.moran_local_inference(edges, values, r, seed).where("significant").count()
            out.append({"weight": name, "n": n, "nnz": nnz, "density": nnz / n**2, "permutations": r, "seed": seed, "global_I": whole.I, "global_p": whole.p_sim, "local_significant": significant, "elapsed_seconds": time.perf_counter() - began})
    return out


def benchmark_run(spark: SparkSession, sizes: tuple[int, ...] = (500, 1793), permutations: int = 999, repetitions: int = 3, seed: int = 12345) -> dict:
    """Seconds of inverse-distance construction, of a lag, and of a permuted global statistic over synthetic points, with the weights' diagnostics."""
    rows = []
    for n in sizes:
        points = stored(synthetic_coordinates(spark, n, seed=seed), "points")
        values = points.select("id", F.randn(seed).alias("value"))
        values = stored(values, "values")
        began = time.perf_counter()
        edges = stored(weights.inverse_distance_weights(points), "edges")
        built = time.perf_counter() - began
        shape = weights.weight_diagnostics(edges, points).first().asDict()
        rows.append({"operation": "inverse_distance_and_lag", "n": n, "construction_total_seconds": built, **shape, **runners.benchmark_call(lambda e=edges, v=values: lag.spatial_lag(e, v), repetitions)})
        rows.append({"operation": f"global_moran_{permutations}", "n": n, **runners.benchmark_call(lambda e=edges, v=values: runners.moran_permutations(e, v, permutations, seed), repetitions)})
    return {"platform": platform.platform(), "seed": seed, "results": rows}


def panel_benchmark(spark: SparkSession, n: int = 500, variables: int = 10, periods: int = 4, permutations: int = 99, repetitions: int = 3) -> dict:
    """Seconds of a whole panel's statistics with permutations, in one plan."""
    edges = stored(weights.inverse_distance_weights(synthetic_coordinates(spark, n)), "edges")
    values = stored(synthetic_panel(spark, n, variables, periods), "panel")
    return runners.benchmark_call(lambda: runners.moran_panel(edges, values, permutations), repetitions)
