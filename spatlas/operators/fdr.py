"""Multiple testing. Values that tie share their largest rank, so the work is done on distinct p-values with counts.

Permutation p-values take at most R / 2 + 1 values, whatever the number of tests; the ranked table is that small. Others are ranked
over ranges of p-values: each range is numbered and accumulated by itself and then shifted by what the ranges before (or after) it hold, so no
task gathers a family."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatlas.schema import ValidationError
from spatlas.storage import stored

METHODS = ("bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "hommel", "fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky")
#: Distinct p-values that one task ranks.
RANKED_A_TASK = 1_000_000


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed for few terms, by its asymptotic series for many."""
    x = m.cast("double")
    series = F.log(x) + float(np.euler_gamma) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(m < 64, F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(m, F.lit(64))), F.lit(0.0), lambda s, i: s + 1 / i)).otherwise(series)


def _accumulate(ranked: DataFrame, keys: list[str], name: str, value: Column, aggregate: Callable[[Column], Column], merge: Callable[..., Column], descending: bool) -> DataFrame:
    """``ranked`` with ``name``: the aggregate of ``value`` over the family's p-values up to (from, if descending) each one."""
    order = (F.desc if descending else F.asc)("_p")
    inner = ranked.withColumn("_v", value)
    running = inner.withColumn(name, aggregate(F.col("_v")).over(Window.partitionBy("_part", *keys).orderBy(order)))
    parts = inner.groupBy("_part", *keys).agg(aggregate(F.col("_v")).alias("_v"))  # a row for each range of a family
    outside = Window.partitionBy(*keys).orderBy((F.desc if descending else F.asc)("_part")).rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(F.col("_part").alias("_at"), *[F.col(c).alias(f"_at_{c}") for c in keys], aggregate(F.col("_v")).over(outside).alias("_shift"))
    same = F.col("_part") == F.col("_at")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    return running.join(shifts, same).withColumn(name, merge(F.col(name), F.col("_shift"))).drop("_v", "_at", "_shift", *[f"_at_{c}" for c in keys])


def _plus(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0).cast("long"))


def _ranked(pvalues: DataFrame, keys: list[str], p: str) -> DataFrame:
    """A row for each distinct p-value of a family: _count, _rank (the largest of ties), _m, and _part, the range that it is in."""
    counts = stored(pvalues.groupBy(*keys, F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_count")), "p-values")
    parts = -(-counts.count() // RANKED_A_TASK)
    if parts > 1:
        ranged = stored(counts.repartitionByRange(parts, *keys, "_p").withColumn("_part", F.spark_partition_id()), "ranked")
        ranked = _accumulate(ranged, keys, "_rank", F.col("_count"), F.sum, _plus, False)
        sizes = ranged.groupBy(*keys).agg(F.sum("_count").alias("_m"))
    else:
        counts = counts.coalesce(1).withColumn("_part", F.lit(0))
        ranked = counts.withColumn("_rank", F.sum("_count").over(Window.partitionBy(*keys, "_part").orderBy("_p")))
        return ranked.withColumn("_m", F.sum("_count").over(Window.partitionBy(*keys, "_part")))
    if not keys:
        return ranked.crossJoin(sizes)
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in keys]
    return ranked.join(sizes.select("_m", *[F.col(c).alias(f"_m_{c}") for c in keys]), same).drop(*[f"_m_{c}" for c in keys])


def _step_up(ranked: DataFrame, keys: list[str], raw: Column) -> DataFrame:
    return _accumulate(ranked, keys, "q", raw, F.min, F.least, True).withColumn("q", F.least(F.lit(1.0), "q"))


def _step_down(ranked: DataFrame, keys: list[str], raw: Column) -> DataFrame:
    return _accumulate(ranked, keys, "q", raw, F.max, F.greatest, False).withColumn("q", F.least(F.lit(1.0), "q"))


def _sidak(p: Column, m: Column) -> Column:
    return F.when(p >= 1, 1.0).otherwise(-F.expm1(m * F.log1p(-p)))


# ---------------------------------------------------------------- Hommel
def _lower_hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """The points (x ascending) on the lower convex hull."""
    hull: list[int] = []
    for k in range(len(x)):
        while len(hull) > 1 and (y[hull[-1]] - y[hull[-2]]) * (x[k] - x[hull[-2]]) >= (y[k] - y[hull[-2]]) * (x[hull[-1]] - x[hull[-2]]):
            hull.pop()
        hull.append(k)
    return hull


def _hull(table: pa.Table) -> pa.Table:
    table = table.sort_by("_rank")
    return table.take(pa.array(_lower_hull(table.column("_rank").to_numpy().astype(float), table.column("_p").to_numpy())))


def _simes_of_largest(i: np.ndarray, m: int, rank: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The Simes p-value of the i largest p-values: i times the least slope from (m - i, 0) to a point of the hull right of it; 0 for more than m."""
    out = np.zeros(len(i))
    for k, size in enumerate(i):
        if 0 < size <= m:
            right = np.searchsorted(rank, m - size, "right")
            low, high = right, len(rank) - 1
            while low < high:  # along a convex hull slopes from outside fall, then rise
                middle = (low + high) // 2
                if p[middle] * (rank[middle + 1] - m + size) > p[middle + 1] * (rank[middle] - m + size):
                    low = middle + 1
                else:
                    high = middle
            out[k] = size * p[low] / (rank[low] - m + size)
    return out


def _hommel(batches):
    """The least level at which a p-value is rejected: min over i of max(Simes of the i + 1 largest, i times p), found by bisection."""
    for batch in batches:
        m, q = batch.column("_m").to_numpy(), batch.column("_p").to_numpy(zero_copy_only=False)
        out = np.ones(len(q))
        hulls = {}
        for k, hull in enumerate(batch.column("_hull").to_pylist()):
            name = (m[k], len(hull), hull[0]["_p"], hull[-1]["_p"], hull[len(hull) // 2]["_p"])
            rank, p = hulls.setdefault(name, (np.array([h["_rank"] for h in hull], float), np.array([h["_p"] for h in hull])))
            low, high = 0, int(m[k])
            while low < high:
                middle = (low + high) // 2
                if _simes_of_largest(np.array([middle + 1]), int(m[k]), rank, p)[0] <= middle * q[k]:
                    high = middle
                else:
                    low = middle + 1
            near = np.array([low - 1, low])
            out[k] = min(1.0, np.maximum(_simes_of_largest(near + 1, int(m[k]), rank, p), near * q[k])[0 if low else 1 :].min())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_hull"), pa.array(out)], names=[*(c for c in batch.schema.names if c != "_hull"), "q"])


def _by_hommel(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Each range keeps the lower hull of its (rank, p), families the hull of those: a few points, whatever their size."""
    small = ranked.select("_part", *keys, "_rank", "_p")
    hulls = small.groupBy("_part", *keys).applyInArrow(_hull, small.schema)
    hulls = hulls.groupBy(*keys).applyInArrow(_hull, small.schema)
    packed = hulls.groupBy(*[F.col(c).alias(f"_h_{c}") for c in keys]).agg(F.sort_array(F.collect_list(F.struct("_rank", "_p"))).alias("_hull"))
    same = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in keys]
    joined = ranked.join(packed, same).drop(*[f"_h_{c}" for c in keys]) if keys else ranked.crossJoin(packed)
    schema = T.StructType([*joined.drop("_hull").schema.fields, T.StructField("q", T.DoubleType())])
    return joined.mapInArrow(_hommel, schema)


def adjust_pvalues(pvalues: DataFrame, method: str = "fdr_bh", alpha: float = 0.05, keys: list[str] | None = None, p: str = "p") -> DataFrame:
    """``pvalues`` with p_adjusted and reject; each group of ``keys`` is a family of its own, null a key like others. ``alpha`` is the level of
    reject, and of the first stage of the two-stage methods."""
    keys = keys or []
    if method not in METHODS:
        raise ValidationError(f"method must be one of {METHODS}")
    x = F.col(p).cast("double")
    if pvalues.where(x.isNull() | F.isnan(x) | (x < 0) | (x > 1)).limit(1).count():
        raise ValidationError("p-values must be finite and between 0 and 1")
    ranked, v, m, k = _ranked(pvalues, keys, p), F.col("_p"), F.col("_m"), F.col("_rank")
    first = k - F.col("_count") + 1  # of ties, the smallest rank decides where a step-down method multiplies most
    if method == "bonferroni":
        found = ranked.withColumn("q", F.least(F.lit(1.0), v * m))
    elif method == "sidak":
        found = ranked.withColumn("q", _sidak(v, m))
    elif method == "holm":
        found = _step_down(ranked, keys, v * (m - first + 1))
    elif method == "holm-sidak":
        found = _step_down(ranked, keys, _sidak(v, m - first + 1))
    elif method == "simes-hochberg":
        found = _step_up(ranked, keys, v * (m - k + 1))
    elif method == "hommel":
        found = _by_hommel(ranked, keys)
    elif method == "fdr_by":
        found = _step_up(ranked, keys, v * m / k * harmonic(m))
    else:
        found = _step_up(ranked, keys, v * m / k)
        if method in ("fdr_tsbh", "fdr_tsbky"):  # a first step tells how many hypotheses hold
            factor = 1 + alpha if method == "fdr_tsbky" else 1.0
            rejected = F.sum(F.when(F.col("q") <= alpha / factor, F.col("_count")).otherwise(0)).alias("_r1")
            counted = found.groupBy(*[F.col(c).alias(f"_r_{c}") for c in keys]).agg(rejected)
            same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
            found = found.join(counted, same) if keys else found.crossJoin(counted)
            left = F.when(F.col("_r1") == m, 1.0).otherwise((m - F.col("_r1")) / m)
            found = found.withColumn("q", F.least(F.lit(1.0), F.col("q") * left * factor))
    small = found.select(*[F.col(c).alias(f"_q_{c}") for c in keys], F.col("_p").alias("_q"), F.col("q").alias("p_adjusted"))
    same = x == F.col("_q")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return pvalues.join(small, same).drop("_q", *[f"_q_{c}" for c in keys]).withColumn("reject", F.col("p_adjusted") <= alpha)
