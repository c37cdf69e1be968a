"""Explicit weights as edge tables (i, j, w) beside an id table, so that ids without edges survive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatlas.operators import blocks
from spatlas.schema import ValidationError, validate_coordinates, validate_edges
from spatlas.storage import stored

STRATEGIES = ("auto", "catalyst", "bucket", "arrow")
#: Points up to which the catalyst strategy joins all pairs; more meet in blocks, which gives the same rows.
JOINED = 2048


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def _pairs_joined(points: DataFrame) -> DataFrame:
    a, b = points.select(F.col("id").alias("i"), F.col("coords").alias("_a")), points.select(F.col("id").alias("j"), F.col("coords").alias("_b"))
    return a.join(b, F.col("i") != F.col("j")).select("i", "j", squared_distance(F.col("_a"), F.col("_b")).alias("d2"))


def _extended_by(steps: Column, here: Column):
    return lambda corner: F.transform(steps, lambda s: F.concat(corner, F.array(here + s)))


def _pairs_in_buckets(points: DataFrame, threshold: float, dimensions: int) -> DataFrame:
    """Points within reach: cells of the threshold's size, each point meets the 3 ** d cells around it, by an equality join."""
    cell = F.transform("coords", lambda x: F.floor(x.cast("double") / threshold).cast("long"))
    steps = F.array(*[F.lit(s).cast("long") for s in (-1, 0, 1)])
    around = F.transform(steps, lambda s: F.array(F.col("cell")[0] + s))
    for k in range(1, dimensions):
        here = F.col("cell")[k]
        around = F.flatten(F.transform(around, _extended_by(steps, here)))
    held = points.select("id", "coords", cell.alias("cell"))
    left = held.select(F.col("id").alias("i"), F.col("coords").alias("_a"), F.explode(around).alias("cell"))
    right = held.select(F.col("id").alias("j"), F.col("coords").alias("_b"), "cell")
    near = left.join(right, "cell").where("i <> j").select("i", "j", squared_distance(F.col("_a"), F.col("_b")).alias("d2"))
    return near.where(F.col("d2") <= threshold * threshold)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """Ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _checked(points: DataFrame, threshold: float | None) -> tuple[int, int]:
    if threshold is not None and not threshold > 0:
        raise ValidationError("threshold must be positive")
    return validate_coordinates(points)


def neighbour_pairs(points: DataFrame, threshold: float | None = None, k: int | None = None, strategy: str = "auto") -> DataFrame:
    """(i, j, d2) of all pairs, those within ``threshold`` (inclusive), or each point's ``k`` nearest among all points, then within."""
    if strategy not in STRATEGIES:
        raise ValidationError(f"strategy must be one of {STRATEGIES}")
    n, dimensions = _checked(points, threshold)
    if k is not None and not 1 <= k < n:
        raise ValidationError("k must be at least 1 and below the number of points")
    if strategy == "bucket" and (threshold is None or k is not None):
        raise ValidationError("the bucket strategy is for distance bands")
    squared = None if threshold is None else threshold * threshold
    if strategy == "bucket":
        return _pairs_in_buckets(points, threshold, dimensions)
    if strategy == "catalyst" and n <= JOINED:
        pairs = _pairs_joined(points)
        if k is not None:
            pairs = _nearest(pairs, k)
        return pairs if squared is None else pairs.where(F.col("d2") <= squared)
    shared = blocks.hand_out(points, n, dimensions)
    if k is None:
        return blocks.pairs(points.sparkSession, shared, squared)
    pairs = stored(blocks.nearest(points.sparkSession, shared, k), "nearest")  # what standardizes or transforms them reads them twice and more
    return pairs if squared is None else pairs.where(F.col("d2") <= squared)


def row_standardized(edges: DataFrame) -> DataFrame:
    """Weights over their row's sum; rows that sum to 0 stay 0."""
    total = edges.groupBy("i").agg(F.sum("w").alias("_t"))
    return edges.join(total, "i").select("i", "j", F.when(F.col("_t") != 0, F.col("w") / F.col("_t")).otherwise(F.col("w")).alias("w"))


def inverse_distance_weights(points: DataFrame, power: float = 2.0, threshold: float | None = None, k: int | None = None, row_standardize: bool = True, binary: bool = False, strategy: str = "auto") -> DataFrame:
    """Weights d ** -power of points (id, coords); the diagonal is left out; ``binary`` weights are 1."""
    if not power > 0:
        raise ValidationError("power must be positive")
    pairs = neighbour_pairs(points, threshold, k, strategy)
    w = F.lit(1.0) if binary else (1.0 / F.col("d2") if power == 2 else F.pow("d2", F.lit(-power / 2)))
    edges = pairs.select("i", "j", w.alias("w"))
    return row_standardized(edges) if row_standardize else edges


def _weight(power: float, binary: bool):
    def weight(d2: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            return np.ones_like(d2) if binary else 1.0 / d2 if power == 2 else d2 ** (-power / 2)

    return weight


def row_summaries(points: DataFrame, power: float = 2.0, threshold: float | None = None, row_standardize: bool = True, binary: bool = False) -> DataFrame:
    """What the rows of ``inverse_distance_weights`` (same arguments) come to, without their edges: (i, n, sum_j, sum_w, sum_wj, min_w, max_w) of
    every point. Every pair is weighed, but within a task: the table has a row a point, where edges would be quadratic. Rows without neighbours
    have n = 0, sums of 0, and null as least and largest weight."""
    if not power > 0:
        raise ValidationError("power must be positive")
    n, dimensions = _checked(points, threshold)
    shared = blocks.hand_out(points, n, dimensions)
    sums = blocks.row_sums(points.sparkSession, shared, None if threshold is None else threshold * threshold, _weight(power, binary))
    if not row_standardize:
        return sums
    total = F.when(F.col("sum_w") != 0, F.col("sum_w")).otherwise(1.0)
    return sums.withColumns({c: F.col(c) / total for c in ("sum_w", "sum_wj", "min_w", "max_w")})


def transform(edges: DataFrame, ids: DataFrame, kind: str = "r") -> DataFrame:
    """R rows sum to 1; B all ones; D all sum to 1; V variance-stabilising (rows by the root of their squares, then all sum to n)."""
    kind = kind.upper()
    if kind == "R":
        return row_standardized(edges)
    if kind == "B":
        return edges.select("i", "j", F.lit(1.0).alias("w"))
    if kind == "D":
        return edges.crossJoin(edges.agg(F.sum("w").alias("_t"))).select("i", "j", (F.col("w") / F.col("_t")).alias("w"))
    if kind == "V":
        root = edges.groupBy("i").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_q"))
        scaled = edges.join(root, "i").select("i", "j", (F.col("w") / F.col("_q")).alias("w"))
        return scaled.crossJoin(scaled.agg(F.sum("w").alias("_t"))).crossJoin(ids.agg(F.count("*").alias("_n"))).select("i", "j", (F.col("w") * F.col("_n") / F.col("_t")).alias("w"))
    raise ValidationError("a transform is one of R, B, D, V")


def knn_weights(points: DataFrame, k: int = 8, kind: str = "r", strategy: str = "auto") -> DataFrame:
    edges = neighbour_pairs(points, k=k, strategy=strategy).select("i", "j", F.lit(1.0).alias("w"))
    return transform(edges, points.select("id"), kind)


def distance_band_weights(points: DataFrame, threshold: float, binary: bool = True, alpha: float = -2.0, kind: str = "r", strategy: str = "auto") -> DataFrame:
    """Points within reach, as ones or d ** alpha; points without neighbours stay in the id table."""
    w = F.lit(1.0) if binary else F.pow("d2", F.lit(alpha / 2))
    return transform(neighbour_pairs(points, threshold=threshold, strategy=strategy).select("i", "j", w.alias("w")), points.select("id"), kind)


def contiguity_weights(polygons: DataFrame, rule: str = "queen", kind: str = "r") -> DataFrame:
    """Polygons (id, vertices array<struct<x, y>>) that share a vertex (queen), or an edge between consecutive vertices (rook)."""
    if rule == "queen":
        parts = polygons.select("id", F.explode("vertices").alias("part")).distinct()
    elif rule == "rook":
        steps = F.zip_with("vertices", F.slice("vertices", F.lit(2), F.size("vertices") - 1), lambda a, b: F.array_sort(F.array(a, b)))
        parts = polygons.select("id", F.explode(F.filter(steps, lambda s: s[1].isNotNull() & (s[0] != s[1]))).alias("part")).distinct()
    else:
        raise ValidationError("rule must be queen or rook")
    a, b = parts.withColumnRenamed("id", "i"), parts.withColumnRenamed("id", "j")
    edges = a.join(b, "part").where("i <> j").select("i", "j").distinct().withColumn("w", F.lit(1.0))
    return transform(edges, polygons.select("id"), kind)


def row_sums(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, row_sum, cardinality) of every id; islands sum to 0."""
    sums = edges.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("row_sum"), F.count_if(F.col("w") != 0).alias("cardinality"))
    return ids.select("id").join(sums, "id", "left").select("id", F.coalesce("row_sum", F.lit(0.0)).alias("row_sum"), F.coalesce("cardinality", F.lit(0).cast("long")).alias("cardinality"))


def _row_statistics() -> list[Column]:
    total = F.col("row_sum")
    return [F.count("*").alias("n"), F.min(total).alias("row_sum_min"), F.max(total).alias("row_sum_max"), F.avg(total).alias("row_sum_mean"), F.count_if(total == 0).alias("islands")]


def weight_diagnostics(edges: DataFrame, ids: DataFrame, itemsize: int = 8) -> DataFrame:
    """One row: n, nnz, density, smallest and largest nonzero weight, row sums, islands, and bytes of dense and CSR forms."""
    rows = row_sums(edges, ids).agg(*_row_statistics())
    cells = edges.where("w <> 0").agg(F.count("*").alias("nnz"), F.min("w").alias("min_nonzero"), F.max("w").alias("max_weight"))
    return _diagnosed(rows.crossJoin(cells), itemsize)


def summary_diagnostics(summaries: DataFrame, itemsize: int = 8) -> DataFrame:
    """``weight_diagnostics`` of the rows that ``row_summaries`` gives; their weights are positive."""
    rows = summaries.withColumn("row_sum", F.col("sum_w"))
    cells = [F.sum("n").alias("nnz"), F.min("min_w").alias("min_nonzero"), F.max("max_w").alias("max_weight")]
    return _diagnosed(rows.agg(*_row_statistics(), *cells), itemsize)


def _diagnosed(both: DataFrame, itemsize: int) -> DataFrame:
    n, nnz = F.col("n"), F.col("nnz")
    return both.select(
        "n", "nnz", (nnz / (n.cast("double") * n)).alias("density"), "min_nonzero", "max_weight", "row_sum_min", "row_sum_max", "row_sum_mean", "islands",
        (n * n * itemsize).alias("dense_bytes"), (nnz * (itemsize + 4) + (n + 1) * 4).alias("csr_bytes"),
    )


def weight_moments(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One row S0, S1, S2 and n: S1 = sum w^2 + sum w_ij w_ji, S2 = sum (row + column)^2."""
    squares = edges.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("w")).alias("_a"))
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    both = edges.join(back, ["i", "j"]).agg(F.coalesce(F.sum(F.col("w") * F.col("v")), F.lit(0.0)).alias("_b"))
    ends = edges.select(F.col("i").alias("id"), "w").union(edges.select("j", "w")).groupBy("id").agg(F.sum("w").alias("t"))
    s2 = ends.agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    return squares.crossJoin(both).crossJoin(s2).crossJoin(ids.agg(F.count("*").alias("n"))).select("n", "s0", (F.col("_a") + F.col("_b")).alias("s1"), "s2")


class MatrixOperator:
    """An edge table behind the same methods as a raster's stencil."""

    def __init__(self, edges: DataFrame, ids: DataFrame):
        validate_edges(edges, ids)
        self.edges, self.ids = edges, ids

    def apply(self, values: DataFrame, value: str = "value") -> DataFrame:
        from spatlas.operators.lag import spatial_lag

        return spatial_lag(self.edges, values, value=value)

    def row_sums(self) -> DataFrame:
        return row_sums(self.edges, self.ids)

    def s0(self) -> DataFrame:
        return self.row_sums().agg(F.sum("row_sum").alias("s0"))

    def islands(self) -> DataFrame:
        return self.row_sums().where("row_sum = 0")
