"""From raw local results to reportable clusters: counts without NoData and islands, comparison tables, scatter lines, manifest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.schema import ValidationError
from spatlas.sources.files import hashed_files, relative

CLASSES = ["HH", "LH", "LL", "HL"]
STENCILS = ["rook", "queen", "d2_r2"]
#: Artifact types by file suffix, and the comparison's columns by their names in a run's table.
ARTIFACT_TYPES = {".csv": "table/csv", ".json": "metadata/json", ".parquet": "local-results/parquet", ".png": "figure/png", ".zip": "archive/zip", ".ipynb": "notebook/ipynb"}
RENAMED = {"local_FDR_significant": "inferential_significant", "local_FDR_share": "inferential_significant_share"}
COMPARISON = (
    "stencil string, Moran_I double, p_sim double, permutations long, islands long, valid_nonisland long, local_FDR_significant long, local_FDR_share double, raw_significant_nodata long, "
    "raw_significant_islands long, HH_significant long, LH_significant long, LL_significant long, HL_significant long"
)


def result_counts(local: DataFrame) -> DataFrame:
    """One row from a local result (quadrant label, significant): rows, raw significant, NoData, islands and inferential ones."""
    raw = F.coalesce(F.col("significant"), F.lit(False))
    return local.agg(
        F.count("*").alias("rows"), F.count_if(raw).alias("raw_significant_total"), F.lit(0).cast("long").alias("raw_significant_nodata"),
        F.count_if(raw & (F.col("quadrant") == "island")).alias("raw_significant_islands"), F.count_if(raw & F.col("quadrant").isin(*CLASSES)).alias("inferential_significant"),
    )


def canonical_comparison(comparison: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """A run's table by stencil (``COMPARISON``) with unambiguous names, raw_significant_total before the inferential counts, and shares of the
    valid cells with neighbours. ``counts`` (stencil, columns of ``result_counts``) override a stencil's. Raises unless raw minus NoData minus islands
    is the inferential count and the classes sum to it."""
    out = comparison.withColumnsRenamed(RENAMED)
    given = ["raw_significant_nodata", "raw_significant_islands", "inferential_significant"]
    if counts is not None:
        new = counts.select("stencil", *[F.col(c).alias(f"_{c}") for c in given])
        share = F.when(F.col("_inferential_significant").isNotNull(), F.col("_inferential_significant") / F.col("valid_nonisland")).otherwise(F.col("inferential_significant_share"))
        out = out.join(new, "stencil", "left").withColumn("inferential_significant_share", share).withColumns({c: F.coalesce(f"_{c}", c) for c in given}).drop(*[f"_{c}" for c in given])
    total = F.col("inferential_significant") + F.col("raw_significant_nodata") + F.col("raw_significant_islands")
    if counts is not None:
        known = counts.select("stencil", F.col("raw_significant_total").alias("_t"))
        out = out.join(known, "stencil", "left").withColumn("raw_significant_total", F.coalesce("_t", total)).drop("_t")
    else:
        out = out.withColumn("raw_significant_total", total)
    classes = sum((F.col(f"{c}_significant") for c in CLASSES[1:]), F.col(f"{CLASSES[0]}_significant"))
    wrong = out.where((F.col("raw_significant_total") != total) | (classes != F.col("inferential_significant")))
    if bad := [r.stencil for r in wrong.select("stencil").collect()]:  # a row a stencil
        raise ValidationError(f"counts don't agree for {bad}")
    names = [RENAMED.get(c, c) for c in comparison.columns]
    at = names.index("inferential_significant")
    return out.select(*names[:at], "raw_significant_total", *names[at:])


def interpretation(comparison: DataFrame, **described) -> dict:
    """What a canonical comparison says, as one nested dict: ``described`` (data set, transformation, seed, ...), the mask, and by stencil its
    statistic and counts."""
    operators = {}
    for r in comparison.collect():
        operators[r["stencil"]] = {
            "moran_i": r["Moran_I"], "p_sim": r["p_sim"], "permutations": r["permutations"], "islands": r["islands"], "valid_nonisland": r["valid_nonisland"],
            "raw_local_significant": r["raw_significant_total"], "significant_on_nodata": r["raw_significant_nodata"], "significant_on_islands": r["raw_significant_islands"],
            "inferential_local_fdr_significant": r["inferential_significant"], "inferential_local_fdr_share": r["inferential_significant_share"],
        }
    mask = "valid cells with neighbours, significant and in a quadrant; islands and NoData are no clusters"
    return {**described, "inferential_mask": mask, "operators": operators}


def moran_scatter_line(spark: SparkSession, moran_i: float, x_min: float, x_max: float, points: int = 200) -> DataFrame:
    """(x, y = I x) from x_min to x_max; 0 is among the points if the interval straddles it."""
    if points < 2:
        raise ValidationError("a line needs two points")
    if not all(map(math.isfinite, (moran_i, x_min, x_max))):
        raise ValidationError("I and both ends must be finite")
    if x_min > x_max:
        raise ValidationError("x_min must not be above x_max")
    x = spark.range(points).select((F.lit(float(x_min)) + F.col("id") * ((float(x_max) - float(x_min)) / (points - 1))).alias("x"))
    if x_min < 0 < x_max:
        x = x.union(spark.range(1).select(F.lit(0.0).alias("x"))).distinct()
    return x.select("x", (F.col("x") * F.lit(float(moran_i)) + F.lit(0.0)).alias("y")).orderBy("x")


def artifact_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    out = F.lit("other")
    for s, kind in ARTIFACT_TYPES.items():
        out = F.when(suffix == s, kind).otherwise(out)
    return out


def artifact_condition(path: Column, canonical: list[str], duplicates: dict[str, str] | None = None) -> Column:
    """A struct (condition, canonical_reference): paths that ``duplicates`` maps to another are duplicates of it, zip files archived, those that match a
    regular expression of ``canonical`` canonical, others local-only."""
    kind = lambda c, r: F.struct(F.lit(c).alias("condition"), F.lit(r).alias("canonical_reference"))
    out = F.when(F.lit(False), kind("", ""))
    for copy, original in (duplicates or {}).items():
        out = out.when(path == copy, kind("duplicate", original))
    out = out.when(path.endswith(".zip"), kind("archived", ""))
    for pattern in canonical:
        out = out.when(path.rlike(f"^(?:{pattern})$"), kind("canonical", ""))
    return out.otherwise(kind("local-only", ""))


def manifest(spark: SparkSession, folder: str, own_name: str = "manifest", canonical: list[str] | None = None, duplicates: dict[str, str] | None = None, also: list[str] | None = None) -> DataFrame:
    """(relative_path, size_bytes, sha256, artifact_type, condition, canonical_reference) of the files below ``folder`` by path, but for the manifest
    itself; ``also`` names more folders whose files are listed by their paths."""
    named = hashed_files(spark, folder, exclude=[f"{own_name}[^/]*$"]).withColumn("relative_path", relative(F.col("path"), folder))
    for other in also or []:
        named = named.union(hashed_files(spark, other).withColumn("relative_path", F.concat(F.lit(other.rstrip("/").rsplit("/", 1)[-1] + "/"), relative(F.col("path"), other))))
    kind = artifact_condition(F.col("relative_path"), canonical or ["(.*/)?canonical/.*"], duplicates)
    return named.select("relative_path", F.col("size").alias("size_bytes"), "sha256", artifact_type(F.col("relative_path")).alias("artifact_type"), kind.alias("_k")).select("relative_path", "size_bytes", "sha256", "artifact_type", "_k.*").orderBy("relative_path")
