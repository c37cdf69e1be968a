"""CSV tables, polygons, and files by content hash."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.schema import ValidationError, require_columns

CHUNK = 8 << 20


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, order: tuple[str, list[str]] | None = None) -> DataFrame:
    """A CSV with header and a stated schema. ``order`` (column, values) demands that the rows hold these values, in this order."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, required or [c.split()[0] for c in schema.split(",")], "CSV")
    table = spark.read.option("header", True).schema(schema).csv(path)
    if order is not None:
        column, values = order
        found = [r[0] for r in table.select(column).limit(len(values) + 1).collect()]
        if found != values:
            raise ValidationError(f"{column} must be {values} in this order, not {found}")
    return table


def polygons_from_wkt(rows: DataFrame, wkt: str = "wkt") -> DataFrame:
    """Rows with ``vertices`` array<struct<x, y>> from POLYGON or MULTIPOLYGON texts; rings follow one another."""
    pairs = F.regexp_extract_all(F.col(wkt), F.lit(r"(-?[0-9.eE+-]+ +-?[0-9.eE+-]+)"), F.lit(1))
    point = lambda p: F.struct(F.split(p, " +")[0].cast("double").alias("x"), F.split(p, " +")[1].cast("double").alias("y"))
    return rows.withColumn("vertices", F.transform(pairs, point))


def _hashes(batches):
    for batch in batches:
        out = []
        for path in batch.column("local").to_pylist():
            digest = hashlib.sha256()
            with open(path, "rb") as f:
                while block := f.read(CHUNK):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(out, pa.string())], names=["path", "size", "sha256"])


def hashed_files(spark: SparkSession, folder: str, exclude: list[str] | None = None, large: bool = False) -> DataFrame:
    """(path, size, sha256) of every file below ``folder``, by path. ``large`` reads files over 2 GB in blocks; those must be on a mounted file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    for pattern in exclude or []:
        files = files.where(~F.col("path").rlike(pattern))
    if large:
        local = files.select("path", F.col("length").alias("size"), F.regexp_replace("path", "^file:/*", "/").alias("local"))
        return local.mapInArrow(_hashes, "path string, size long, sha256 string").orderBy("path")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def relative(path, folder: str):
    return F.regexp_replace(path, "^.*?" + re.escape(folder.rstrip("/").removeprefix("file://")) + "/", "")
