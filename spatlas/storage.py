"""Tables written on the way: they cut lineage and survive lost executors.

All tables of a session are in one folder of ``spark.checkpoint.dir``. Those that a loop outgrows are discarded at once; those that
results still read go with ``clear``, once the results are written."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's folder in ``spark.checkpoint.dir``; without that setting, a local session gets a temporary one and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spatlas-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/spatlas-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` gave; nothing may read it afterwards."""
    _delete(df.sparkSession, df._stored_at)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of the session, once no result reads them any more."""
    _delete(spark, shared_dir(spark))


#: Names of the files that were handed out, by application; their folder goes with the process.
_HANDED: dict[str, tuple[str, set[str]]] = {}


def handed_out(spark: SparkSession, chunks: Iterable[bytes]) -> str:
    """The name under which every task can open (``SparkFiles.get``) a file of these bytes. Each executor fetches it once from the driver, which
    holds a chunk at a time; equal files are handed out once."""
    context = spark.sparkContext
    if context.applicationId not in _HANDED:
        folder = tempfile.mkdtemp(prefix="spatlas-files-")
        atexit.register(shutil.rmtree, folder, True)
        _HANDED[context.applicationId] = folder, set()
    folder, names = _HANDED[context.applicationId]
    path, digest = f"{folder}/{uuid.uuid4().hex}", hashlib.sha256()
    with open(path, "wb") as file:
        for chunk in chunks:
            digest.update(chunk)
            file.write(chunk)
    name = f"{digest.hexdigest()[:32]}.bin"
    if name in names:
        os.remove(path)
    else:
        os.rename(path, f"{folder}/{name}")
        context.addFile(f"{folder}/{name}")
        names.add(name)
    return name


def with_positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with dense positions from 0 in ``order``, without gathering the rows: sorted ranges, numbered within, then shifted by
    the sizes of the ranges before."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "positions")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (number + F.col("_before")).cast("long")).drop("_part", "_before")
