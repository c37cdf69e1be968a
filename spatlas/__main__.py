"""python -m spatlas audit GRID DAILY OUT | observed GRID DAILY OUT [VALUE] | permute GRID DAILY OUT [R] | interpret CSV LOCAL OUT | manifest FOLDER OUT | diagnose |
validate EDGES VALUES OUT [R] | baseline EDGES VALUES OUT | benchmark OUT [N...] | panel OUT; EDGES is a Parquet table (i, j, w), VALUES one (id, value)"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spatlas.operators.stencil import RasterOperator, queen
from spatlas.plans import audit, interpret, reports, runners
from spatlas.sinks import audit_report, write_csv, write_json
from spatlas.sources.files import hashed_files, read_csv
from spatlas.sources.raster import read_raster, transformed

def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 1
    spark, job, rest = SparkSession.builder.appName("spatlas").getOrCreate(), args[0], args[1:]
    if job == "audit":
        grid, daily = spark.read.parquet(rest[0]), spark.read.parquet(rest[1])
        hashes = {f"{name}_sha256": {r.path.rsplit("/", 1)[-1]: r.sha256 for r in hashed_files(spark, path).collect()} for name, path in (("grid", rest[0]), ("daily", rest[1]))}
        found = audit.audit(grid.select([c for c in audit.GRID if c in grid.columns]), daily.select("cell_id"), hashes)
        write_json(found, f"{rest[2]}.json")
        audit_report(found, f"{rest[2]}.md")
        return 0 if found["continuous_national_index"] else 2
    if job in ("observed", "permute"):
        cells = read_raster(spark, rest[0], rest[1], rest[3] if job == "observed" and len(rest) > 3 else "ntl")
        if job == "observed":
            write_json(runners.observed_run(cells, rest[2]), f"{rest[2]}/global.json")
        else:
            operator = RasterOperator(transformed(cells), queen())
            write_json(runners.raster_global_permutations(operator, int(rest[3]) if len(rest) > 3 else 999), f"{rest[2]}/permutations.json")
        return 0
    if job == "interpret":
        table = read_csv(spark, rest[0], interpret.COMPARISON, order=("stencil", interpret.STENCILS))
        counts = interpret.result_counts(spark.read.parquet(rest[1])).withColumn("stencil", F.lit("queen"))
        fixed = interpret.canonical_comparison(table, counts)
        write_csv(fixed, f"{rest[2]}/comparison")
        write_json(interpret.interpretation(fixed), f"{rest[2]}/interpretation.json")
        return 0
    if job == "manifest":
        write_csv(interpret.manifest(spark, rest[0]), rest[1])
        return 0
    if job == "diagnose":
        print(json.dumps(runners.diagnostics(spark) | {"memory": reports.memory_diagnostics(spark)}, indent=2))
        return 0
    if job == "validate":
        found = reports.validation_run(spark.read.parquet(rest[0]), spark.read.parquet(rest[1]), int(rest[3]) if len(rest) > 3 else 999)
        write_json(found, f"{rest[2]}/validation.json")
        return 0 if found["deterministic"] else 1
    if job == "baseline":
        write_json({"results": reports.baseline_run({"edges": spark.read.parquet(rest[0])}, spark.read.parquet(rest[1]))}, f"{rest[2]}/baseline.json")
        return 0
    if job == "benchmark":
        write_json(reports.benchmark_run(spark, tuple(map(int, rest[1:])) or (500, 1793)), f"{rest[0]}/benchmarks.json")
        return 0
    if job == "panel":
        write_json(reports.panel_benchmark(spark), f"{rest[0]}/panel.json")
        return 0
    print(__doc__)
    return 1


def run() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    run()
