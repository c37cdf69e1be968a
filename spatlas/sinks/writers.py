from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = ["cell_id", "local_i", "spatial_lag", "quadrant", "p_sim", "p_fdr", "significant"]


def write_local_parquet(local: DataFrame, path: str, order: str = "cell_id") -> None:
    """One row a source cell, by ``order``; single-precision statistics; typed nulls where no inference ran; zstd."""
    types = {"local_i": "float", "spatial_lag": "float", "quadrant": "string", "p_sim": "float", "p_fdr": "float", "significant": "boolean"}
    columns = [F.col(c).cast(types[c]) if c in types and c in local.columns else F.lit(None).cast(types[c]).alias(c) if c in types else F.col(c) for c in LOCAL]
    ranged = local.repartitionByRange(order).sortWithinPartitions(order)
    ranged.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_local(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(payload, path: str) -> None:
    """A dict, a Row, or a DataFrame of few rows, as indented UTF-8 on the driver."""
    if isinstance(payload, DataFrame):
        payload = [r.asDict(True) for r in payload.collect()]
    elif hasattr(payload, "asDict"):
        payload = payload.asDict(True)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(payload, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def write_csv(metrics: DataFrame, path: str) -> None:
    """One CSV with a header of the sorted column names, for tables of metrics."""
    metrics.select(*sorted(metrics.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def audit_report(audit: dict, path: str | None = None) -> str:
    """An audit as Markdown: the verdict first, then size, topology and memory."""
    ways, mib = audit.get("orientation", {}), lambda n: f"{n / 2**20:.1f} MiB"
    sections = {
        "Verdict": {"Continuous integer index": audit["continuous_national_index"], "Reconstructable without a spatial join": audit["reconstruct_without_spatial_join"], "Grid and daily table one to one": audit["grid_daily_one_to_one"]},
        "Size and coverage": {"Grid rows": f"{audit['grid_rows']:,}", "Daily rows": f"{audit['daily_rows']:,}", "Shape": " x ".join(f"{n:,}" for n in audit["shape"]), "Valid positions": f"{audit['valid_positions']:,}", "Holes": f"{audit['holes']:,}", "Coverage": f"{audit['coverage_fraction']:.4%}", "Rows run": ways.get("rows", "unknown"), "Columns run": ways.get("columns", "unknown")},
        "Topology": {"Unique cell_id (grid, daily)": f"{audit['grid_cell_id_unique']}, {audit['daily_cell_id_unique']}", "Unique positions": audit["grid_position_unique"], "Constant tile offsets (rows, columns)": f"{audit['tile_row_offset_constant']}, {audit['tile_col_offset_constant']}", "Edges across tiles (horizontal, vertical)": f"{audit['cross_tile_rook_edges_horizontal']:,}, {audit['cross_tile_rook_edges_vertical']:,}"},
        "Memory of dense arrays": {name: mib(size["one_array_bytes"]) for name, size in audit["memory_estimates"].items() if isinstance(size, dict)},
    }
    text = "# Grid audit\n" + "".join(f"\n## {title}\n\n" + "".join(f"- {k}: **{v}**\n" for k, v in rows.items()) for title, rows in sections.items())
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text
