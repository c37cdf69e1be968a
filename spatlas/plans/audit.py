"""Audit of a tiled grid: is the global index one to one, continuous across tiles and aligned with coordinates?

Tables (grid): cell_id, tile_id, row, col, grid_row, grid_col, and lon, lat for the orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatlas.sources.raster import one_to_one

GRID = ["cell_id", "tile_id", "tile_h", "tile_v", "row", "col", "grid_row", "grid_col", "lon", "lat"]


def tile_summary(grid: DataFrame) -> DataFrame:
    """By tile: cells, bounds within the tile and in the grid, how many offsets are between both, and how many tile_h and tile_v (where the grid has them)."""
    bounds = [f(c).alias(f"{n}_{c}") for c in ("row", "col", "grid_row", "grid_col") for f, n in ((F.min, "min"), (F.max, "max"))]
    offsets = [F.count_distinct(F.col(f"grid_{c}") - F.col(c)).alias(f"{c}_offsets") for c in ("row", "col")]
    names = [F.count_distinct(c).alias(c) for c in ("tile_h", "tile_v") if c in grid.columns]
    return grid.groupBy("tile_id").agg(*names, F.count("*").alias("cells"), F.count_distinct("cell_id").alias("unique_cells"), *bounds, *offsets)


def tile_codes(grid: DataFrame) -> DataFrame:
    """(tile_id, tile_code): 0-based ranks of the sorted tile names, over a row for each tile."""
    return grid.select("tile_id").distinct().withColumn("tile_code", F.dense_rank().over(Window.orderBy("tile_id")) - 1)


def grid_bounds(grid: DataFrame) -> DataFrame:
    """One row: cells, distinct ids and positions, bounds, shape, holes and coverage of the bounding rectangle."""
    found = grid.agg(F.count("*").alias("cells"), F.count_distinct("cell_id").alias("unique_cells"), F.count_distinct("grid_row", "grid_col").alias("unique_positions"), *[f(c).alias(f"{n}_{c}") for c in ("grid_row", "grid_col") for f, n in ((F.min, "min"), (F.max, "max"))])
    height, width = F.col("max_grid_row") - F.col("min_grid_row") + 1, F.col("max_grid_col") - F.col("min_grid_col") + 1
    area = height.cast("long") * width
    return found.withColumn("height", height).withColumn("width", width).withColumn("holes", area - F.col("cells")).withColumn("coverage", F.col("cells") / area)


def cross_tile_edges(grid: DataFrame) -> DataFrame:
    """One row: neighbours to the right and below, and how many are in another tile. Each cell sends itself to both sides; no self join."""
    here = F.array(F.struct(F.lit("h").alias("way"), F.lit(0).alias("d")), F.struct(F.lit("h").alias("way"), F.lit(1).alias("d")), F.struct(F.lit("v").alias("way"), F.lit(0).alias("d")), F.struct(F.lit("v").alias("way"), F.lit(1).alias("d")))
    sent = grid.select("grid_row", "grid_col", "tile_id", F.explode(here).alias("s"))
    row = F.col("grid_row") + F.when(F.col("s.way") == "v", F.col("s.d")).otherwise(0)
    col = F.col("grid_col") + F.when(F.col("s.way") == "h", F.col("s.d")).otherwise(0)
    met = sent.groupBy(F.col("s.way").alias("way"), row.alias("r"), col.alias("c")).agg(F.max(F.when(F.col("s.d") == 0, F.col("tile_id"))).alias("a"), F.max(F.when(F.col("s.d") == 1, F.col("tile_id"))).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    names = (("h", "horizontal"), ("v", "vertical"))
    return met.agg(*[F.count_if(both & (F.col("way") == w)).alias(f"{n}_edges") for w, n in names], *[F.count_if(both & (F.col("way") == w) & (F.col("a") != F.col("b"))).alias(f"cross_tile_{n}") for w, n in names])


def systematic_sample(grid: DataFrame, order: str, limit: int = 200_000) -> DataFrame:
    """Every max(1, n // limit)-th row by ``order``."""
    from spatlas.storage import with_positions

    step = max(1, grid.count() // limit)
    return with_positions(grid, [order], "_pos").where(F.col("_pos") % step == 0).drop("_pos")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation with average ranks of ties. Ranks come from counts of distinct values, not from a sort of all rows."""
    ranked = rows.select(x, y)
    for c in (x, y):
        counts = ranked.groupBy(c).agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.orderBy(c)) - F.col("_n")
        ranked = ranked.join(counts.select(c, (before + (F.col("_n") + 1) / 2).alias(f"_rank_{c}")), c)
    return ranked.agg(F.corr(f"_rank_{x}", f"_rank_{y}").alias("spearman"), F.count("*").alias("n"))


def orientation(grid: DataFrame) -> DataFrame:
    """One row: which way rows and columns run, from the rank correlations with latitude and longitude over a systematic sample."""
    sample = systematic_sample(grid, "cell_id")
    lat, lon = (spearman(sample, a, b).select(F.col("spearman").alias(f"{a}_{b}_spearman")) for a, b in (("grid_row", "lat"), ("grid_col", "lon")))
    rows = F.when(F.col("grid_row_lat_spearman") < 0, "north_to_south").otherwise("south_to_north")
    columns = F.when(F.col("grid_col_lon_spearman") > 0, "west_to_east").otherwise("east_to_west")
    return lat.crossJoin(lon).select(rows.alias("rows"), columns.alias("columns"), "grid_row_lat_spearman", "grid_col_lon_spearman")


def memory_estimates(positions: int) -> dict:
    """Bytes of arrays over the bounding rectangle, which no plan here makes."""
    sizes = {name: {"one_array_bytes": positions * width, "values_lag_local_i_bytes": 3 * positions * width} for name, width in (("float32", 4), ("float64", 8))}
    return sizes | {"boolean_mask_bytes": positions, "cell_id_int64_bytes": 8 * positions}


def audit(grid: DataFrame, daily: DataFrame, hashes: dict[str, str] | None = None) -> dict:
    """All checks as one dict; ``continuous_national_index`` says that the global index can replace a spatial join. ``hashes`` of the files are carried."""
    found, edges, ids = (f.first().asDict() for f in (grid_bounds(grid), cross_tile_edges(grid), one_to_one(grid, daily)))
    tiles = [r.asDict() for r in tile_summary(grid).orderBy("tile_id").collect()]  # a row a tile
    constant = lambda *names: all(t[n] == 1 for t in tiles for n in names if n in t)
    continuous = not any(ids.values()) and found["cells"] == found["unique_positions"] == found["unique_cells"]
    area = found["height"] * found["width"]
    out = {
        **(hashes or {}), "grid_rows": found["cells"], "daily_rows": daily.count(), "grid_cell_id_unique": ids["grid_repeats"] == 0, "daily_cell_id_unique": ids["daily_repeats"] == 0,
        "grid_position_unique": found["cells"] == found["unique_positions"], "grid_daily_one_to_one": not any(ids.values()),
        "bounds": {k.replace("min_", "").replace("max_", "") + ("_min" if k.startswith("min") else "_max"): found[k] for k in ("min_grid_row", "max_grid_row", "min_grid_col", "max_grid_col")},
        "shape": [found["height"], found["width"]], "rectangular_positions": area, "valid_positions": found["unique_positions"], "holes": area - found["unique_positions"], "coverage_fraction": found["unique_positions"] / area,
        "tiles": len(tiles), "tile_row_offset_constant": constant("row_offsets"), "tile_col_offset_constant": constant("col_offsets"), "tile_h_v_constant_within_tile": constant("tile_h", "tile_v"),
        "cross_tile_rook_edges_horizontal": edges["cross_tile_horizontal"], "cross_tile_rook_edges_vertical": edges["cross_tile_vertical"],
        "continuous_national_index": continuous, "reconstruct_without_spatial_join": continuous, "memory_estimates": memory_estimates(area), "tile_summary": tiles,
    }
    if {"lon", "lat"} <= set(grid.columns):
        out["orientation"] = orientation(grid).first().asDict()
    return out
