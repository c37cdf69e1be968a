"""Implicit raster weights: a stencil of offsets over sparse cells.

A raster is rows (row, col, value, valid) and optional group keys; a hole is an absent row, NoData is valid = false. Neighbours are
found without a join: cells are dealt by square tiles, with those along a border to the tile across it too; within a tile each valid cell
sends its value to the cells it is a neighbour of, and one aggregation by place sums what arrives. Both ends must be valid."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import product
from math import hypot

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatlas.schema import ValidationError, require_columns

#: Rows and columns of a tile, at least. Tasks are as many as ``spark.sql.shuffle.partitions``, however small the cells are as bytes.
TILE = 64


class Stencil:
    """A name and the neighbours of a cell: (rows down, columns right, weight), in row-major order."""

    def __init__(self, name: str, hops: Iterable[tuple[int, int, float]]):
        self.name, self.hops = name, tuple(hops)
        places = {hop[:2] for hop in self.hops}
        if not places or len(places) < len(self.hops) or (0, 0) in places:
            raise ValidationError("a stencil is a set of cells around its centre, and not empty")

    @property
    def offsets(self) -> tuple[tuple[int, int], ...]:
        return tuple(hop[:2] for hop in self.hops)

    @property
    def weights(self) -> tuple[float, ...]:
        return tuple(hop[2] for hop in self.hops)

    @property
    def radius(self) -> int:
        return max(max(map(abs, place)) for place in self.offsets)


def ball(name: str, radius: int, size: Callable[[int, int], float], weight: Callable[[int, int], float] = lambda dr, dc: 1.0) -> Stencil:
    """The cells whose offset has a ``size`` (a norm) of at most ``radius``."""
    if radius < 1:
        raise ValidationError("radius must be at least 1")
    square = product(range(-radius, radius + 1), repeat=2)
    return Stencil(name, ((*place, weight(*place)) for place in square if 0 < size(*place) <= radius))


def rook() -> Stencil:
    return ball("rook", 1, lambda dr, dc: abs(dr) + abs(dc))


def queen() -> Stencil:
    return ball("queen", 1, lambda dr, dc: max(abs(dr), abs(dc)))


def inverse_distance(radius: int = 2) -> Stencil:
    """Weights are one over the squared distance."""
    return ball(f"d2_r{radius}", radius, hypot, lambda dr, dc: 1.0 / (dr * dr + dc * dc))


class RasterOperator:
    """Weights of a stencil over the cells of a raster. ``keys`` are batch axes: each of their groups is a raster of its own."""

    def __init__(self, cells: DataFrame, stencil: Stencil, normalization: str = "row", keys: tuple[str, ...] = ()):
        if normalization not in ("row", "none"):
            raise ValidationError("normalization must be 'row' or 'none'")
        require_columns(cells, ["row", "col", *keys], "raster")
        self.stencil, self.normalization, self.keys = stencil, normalization, list(keys)
        self.cells = cells if "valid" in cells.columns else cells.withColumn("valid", F.lit(True))

    def _received(self, aggregates: list[Column], value: str | None) -> DataFrame:
        """One row a cell: its own columns and aggregates over what it receives (slot, w, x)."""
        hop = lambda slot, dr, dc, w: F.struct(F.lit(slot).alias("slot"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(w)).alias("w"))
        own = hop(-1, 0, 0, 0.0)
        hops = F.array(own, *[hop(k, dr, dc, w) for k, ((dr, dc), w) in enumerate(zip(self.stencil.offsets, self.stencil.weights, strict=True))])
        carried = [c for c in self.cells.columns if c not in ("row", "col", *self.keys)]
        x = F.col(value).cast("double") if value else F.lit(0.0)
        reach = self.stencil.radius
        tile = lambda dr, dc: F.struct(*[F.floor((F.col(c) + d) / max(TILE, 2 * reach)).alias(f"_{c}") for c, d in (("row", dr), ("col", dc))])
        met = F.when(F.col("valid"), F.array_distinct(F.array(*[tile(a, b) for a in (-reach, reach) for b in (-reach, reach)]))).otherwise(F.array(tile(0, 0)))
        held = self.cells.select(*self.keys, "row", "col", F.struct(*carried).alias("own"), x.alias("x"), F.explode(met).alias("tile"))
        held = held.select("*", F.col("tile._row").alias("_tr"), F.col("tile._col").alias("_tc")).drop("tile")
        dealt = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), *self.keys, "_tr", "_tc")
        sent = dealt.select("*", F.explode(F.when(F.col("own.valid"), hops).otherwise(F.array(own))).alias("h"))
        placed = sent.select(
            *self.keys, "_tr", "_tc", (F.col("row") - F.col("h.dr")).alias("row"), (F.col("col") - F.col("h.dc")).alias("col"),
            F.when(F.col("h.slot") < 0, F.col("own")).alias("own"), F.col("h.slot").alias("slot"), F.col("h.w").alias("w"), F.when(F.col("h.slot") >= 0, F.col("x")).otherwise(0.0).alias("x"),
        )
        here = tile(0, 0)
        within = placed.where((F.col("_tr") == here["_row"]) & (F.col("_tc") == here["_col"]))
        received = within.groupBy(*self.keys, "_tr", "_tc", "row", "col").agg(F.max("own").alias("own"), *aggregates).where("own IS NOT NULL")
        return received.select(*self.keys, "row", "col", "own.*", *[c for c in received.columns if c not in (*self.keys, "_tr", "_tc", "row", "col", "own")])

    def apply(self, value: str = "value") -> DataFrame:
        """The cells with ``raw_weight`` (summed weights of valid neighbours), ``island`` and ``lag``; invalid cells and islands lag 0."""
        got = self._received([F.sum("w").alias("raw_weight"), F.sum(F.col("w") * F.col("x")).alias("_wx")], value)
        lag = F.col("_wx") / F.col("raw_weight") if self.normalization == "row" else F.col("_wx")
        used = F.col("valid") & (F.col("raw_weight") > 0)
        out = got.withColumn("lag", F.when(used, lag).otherwise(0.0) + F.lit(0.0)).withColumn("island", F.col("valid") & (F.col("raw_weight") == 0))
        return out.withColumn("raw_weight", F.when(F.col("valid"), F.col("raw_weight")).otherwise(0.0)).drop("_wx")

    def row_sums(self) -> DataFrame:
        got = self.apply_weights()
        total = F.when(F.col("raw_weight") > 0, 1.0).otherwise(0.0) if self.normalization == "row" else F.col("raw_weight")
        return got.withColumn("row_sum", total)

    def apply_weights(self) -> DataFrame:
        """The cells with ``raw_weight`` and ``island``."""
        got = self._received([F.sum("w").alias("raw_weight")], None)
        return got.withColumn("raw_weight", F.when(F.col("valid"), F.col("raw_weight")).otherwise(0.0)).withColumn("island", F.col("valid") & (F.col("raw_weight") == 0))

    def s0(self) -> DataFrame:
        return self.row_sums().groupBy(*self.keys).agg(F.sum("row_sum").alias("s0"))

    def islands(self) -> DataFrame:
        return self.apply_weights().where("island")

    def neighbor_weights(self) -> DataFrame:
        """The cells with ``weights``: one for each slot of the stencil, 0 where no valid neighbour is."""
        slots = F.array(*[F.coalesce(F.max(F.when(F.col("slot") == k, F.col("w"))), F.lit(0.0)) for k in range(len(self.stencil.offsets))])
        got = self._received([slots.alias("weights"), F.sum("w").alias("raw_weight")], None)
        used = F.col("valid") & (F.col("raw_weight") > 0)
        scaled = F.transform("weights", lambda w: w / F.col("raw_weight")) if self.normalization == "row" else F.col("weights")
        none = F.transform("weights", lambda w: F.lit(0.0))
        return got.withColumn("weights", F.when(used, scaled).otherwise(none)).drop("raw_weight")

    def edges(self, name: str = "id") -> DataFrame:
        """The same weights as rows (i, j, w) of the cells' ``name``, for what needs pairs. A join by place; J2 (b)."""
        focal = self.cells.where("valid").select(*self.keys, F.col("row"), F.col("col"), F.col(name).alias("i"))
        offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(w)).alias("w")) for (dr, dc), w in zip(self.stencil.offsets, self.stencil.weights, strict=True)])
        wanted = focal.select(*self.keys, "i", "row", "col", F.explode(offsets).alias("h")).select(*self.keys, "i", (F.col("row") + F.col("h.dr")).alias("row"), (F.col("col") + F.col("h.dc")).alias("col"), F.col("h.w").alias("w"))
        pairs = wanted.join(focal.withColumnRenamed("i", "j"), [*self.keys, "row", "col"]).select(*self.keys, "i", "j", "w")
        if self.normalization == "none":
            return pairs
        total = pairs.groupBy(*self.keys, "i").agg(F.sum(F.col("w").cast("decimal(28,18)")).cast("double").alias("_t"))  # the same in any order
        return pairs.join(total, [*self.keys, "i"]).withColumn("w", F.col("w") / F.col("_t")).drop("_t")


def raster_weights(cells: DataFrame, kind: str, radius: int = 2, normalization: str = "row") -> RasterOperator:
    kinds = {"rook": rook, "queen": queen, "inverse_distance": lambda: inverse_distance(radius)}
    if kind not in kinds:
        raise ValidationError(f"kind must be one of {sorted(kinds)}")
    return RasterOperator(cells, kinds[kind](), normalization)
