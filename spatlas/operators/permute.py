"""Permutation inference with randomness that doesn't depend on the cluster: every draw is a keyed bijection of seed, series, replicate
and place (``functions.bijection``), so nothing is sorted and a rerun on any layout gives the same replicates.

Values carry dense positions ``pos`` from 0 (``storage.with_positions``) within their ``series``, edges join positions. A series shuffles under
seed + series. Tasks simulate with NumPy over Arrow batches while the values fit a broadcast of known size, or a mapped file; larger
tables meet their draws by joins, with equal results."""

from __future__ import annotations

import math
import os
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatlas.functions import cluster_label, significant
from spatlas.functions.bijection import bijection, inverse, key
from spatlas.operators.fdr import adjust_pvalues
from spatlas.schema import ValidationError, require_permutations
from spatlas.storage import handed_out, stored, with_positions

#: Bytes of values or draws up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: How many times as large the values of global statistics may be, which tasks map from a file; values of one row of that file.
MAPPED, PLACES = 64, 1 << 18
#: Edges that a task gathers before it simulates, and elements of one NumPy step.
EDGES, ELEMENTS = 1 << 18, 1 << 18
#: Simulated local statistics within this of the observed one tie with it, whatever the order of their sums.
TIE = 5e-11
#: Terms of a global statistic are integers of this many bits, so that their sums are the same in any order.
TERM_BITS = 40


def directed_p(at_least: Column, permutations: int) -> Column:
    """One-sided in the direction of the observed value: (min(g, R - g) + 1) / (R + 1), at most about a half."""
    return (F.least(at_least, F.lit(permutations) - at_least) + 1) / F.lit(float(permutations + 1))


def _z_sim(observed: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (observed - mean) / std).otherwise(float("nan"))


# ---------------------------------------------------------------- values
def _sizes(values: DataFrame) -> dict[int, int]:
    """Values by series: a row for each variable and period."""
    return {r.series: r.n for r in values.groupBy("series").agg(F.count("*").alias("n")).collect()}


def _dense(values: DataFrame, sizes: dict[int, int], column: str) -> dict[int, np.ndarray]:
    """The values of each series by position; the caller has checked their size."""
    table = values.select("series", "pos", F.col(column).cast("double").alias("x")).toArrow()
    series, pos, x = (table.column(c).to_numpy() for c in ("series", "pos", "x"))
    out = {s: np.zeros(n) for s, n in sizes.items()}
    for s in out:
        out[s][pos[series == s]] = x[series == s]
    return out


def _blocks_of(values: DataFrame, column: str, places: int) -> DataFrame:
    """(series, block, rows): the doubles of up to ``places`` consecutive positions as bytes."""

    def pack(key, table):
        first = key[1].as_py() * places
        pos, x = table.column("pos").to_numpy() - first, table.column("x").to_numpy()
        out = np.zeros(int(pos.max()) + 1)
        out[pos] = x
        return pa.table({"series": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "rows": pa.array([out.tobytes()], pa.binary())})

    held = values.select(F.col("series").cast("int").alias("series"), F.col("pos").cast("long").alias("pos"), F.col(column).cast("double").alias("x"))
    return held.withColumn("block", F.expr(f"pos div {places}")).groupBy("series", "block").applyInArrow(pack, "series int, block long, rows binary")


def _mapped(values: DataFrame, sizes: dict[int, int]) -> tuple[str, dict[int, slice], list[tuple[int, float, float]]]:
    """A file that tasks map, with the centred values of each series by position; the places of the series in it; and their largest values and
    sums of squares. The driver holds a few blocks at a time. Sums go by blocks, so they don't depend on partitions."""
    ends = np.cumsum([sizes[s] for s in sorted(sizes)])
    at = {s: slice(int(e) - sizes[s], int(e)) for s, e in zip(sorted(sizes), ends, strict=True)}
    with tempfile.TemporaryFile() as raw:
        raw.truncate(8 * int(ends[-1]))
        for row in _blocks_of(values, "value", PLACES).toLocalIterator():
            os.pwrite(raw.fileno(), row.rows, 8 * (at[row.series].start + row.block * PLACES))

        def blocks(s: int):
            for first in range(at[s].start, at[s].stop, PLACES):
                yield np.frombuffer(os.pread(raw.fileno(), 8 * min(PLACES, at[s].stop - first), 8 * first))

        means = {s: math.fsum(x.sum() for x in blocks(s)) / sizes[s] for s in at}
        known = [(s, max(float(np.abs(x - means[s]).max()) for x in blocks(s)), math.fsum(float(((x - means[s]) ** 2).sum()) for x in blocks(s))) for s in at]
        name = handed_out(values.sparkSession, ((x - means[s]).tobytes() for s in at for x in blocks(s)))
    return name, at, known


# ---------------------------------------------------------------- global
def _power_of_two(bits: int, bound: float) -> float:
    """A factor that takes numbers of up to ``bound`` to integers of at most ``bits`` bits."""
    return 2.0 ** (bits - int(np.ceil(np.log2(bound)))) if bound > 0 else 1.0


def _cross(name: str, at: dict[int, slice], scales: dict[int, float], permutations: int, seed: int):
    def terms(i, j, w):
        """(series, replicate, sum of terms) of some edges; replicate -1 is the observed order."""
        whole = np.memmap(SparkFiles.get(name), np.float64, "r")
        values = {s: whole[where] for s, where in at.items()}
        places, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
        at_i, at_j = ends[: len(i)], ends[len(i) :]
        step = max(1, ELEMENTS // max(len(i), len(places)))
        for s, z in values.items():
            for first in range(-1, permutations, step):
                reps = np.arange(first, min(permutations, first + step))
                source = bijection(places[None, :], key(seed + s, np.maximum(reps, 0))[:, None], len(z))
                source[reps < 0] = places
                moved = np.asarray(z)[source]
                sums = np.rint(w * moved[:, at_i] * moved[:, at_j] * scales[s]).astype(np.int64).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), s, np.int32)), pa.array(reps.astype(np.int32)), pa.array(sums)], names=["series", "rep", "q"])

    def scan(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= EDGES:
                yield from terms(*(np.concatenate([b.column(c).to_numpy() for b in waiting]) for c in "ijw"))
                waiting, n = [], 0
        if n:
            yield from terms(*(np.concatenate([b.column(c).to_numpy() for b in waiting]) for c in "ijw"))

    return scan


def _scattered(sizes: dict[int, int], permutations: int, seed: int):
    def scan(batches):
        for batch in batches:
            series, pos, z = (batch.column(c).to_numpy() for c in ("series", "pos", "z"))
            for s in np.unique(series):
                own = series == s
                for rep in range(permutations):
                    to = inverse(pos[own], key(seed + int(s), rep), sizes[int(s)])
                    yield pa.RecordBatch.from_arrays([pa.array(series[own]), pa.array(np.full(own.sum(), rep, np.int32)), pa.array(to), pa.array(z[own])], names=["series", "rep", "pos", "z"])

    return scan


def permuted(values: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(series, rep, pos, z): the values of each replicate at their new positions. A narrow step."""
    return values.select(F.col("series").cast("int"), "pos", "z").mapInArrow(_scattered(_sizes(values), permutations, seed), "series int, rep int, pos long, z double")


def _joined_terms(edges: DataFrame, z: DataFrame, scales: DataFrame, permutations: int, seed: int) -> DataFrame:
    """As ``_cross``, by joins of edges and permuted values."""
    every = permuted(z, permutations, seed).union(z.select("series", F.lit(-1).alias("rep"), "pos", "z"))
    a, b = (every.select("series", "rep", F.col("pos").alias(c), F.col("z").alias(f"z{c}")) for c in "ij")
    term = F.rint(F.col("w") * F.col("zi") * F.col("zj") * F.col("scale"))
    return edges.join(a, "i").join(b, ["series", "rep", "j"]).join(F.broadcast(scales), "series").select("series", "rep", term.cast("decimal(38,0)").alias("q"))


def _exact_sum(x: Column, factor: Column | float) -> Column:
    """A sum that is the same in any order: of integers, at a power of two that is the same in all rows of a group."""
    return F.sum(F.rint(x * factor).cast("decimal(38,0)")).cast("double") / (F.first(factor) if isinstance(factor, Column) else factor)


def simulate_global(edges: DataFrame, values: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(series, rep, sim): Moran's I of every replicate of ``values`` (series, pos, value); rep -1 is the observed one. Stored.

    Terms are summed as integers of at most 40 bits, relative to the largest possible one, so no sum depends on its order."""
    require_permutations(permutations, seed)
    spark, sizes = values.sparkSession, _sizes(values)
    weight = edges.agg(F.max(F.abs("w"))).first()[0] or 0.0
    fits = sum(sizes.values()) * 8 <= MAPPED * BROADCAST_BYTES
    if fits:
        name, at, known = _mapped(values, sizes)
    else:
        top = values.groupBy("series").agg(F.max(F.abs(F.col("value").cast("double"))).alias("top"), F.count("*").alias("n"))
        factor = F.pow(F.lit(2.0), 52 - F.ceil(F.log2(F.nullif(F.col("top"), F.lit(0.0)))))
        means = values.join(F.broadcast(top), "series").groupBy("series").agg((_exact_sum(F.col("value"), factor) / F.count("*")).alias("mean"))
        z = stored(values.join(F.broadcast(means), "series").select(F.col("series").cast("int"), "pos", (F.col("value").cast("double") - F.col("mean")).alias("z")), "centred")
        tops = {r.series: r.top for r in z.groupBy("series").agg(F.max(F.abs("z")).alias("top")).collect()}
        at = F.element_at(F.create_map(*[F.lit(x) for s, t in tops.items() for x in (s, _power_of_two(TERM_BITS, t * t))]), F.col("series"))
        known = [(r.series, tops[r.series], r.zz) for r in z.groupBy("series").agg(_exact_sum(F.col("z") * F.col("z"), at).alias("zz")).collect()]
    if any(t == 0 for _, t, _ in known):
        raise ValidationError("constant values have no autocorrelation")
    scales = {s: _power_of_two(TERM_BITS, top * top * weight) for s, top, _ in known}
    if fits:
        # ranges of focal places: a task's edges touch few places beside its own
        ranged = edges.select("i", "j", "w").repartitionByRange(2 * spark.sparkContext.defaultParallelism, "i")
        parts = ranged.mapInArrow(_cross(name, at, scales, permutations, seed), "series int, rep int, q long")
    else:
        parts = _joined_terms(edges, z, spark.createDataFrame(list(scales.items()), "series int, scale double"), permutations, seed)
    s0 = edges.agg(_exact_sum(F.col("w"), _power_of_two(TERM_BITS, weight)).alias("s0")).first().s0
    if not s0:
        raise ValidationError("all weights sum to zero")
    constants = spark.createDataFrame([(s, sizes[s] / (s0 * zz * scales[s])) for s, _, zz in known], "series int, c double")
    sums = parts.groupBy("series", "rep").agg(F.sum(F.col("q").cast("decimal(38,0)")).cast("double").alias("q"))
    return stored(sums.join(F.broadcast(constants), "series").select("series", "rep", (F.col("q") * F.col("c")).alias("sim")), "simulations")


def summarize(simulations: DataFrame, permutations: int) -> DataFrame:
    """One row a series: observed, n_at_least, p_sim, EI_sim, seI_sim (population), min_sim, max_sim, z_sim. A series' replicates are
    one array, summed in order."""
    sims = simulations.where("rep >= 0").groupBy("series").agg(F.sort_array(F.collect_list("sim")).alias("sims"))
    both = simulations.where("rep = -1").select("series", F.col("sim").alias("observed")).join(sims, "series")
    mean = F.aggregate("sims", F.lit(0.0), lambda a, x: a + x) / permutations
    std = F.sqrt(F.aggregate("sims", F.lit(0.0), lambda a, x: a + (x - F.col("EI_sim")) * (x - F.col("EI_sim"))) / permutations)
    found = both.withColumn("EI_sim", mean).withColumn("seI_sim", std).withColumn("n_at_least", F.size(F.filter("sims", lambda x: x >= F.col("observed"))).cast("long"))
    found = found.withColumns({"p_sim": directed_p(F.col("n_at_least"), permutations), "min_sim": F.array_min("sims"), "max_sim": F.array_max("sims")})
    return found.withColumn("z_sim", _z_sim(F.col("observed"), F.col("EI_sim"), F.col("seI_sim"))).drop("sims")


def global_permutations(edges: DataFrame, values: DataFrame, permutations: int = 999, seed: int = 12345) -> DataFrame:
    """One row; ``values`` has pos and value."""
    return summarize(simulate_global(edges, values.withColumn("series", F.lit(0)), permutations, seed), permutations).drop("series")


def panel_permutations(edges: DataFrame, values: DataFrame, permutations: int = 999, seed: int = 12345) -> DataFrame:
    """One row a ``series`` of ``values`` (series, pos, value); one plan for all series."""
    return summarize(simulate_global(edges, values, permutations, seed), permutations)


# ---------------------------------------------------------------- local
FOUND = {"n_at_least": "long", "_sum": "double", "_squares": "double", "min_sim": "double", "max_sim": "double"}


def _local_step(simulate, card: int, column_names: list[str]):
    """Adds what ``simulate(series, pos, z, weights, own, first row)`` gives, an array of replicates by row, to the columns found so far."""

    def scan(batches):
        for batch in batches:
            series, pos, z, own, obs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("series", "pos", "z", "own", "obs"))
            weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(len(pos), card)
            found = {c: np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in FOUND}
            for s in np.unique(series):
                rows = np.flatnonzero(series == s)
                for at, lags, scaling in simulate(int(s), pos[rows], weights[rows]):
                    r = rows[at]
                    sims = scaling * z[r, None] * (lags + own[r, None] * z[r, None])
                    found["n_at_least"][r] += (sims >= obs[r, None] - TIE).sum(1)
                    found["_sum"][r] += sims.sum(1)
                    found["_squares"][r] += (sims * sims).sum(1)
                    found["min_sim"][r] = np.minimum(found["min_sim"][r], sims.min(1))
                    found["max_sim"][r] = np.maximum(found["max_sim"][r], sims.max(1))
            yield pa.RecordBatch.from_arrays([pa.array(found[c]) if c in found else batch.column(c) for c in column_names], names=column_names)

    return scan


def _blank(cells: DataFrame) -> DataFrame:
    start = {"n_at_least": 0, "_sum": 0.0, "_squares": 0.0, "min_sim": float("inf"), "max_sim": float("-inf")}
    return cells.withColumns({c: F.lit(v).cast(FOUND[c]) for c, v in start.items()})


def _finished(cells: DataFrame, permutations: int) -> DataFrame:
    out = cells.withColumn("p_sim", directed_p(F.col("n_at_least"), permutations)).withColumn("permutation_mean", F.col("_sum") / permutations)
    variance = F.greatest(F.lit(0.0), F.col("_squares") / permutations - F.col("permutation_mean") * F.col("permutation_mean"))
    return out.withColumn("permutation_std", F.sqrt(variance)).withColumn("z_sim", _z_sim(F.col("obs"), F.col("permutation_mean"), F.col("permutation_std"))).drop("_sum", "_squares")


def _checked_sizes(values: DataFrame, card: int) -> dict[int, int]:
    sizes = _sizes(values)
    if card > min(sizes.values()) - 1:
        raise ValidationError(f"a cell has {card} neighbours, but only {min(sizes.values()) - 1} other values can be drawn")
    return sizes


def shared_draws(values: DataFrame, card: int, reps: range, seed: int, sizes: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By series: ``h`` (a row a replicate: card distinct positions among n - 1), and the values at h and at h + 1.

    A focal position i reads the value at h + 1 where h >= i and at h otherwise, which is a draw from all positions but its own."""
    h = {s: bijection(np.arange(card)[None, :], key(seed + s, np.arange(reps.start, reps.stop))[:, None], n - 1) for s, n in sizes.items()}
    places = {s: np.unique(np.concatenate([x, x + 1])) for s, x in h.items()}
    wanted = pa.table({"series": np.concatenate([np.full(len(p), s, np.int32) for s, p in places.items()]), "pos": np.concatenate(list(places.values()))})
    found = values.select(F.col("series").cast("int"), "pos", "z").join(F.broadcast(values.sparkSession.createDataFrame(wanted)), ["series", "pos"]).toArrow().sort_by([("series", "ascending"), ("pos", "ascending")])
    series, z = found.column("series").to_numpy(), found.column("z").to_numpy()
    at = {s: (z[series == s], places[s]) for s in places}
    return {s: (x, *(v[np.searchsorted(p, x + k)] for k in (0, 1))) for s, x in h.items() for v, p in [at[s]]}


def _conditional(shared, sizes: dict[int, int]):
    def simulate(s, pos, weights):
        h, low, high = shared.value[s]
        step = max(1, ELEMENTS // len(h))
        for first in range(0, len(pos), step):
            at = slice(first, first + step)
            lags = np.zeros((len(pos[at]), len(h)))
            for k in range(h.shape[1]):
                lags += weights[at, k, None] * np.where(h[None, :, k] >= pos[at, None], high[None, :, k], low[None, :, k])
            yield np.arange(len(pos))[at], lags, (sizes[s] - 1) / sizes[s]

    return simulate


def local_conditional(cells: DataFrame, values: DataFrame, card: int, permutations: int = 999, seed: int = 12345) -> DataFrame:
    """``cells`` (series, pos, z, weights by slot padded to ``card``, own: the diagonal weight, obs) with n_at_least, p_sim, permutation_mean,
    permutation_std, min_sim, max_sim, z_sim. ``values`` (series, pos, z) are what is drawn from; z is standardized, so obs = (n - 1) / n * z * lag.

    All focal cells of a replicate share its draw. Simulating is a narrow step over the cells, for as many replicates at once as
    their draws fit a broadcast."""
    require_permutations(permutations, seed)
    sizes = _checked_sizes(values, card)
    spark, out = values.sparkSession, _blank(cells)
    step = max(1, BROADCAST_BYTES // (24 * max(card, 1) * len(sizes)))
    for first in range(0, permutations, step):
        shared = spark.sparkContext.broadcast(shared_draws(values, card, range(first, min(permutations, first + step)), seed, sizes))
        out = out.mapInArrow(_local_step(_conditional(shared, sizes), card, out.columns), out.schema)
    return _finished(out, permutations)


def _own_draws(s: int, pos, card: int, reps, seed: int, n: int) -> np.ndarray:
    """(cell, replicate, slot): distinct positions other than the cell's own."""
    keys = key(seed + s, reps[None, :], pos[:, None])
    h = bijection(np.arange(card)[None, None, :], keys[:, :, None], n - 1)
    return h + (h >= pos[:, None, None])


def _independent(shared, sizes: dict[int, int], permutations: int, seed: int):
    def simulate(s, pos, weights):
        z, card = shared.value[s], weights.shape[1]
        step = max(1, ELEMENTS // (permutations * max(card, 1)))
        for first in range(0, len(pos), step):
            at = slice(first, first + step)
            drawn = z[_own_draws(s, pos[at], card, np.arange(permutations), seed, sizes[s])]
            lags = np.zeros(drawn.shape[:2])
            for k in range(card):
                lags += weights[at, k, None] * drawn[:, :, k]
            yield np.arange(len(pos))[at], lags, (sizes[s] - 1) / sizes[s]

    return simulate


def _wanted(sizes: dict[int, int], card: int, permutations: int, seed: int):
    """(series, pos, rep, slot, w, draw) of the slots with a weight."""

    def scan(batches):
        for batch in batches:
            series, pos = (batch.column(c).to_numpy() for c in ("series", "pos"))
            weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(len(pos), card)
            step = max(1, ELEMENTS // max(card, 1))
            for s in np.unique(series):
                rows = np.flatnonzero(series == s)
                for row in rows:  # a cell's draws may be many
                    for first in range(0, permutations, step):
                        reps = np.arange(first, min(permutations, first + step))
                        drawn = _own_draws(int(s), pos[row : row + 1], card, reps, seed, sizes[int(s)])[0]
                        slots = np.flatnonzero(weights[row])
                        n = len(reps) * len(slots)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, s, np.int32)), pa.array(np.full(n, pos[row])), pa.array(np.repeat(reps, len(slots)).astype(np.int32)), pa.array(np.tile(slots, len(reps)).astype(np.int32)), pa.array(np.tile(weights[row, slots], len(reps))), pa.array(drawn[:, slots].ravel())],
                            names=["series", "pos", "rep", "slot", "w", "draw"],
                        )

    return scan


def _independent_joined(cells: DataFrame, values: DataFrame, sizes: dict[int, int], card: int, permutations: int, seed: int) -> DataFrame:
    """As the narrow step, for more values than tasks can hold: drawn positions meet the values in a join. A cell that has no neighbour simulates its own weight alone."""
    drawn = cells.select(F.col("series").cast("int"), "pos", "weights").mapInArrow(_wanted(sizes, card, permutations, seed), "series int, pos long, rep int, slot int, w double, draw long")
    met = drawn.join(values.select(F.col("series").cast("int"), F.col("pos").alias("draw"), F.col("z").alias("x")), ["series", "draw"])
    in_order = F.sort_array(F.collect_list(F.struct("slot", (F.col("w") * F.col("x")).alias("t"))))
    lags = met.groupBy("series", "pos", "rep").agg(F.aggregate(in_order, F.lit(0.0), lambda a, t: a + t["t"]).alias("_lag"))
    scaling = reduce(lambda a, s: a.when(F.col("series") == s, (sizes[s] - 1) / sizes[s]), sizes, F.when(F.lit(False), 0.0))
    plain = [c for c in cells.columns]
    sims = cells.join(lags, ["series", "pos"], "left").withColumn("_s", scaling * F.col("z") * (F.coalesce("_lag", F.lit(0.0)) + F.col("own") * F.col("z")))
    alone = F.when(F.first("_lag").isNull(), permutations).otherwise(1)
    sums = sims.groupBy("series", "pos").agg(
        (F.count_if(F.col("_s") >= F.col("obs") - TIE) * alone).alias("n_at_least"), (F.sum("_s") * alone).alias("_sum"), (F.sum(F.col("_s") * F.col("_s")) * alone).alias("_squares"), F.min("_s").alias("min_sim"), F.max("_s").alias("max_sim")
    )
    return cells.join(sums, ["series", "pos"]).select(*plain, *FOUND)


def local_independent(cells: DataFrame, values: DataFrame, card: int, permutations: int = 999, seed: int = 12345) -> DataFrame:
    """As ``local_conditional``, but each focal cell draws for itself. A narrow step while all values fit a broadcast, a join of draws and
    values beyond; both give equal results."""
    require_permutations(permutations, seed)
    sizes, out = _checked_sizes(values, card), _blank(cells)
    if sum(sizes.values()) * 8 > BROADCAST_BYTES:
        return _finished(_independent_joined(cells, values, sizes, card, permutations, seed), permutations)
    shared = values.sparkSession.sparkContext.broadcast(_dense(values, sizes, "z"))
    return _finished(out.mapInArrow(_local_step(_independent(shared, sizes, permutations, seed), card, out.columns), out.schema), permutations)


LOCAL = {"shared": local_conditional, "independent": local_independent}


def local_permutations(cells: DataFrame, values: DataFrame, card: int, permutations: int = 999, seed: int = 12345, draws: str = "shared") -> DataFrame:
    if draws not in LOCAL:
        raise ValidationError("draws must be 'shared' or 'independent'")
    return LOCAL[draws](cells, values, card, permutations, seed)


def padded_neighbours(edges: DataFrame, card: int) -> DataFrame:
    """(pos, weights, own): a row's weights by neighbour, packed left and padded with 0 to ``card``; the diagonal apart."""
    off = F.sort_array(F.collect_list(F.when(F.col("i") != F.col("j"), F.struct("j", "w"))))
    packed = edges.groupBy(F.col("i").alias("pos")).agg(off.alias("_n"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), F.col("w"))), F.lit(0.0)).alias("own"))
    return packed.select("pos", F.slice(F.concat(F.col("_n.w"), F.array_repeat(F.lit(0.0), card)), 1, card).alias("weights"), "own")


def with_inference(local: DataFrame, alpha: float = 0.05, fdr: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Local results with p_fdr, significant, significant_fdr, cluster and cluster_fdr. Islands stay in the family; report
    clusters through ``functions.inferential_mask``. Without ``fdr``, p_fdr copies p_sim."""
    if fdr:
        out = adjust_pvalues(local, "fdr_bh", alpha, keys, "p_sim").withColumnRenamed("p_adjusted", "p_fdr").withColumnRenamed("reject", "significant_fdr")
    else:
        out = local.withColumn("p_fdr", F.col("p_sim")).withColumn("significant_fdr", significant(F.col("p_sim"), alpha))
    out = out.withColumn("significant", significant(F.col("p_sim"), alpha))
    if "quadrant" not in out.columns:
        return out
    return out.withColumn("cluster", cluster_label(F.col("quadrant"), F.col("significant"))).withColumn("cluster_fdr", cluster_label(F.col("quadrant"), F.col("significant_fdr")))


def batches(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The groups of ``keys``, a row each, with ``series`` from 0 in their order; without keys, one row."""
    if not keys:
        return cells.sparkSession.range(1).select(F.lit(0).alias("series"))
    found = sorted(cells.select(*keys).distinct().collect(), key=lambda r: tuple((x is not None, x) for x in r))
    kinds = cells.select(*keys).schema.add("series", T.IntegerType())
    return cells.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(found)], kinds)


def local_raster_permutations(operator, components: DataFrame, permutations: int = 999, seed: int = 12345, draws: str = "shared") -> DataFrame:
    """Permutations of a raster's valid cells, batch axes apart. ``components`` are from ``moran.raster_components``; positions go by row, column."""
    from spatlas.operators.stencil import RasterOperator

    keys = operator.keys
    bare = RasterOperator(operator.cells.select(*keys, "row", "col", "valid"), operator.stencil, operator.normalization, tuple(keys))
    slots = bare.neighbor_weights().where("valid").select(*keys, "row", "col", "weights")
    placed = with_positions(components.where("valid"), [*keys, "row", "col"])
    if keys:
        series = batches(components, keys)
        first = placed.groupBy(*keys).agg(F.min("pos").alias("_first"))
        placed = placed.join(F.broadcast(series.join(first, keys)), keys).withColumn("pos", F.col("pos") - F.col("_first")).drop("_first")
    else:
        placed = placed.withColumn("series", F.lit(0))
    obs = (F.col("_n") - 1) * F.col("z") * F.col("lag") / F.col("_n") + F.lit(0.0)
    cells = stored(placed.join(slots, [*keys, "row", "col"]).select(*keys, "row", "col", "series", "pos", "z", "weights", obs.alias("obs"), F.lit(0.0).alias("own")), "focal-cells")
    return local_permutations(cells, cells.select("series", "pos", "z"), len(operator.stencil.offsets), permutations, seed, draws)
