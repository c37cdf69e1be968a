"""Operators against NumPy on small inputs, and the contracts of bad input."""

import json
import math
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatlas import schema
from spatlas.functions import bijection, inferential_mask, two_sided_p
from spatlas.operators import blocks, fdr, lag, moran, permute, weights
from spatlas.operators.stencil import RasterOperator, Stencil, inverse_distance, queen, raster_weights, rook
from spatlas.plans import audit, interpret, queries, reports, runners
from spatlas.schema import ValidationError
from spatlas.sinks import audit_report, read_local, write_csv, write_json, write_local_parquet
from spatlas.sources import files, synthetic
from spatlas.sources.raster import raster, read_raster, summary, transformed
from spatlas.storage import with_positions

COORDS = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)]
VALUES = [1.0, 2.5, 4.0, 7.0, 3.0]


def points(spark, coords=COORDS):
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(coords)], "id long, coords array<double>")


def vector(spark, values=VALUES):
    return spark.createDataFrame(list(enumerate(values)), "id long, value double")


def path_graph(spark, n=5):
    edges = [(i, j, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    return weights.row_standardized(spark.createDataFrame(edges, "i long, j long, w double"))


def dense(edges, n):
    w = np.zeros((n, n))
    for r in edges.collect():
        w[r.i, r.j] = r.w
    return w


def grid(spark, array, valid=None):
    array = np.array(array, float)
    valid = np.isfinite(array) if valid is None else np.array(valid, bool)
    rows = [(r, c, float(array[r, c]), bool(valid[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, value double, valid boolean")


def stencil_matrix(valid, stencil):
    cells = [tuple(map(int, x)) for x in np.argwhere(valid)]
    w = np.zeros((len(cells), len(cells)))
    for i, (r, c) in enumerate(cells):
        for (dr, dc), v in zip(stencil.offsets, stencil.weights, strict=True):
            if (r + dr, c + dc) in cells:
                w[i, cells.index((r + dr, c + dc))] = v
    return cells, w


# ---------------------------------------------------------------- rasters
@pytest.mark.parametrize("size", [3, 5, 10])
@pytest.mark.parametrize("stencil", [rook(), queen(), inverse_distance(2)], ids=lambda s: s.name)
def test_raster_equals_matrix(spark, size, stencil):
    a = np.random.default_rng(size).normal(size=(size, size))
    valid = np.ones_like(a, bool)
    if size > 3:
        valid[size // 2, size // 2] = False
    cells, w = stencil_matrix(valid, stencil)
    w /= w.sum(1, keepdims=True)
    v = np.array([a[c] for c in cells])
    z = (v - v.mean()) / v.std()
    op = RasterOperator(grid(spark, a, valid), stencil)
    whole, local = moran.moran_observed(op)
    row = whole.first()
    assert row.n == len(v) and math.isclose(row.I, len(v) / w.sum() * (z @ w @ z) / (z @ z), abs_tol=1e-10) and row.EI == -1 / (len(v) - 1)
    got = {(r.row, r.col): r for r in local.collect()}
    for c, li, lg in zip(cells, (len(v) - 1) * z * (w @ z) / (z @ z), w @ z, strict=True):
        assert abs(got[c].local_i - li) < 1e-10 and abs(got[c].spatial_lag - lg) < 1e-10
    if size > 3:
        hole = got[(size // 2, size // 2)]
        assert hole.local_i is None and hole.quadrant_code == 0 and hole.quadrant == "not valid"


def test_coast_and_island(spark):
    mask = [[1, 1, 0, 0, 0], [1, 0, 0, 1, 0], [0, 0, 0, 0, 0]]
    a = np.zeros((3, 5))
    a[0, 1], a[1, 0], a[1, 3] = 2, 4, 7
    op = RasterOperator(grid(spark, a, mask), rook())
    got = {(r.row, r.col): r for r in op.apply().collect()}
    assert got[(0, 0)].lag == 3 and got[(1, 3)].island and got[(1, 3)].lag == 0 and op.s0().first().s0 == 3
    assert [(r.row, r.col) for r in op.islands().collect()] == [(1, 3)]
    local = moran.moran_local_raster(op)
    assert {r.quadrant for r in local.where("island").collect()} == {"island"}
    assert moran.quadrant_histogram(local).agg(F.sum("n")).first()[0] == 15


def test_batches_and_unnormalized(spark):
    a = np.arange(18.0).reshape(3, 6)
    both = grid(spark, a).withColumn("b", F.lit(0)).unionByName(grid(spark, a * 2).withColumn("b", F.lit(1)))
    got = {(r.b, r.row, r.col): r.lag for r in RasterOperator(both, queen(), "none", ("b",)).apply().collect()}
    assert got[(0, 0, 0)] == 1 + 6 + 7 and got[(1, 0, 0)] == 28
    w = {(r.row, r.col): list(r.weights) for r in RasterOperator(grid(spark, a), rook()).neighbor_weights().collect()}
    assert w[(0, 0)] == [0, 0, 0.5, 0.5]
    assert raster_weights(grid(spark, a), "inverse_distance").stencil.radius == 2


def test_stencil_contracts(spark):
    assert len(inverse_distance(2).offsets) == 12 and rook().offsets == ((-1, 0), (0, -1), (0, 1), (1, 0))
    for bad in (lambda: Stencil("x", ()), lambda: Stencil("x", [(0, 0, 1.0)]), lambda: Stencil("x", [(0, 1, 1.0), (0, 1, 2.0)]), lambda: inverse_distance(0), lambda: RasterOperator(grid(spark, [[1.0]]), rook(), "max"), lambda: raster_weights(grid(spark, [[1.0]]), "bishop")):
        with pytest.raises(ValidationError):
            bad()
    nan = grid(spark, [[1, 1], [1, np.nan]], [[1, 1], [1, 1]])
    for cells, fault in ((nan, "NaN"), (grid(spark, [[1.0, 1.0]]), "constant"), (grid(spark, [[1.0]]), "two values")):
        for statistic in (moran.moran_global_raster, moran.moran_local_raster):
            with pytest.raises(Exception, match=fault):
                statistic(RasterOperator(cells, rook())).collect()


def test_raster_source(spark, tmp_path):
    g = spark.createDataFrame([(10, 5, 8), (11, 5, 9), (12, 6, 8), (13, 7, 10)], "cell_id long, grid_row int, grid_col int")
    d = spark.createDataFrame([(13, 5.0), (10, 0.0), (12, None), (11, 2.0)], "cell_id long, ntl double")
    g.write.parquet(str(tmp_path / "g"))
    d.write.parquet(str(tmp_path / "d"))
    cells = read_raster(spark, str(tmp_path / "g"), str(tmp_path / "d"))
    got = {r.cell_id: (r.row, r.col, r.value, r.valid) for r in cells.collect()}
    assert got == {10: (0, 0, 0.0, True), 11: (0, 1, 2.0, True), 12: (1, 0, None, False), 13: (2, 2, 5.0, True)}
    assert tuple(summary(cells).first()) == (4, 3, 1, 5, 8, 3, 3)
    assert math.isclose(transformed(cells, "log1p", 1000.0).where("cell_id = 11").first().value, math.log(2001))
    for bad in ((g.union(g.limit(1)), d), (g, d.limit(2)), (g.withColumn("grid_col", F.lit(1)).withColumn("grid_row", F.lit(1)), d)):
        with pytest.raises(ValidationError):
            raster(*bad)
    with pytest.raises(ValidationError):
        transformed(cells.withColumn("value", F.lit(-1.0)))
    with pytest.raises(ValidationError):
        transformed(cells, "sqrt")


# ---------------------------------------------------------------- vectors
def test_weights(spark):
    w = dense(weights.inverse_distance_weights(points(spark), row_standardize=False), 5)
    assert w[0, 1] == 1 and w[0, 3] == 0.5 and w[0, 4] == 0.2 and w.trace() == 0
    for strategy in ("arrow", "catalyst"):
        assert np.allclose(dense(weights.inverse_distance_weights(points(spark), k=2, strategy=strategy), 5).sum(1), 1)
        assert (dense(weights.knn_weights(points(spark), k=2, strategy=strategy), 5) > 0).sum(1).tolist() == [2] * 5
    near = [dense(weights.inverse_distance_weights(points(spark), threshold=1.0, strategy=s), 5) for s in ("bucket", "arrow", "catalyst")]
    assert np.array_equal(near[0], near[1]) and np.array_equal(near[0], near[2]) and near[0][0, 1] > 0
    none = weights.inverse_distance_weights(points(spark), threshold=0.5, binary=True)
    d = weights.weight_diagnostics(none, points(spark)).first()
    assert d.nnz == 0 and d.islands == 5 and d.n == 5
    for bad in (dict(power=0), dict(threshold=0.0), dict(k=5), dict(k=0), dict(strategy="gpu")):
        with pytest.raises(ValidationError):
            weights.inverse_distance_weights(points(spark), **bad)
    for coords in ([(0.0, 0.0), (0.0, 0.0)], [(0.0, math.nan), (1.0, 1.0)], [(1.0,)]):
        with pytest.raises(ValidationError):
            weights.inverse_distance_weights(points(spark, coords))


def test_transforms_and_contiguity(spark):
    raw, ids = weights.inverse_distance_weights(points(spark), row_standardize=False), points(spark)
    w = dense(raw, 5)
    assert np.allclose(dense(weights.transform(raw, ids, "D"), 5), w / w.sum())
    v = w / np.sqrt((w**2).sum(1, keepdims=True))
    assert np.allclose(dense(weights.transform(raw, ids, "V"), 5), v * 5 / v.sum())
    assert set(np.unique(dense(weights.transform(raw, ids, "B"), 5))) == {0, 1}
    with pytest.raises(ValidationError):
        weights.transform(raw, ids, "X")
    squares = [(i, f"POLYGON(({c} {r}, {c + 1} {r}, {c + 1} {r + 1}, {c} {r + 1}, {c} {r}))") for i, (r, c) in enumerate([(0, 0), (0, 1), (1, 1), (5, 5)])]
    polygons = files.polygons_from_wkt(spark.createDataFrame(squares, "id long, wkt string"))
    assert (dense(weights.contiguity_weights(polygons), 4) > 0).sum(1).tolist() == [2, 2, 2, 0]
    assert (dense(weights.contiguity_weights(polygons, "rook"), 4) > 0).sum(1).tolist() == [1, 2, 1, 0]


def oracle(w, y):
    n, z = len(y), y - y.mean()
    s0, s1, s2 = w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(1) + w.sum(0)) ** 2).sum()
    i, ei = n / s0 * (z @ w @ z) / (z @ z), -1 / (n - 1)
    normal = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n - 1) * (n + 1) * s0 * s0) - ei**2
    k = (z**4).mean() / (z**2).mean() ** 2
    random = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - ei**2
    return i, ei, normal, random, (i - ei) / math.sqrt(normal)


def test_moran_and_panel(spark):
    edges, y = path_graph(spark), np.array(VALUES)
    w = dense(edges, 5)
    row = moran.moran(edges, vector(spark)).first()
    want = oracle(w, y)
    assert np.allclose([row.I, row.EI, row.VI_norm, row.VI_rand, row.z_norm], want, atol=1e-10) and math.isclose(row.p_norm, math.erfc(abs(want[4]) / math.sqrt(2)))
    long = [(i, v, p, float((y[i] if v == "a" else y[i] ** 2) + p * (i % 2))) for i in range(5) for v in "ab" for p in (0, 1)]
    panel = spark.createDataFrame(long, "id long, variable string, period int, value double")
    got = {(r.variable, r.period): r.I for r in moran.moran(edges, panel, ["variable", "period"]).collect()}
    for (v, p), i in got.items():
        assert abs(i - oracle(w, np.array([x[3] for x in long if x[1:3] == (v, p)]))[0]) < 1e-10
    lagged = {r.id: r.lag for r in lag.spatial_lag(edges, vector(spark)).collect()}
    assert np.allclose([lagged[i] for i in range(5)], w @ y)
    z = (y - y.mean()) / y.std()
    local = {r.id: r for r in moran.moran_local(edges, vector(spark)).collect()}
    assert np.allclose([local[i].local_i for i in range(5)], 4 * z * (w @ z) / (z @ z))
    with pytest.raises(Exception, match="sum to zero"):
        moran.moran(edges.where("w < 0"), vector(spark)).collect()
    found = runners.moran_panel(edges, panel, 9, 5)
    assert found.count() == 4 and found.where("p_sim < 0.1").count() == found.where("p_sim = 0.1").count() - found.where("p_sim >= 0.1").count() + found.where("p_sim > 0.1").count()


def test_panel_permutations(spark, tmp_path):
    """The registered query: every series, R permutations, against brute force."""
    r = np.random.default_rng(4)
    events = [(int(u), "ab"[v], datetime(2024, 1, 1 + 7 * p, 12)) for u in range(1, 9) for v in (0, 1) for p in range(3) for _ in range(int(r.integers(1, 9)) + u * v)]
    spark.createDataFrame(events, "user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = {(x.variable, x.period): x for x in queries.QUERIES["moran_panel_perm"](spark, str(tmp_path)).collect()}
    w = np.array([[1 / (i - j) ** 2 if 0 < abs(i - j) <= 3 else 0 for j in range(8)] for i in range(8)])
    w /= w.sum(1, keepdims=True)
    index = lambda z: 8 / w.sum() * (z @ w @ z) / (z @ z)
    assert len(got) == 6
    for k, (v, p) in enumerate((v, p) for v in "ab" for p in range(3)):
        y = np.array([sum(e[0] == u and e[1] == v and (e[2].day - 1) // 7 == p for e in events) for u in range(1, 9)], float)
        orders = [bijection.bijection(np.arange(8), bijection.key(queries.SEED + k, rep), 8) for rep in range(queries.R)]
        sims, observed = np.array([index((y - y.mean())[o]) for o in orders]), index(y - y.mean())
        g = int((sims >= observed).sum())
        assert np.allclose([got[v, p].observed, got[v, p].EI_sim, got[v, p].p_sim], [observed, sims.mean(), (min(g, 99 - g) + 1) / 100])


def test_validation(spark):
    schema.validate_values(vector(spark), n=5)
    for bad in (vector(spark, [1.0, math.nan]), vector(spark, [1.0, math.inf]), vector(spark, [1.0, None]), vector(spark, [2.0, 2.0]), vector(spark, []), vector(spark).union(vector(spark))):
        with pytest.raises(ValidationError):
            schema.validate_values(bad)
    schema.validate_values(vector(spark, [2.0, 2.0]), allow_constant=True)
    with pytest.raises(ValidationError):
        schema.validate_values(vector(spark), n=6)
    with pytest.raises(TypeError):
        schema.validate_values(vector(spark).withColumn("value", F.lit(True)))
    with pytest.raises(ValidationError):
        schema.validate_edges(path_graph(spark), vector(spark, VALUES[:3]))
    assert schema.validate_edges(path_graph(spark), vector(spark)) == 5
    with pytest.raises(ValidationError):
        schema.require_columns(vector(spark), ["id", "x"])


# ---------------------------------------------------------------- inference
def test_bijections():
    for n in (1, 2, 3, 5, 63, 64, 1000):
        keys = bijection.key(-3, np.arange(40))[:, None]
        y = bijection.bijection(np.arange(n)[None, :], keys, n)
        assert (np.sort(y, 1) == np.arange(n)).all() and (bijection.inverse(y, keys, n) == np.arange(n)).all()
    orders = Counter(map(tuple, bijection.bijection(np.arange(4)[None, :], bijection.key(1, np.arange(24_000))[:, None], 4)))
    assert len(orders) == 24 and sum((c - 1000) ** 2 / 1000 for c in orders.values()) < 50
    gaps = np.diff(bijection.bijection(np.array([0, 50])[None, :], bijection.key(2, np.arange(50_000))[:, None], 100), axis=1) % 100
    assert ((np.bincount(gaps.ravel(), minlength=100)[1:] - 50_000 / 99) ** 2 / (50_000 / 99)).sum() < 160


def test_permutations(spark, monkeypatch):
    r = np.random.default_rng(1)
    a = r.normal(size=(6, 6)) + np.arange(6)[:, None]
    op = RasterOperator(grid(spark, a), rook())
    first, again = (runners.raster_global_permutations(op, 49, 7).first() for _ in range(2))
    assert first == again and abs(first.observed - moran.moran_global_raster(op).first().I) < 1e-10
    assert first.p_sim == (min(first.n_at_least, 49 - first.n_at_least) + 1) / 50 and first.p_sim <= 0.5 and abs(first.EI_sim + 1 / 35) < 0.1
    # the replicates as NumPy makes them
    cells, w = stencil_matrix(np.ones((6, 6), bool), rook())
    w /= w.sum(1, keepdims=True)
    z = a.ravel() - a.mean()
    sims = []
    for rep in range(49):
        moved = z[bijection.bijection(np.arange(36), bijection.key(7, rep), 36)]
        sims.append(36 / w.sum() * (moved @ w @ moved) / (z @ z))
    kept = {x.rep: x.sim for x in runners.raster_global_permutations(op, 49, 7, keep=True).collect()}
    assert np.allclose([kept[k] for k in range(49)], sims, atol=1e-10) and abs(first.min_sim - min(sims)) < 1e-10 and abs(first.seI_sim - np.std(sims)) < 1e-10
    local = {(x.row, x.col): x for x in runners.raster_local(op, 199, 7).collect()}
    alone = {(x.row, x.col): x for x in runners.raster_local(op, 199, 7, draws="independent").collect()}
    assert np.mean([abs(local[k].p_sim - alone[k].p_sim) for k in local]) < 0.06
    assert all(x.p_sim >= 1 / 200 and x.p_fdr >= x.p_sim - 1e-12 and x.min_sim - 1e-12 <= x.permutation_mean <= x.max_sim + 1e-12 for x in local.values())
    for bad in (lambda: permute.require_permutations(0, 1), lambda: permute.require_permutations(9, None), lambda: runners.raster_local(op, 9, 7, draws="own")):
        with pytest.raises(ValidationError):
            bad()
    monkeypatch.setattr(permute, "BROADCAST_BYTES", 0)  # the joined plans, a replicate's draws at a time
    big = runners.raster_global_permutations(op, 49, 7).first()
    assert big.n_at_least == first.n_at_least and abs(big.EI_sim - first.EI_sim) < 1e-10 and abs(big.seI_sim - first.seI_sim) < 1e-10
    island = np.ones((6, 6), bool)
    island[0, 1] = island[1, 0] = False
    for mask in (None, island):
        cut = RasterOperator(grid(spark, a, mask), rook())
        for draws in permute.LOCAL:
            joined = {(x.row, x.col): x for x in runners.raster_local(cut, 9, 7, draws=draws).where("valid").collect()}
            with monkeypatch.context() as m:
                m.setattr(permute, "BROADCAST_BYTES", 1 << 20)
                near = {(x.row, x.col): x for x in runners.raster_local(cut, 9, 7, draws=draws).where("valid").collect()}
            assert all(near[k].n_at_least == joined[k].n_at_least and abs(near[k].min_sim - joined[k].min_sim) < 1e-10 and abs(near[k].permutation_std - joined[k].permutation_std) < 1e-6 for k in near)


def test_independent_draws_equal_numpy(spark):
    a = np.random.default_rng(2).normal(size=(4, 5))
    found = {(x.row, x.col): x for x in runners.raster_local(RasterOperator(grid(spark, a), rook()), 29, 5, draws="independent").collect()}
    z = (a.ravel() - a.mean()) / a.std()
    cells, w = stencil_matrix(np.ones((4, 5), bool), rook())
    w /= w.sum(1, keepdims=True)
    for i, c in enumerate(cells):
        slots = [w[i, cells.index((c[0] + dr, c[1] + dc))] if (c[0] + dr, c[1] + dc) in cells else 0.0 for dr, dc in rook().offsets]
        sims = []
        for rep in range(29):
            h = bijection.bijection(np.arange(4), bijection.key(5, rep, i), 19)
            assert len(set(h)) == 4
            sims.append(19 / 20 * z[i] * (z[h + (h >= i)] @ slots))
        g = sum(s >= found[c].local_i - 1e-10 for s in sims)
        assert found[c].n_at_least == g and abs(found[c].min_sim - min(sims)) < 1e-10 and abs(found[c].max_sim - max(sims)) < 1e-10 and abs(found[c].permutation_mean - np.mean(sims)) < 1e-10


def test_permutation_moments_are_those_of_random_orders(spark):
    a = np.random.default_rng(3).normal(size=(7, 7))
    found = runners.raster_global_permutations(RasterOperator(grid(spark, a), queen()), 2000, 1).first()
    edges = RasterOperator(grid(spark, a).withColumn("id", F.col("row") * 7 + F.col("col")), queen()).edges("id")
    exact = moran.moran(edges, grid(spark, a).select((F.col("row") * 7 + F.col("col")).alias("id"), "value")).first()
    assert abs(found.EI_sim - exact.EI) < 4 * exact.VI_rand**0.5 / 2000**0.5 and abs(found.seI_sim / exact.VI_rand**0.5 - 1) < 0.08


def test_batches_shuffle_by_themselves(spark):
    a, b = (np.random.default_rng(k).normal(size=(5, 5)) for k in (4, 5))
    both = grid(spark, a).withColumn("k", F.lit(0)).unionByName(grid(spark, b).withColumn("k", F.lit(1)))
    joint = {(x.k, x.row, x.col): x for x in runners.raster_local(RasterOperator(both, rook(), keys=("k",)), 49, 7).collect()}
    for k, one in ((0, a), (1, b)):  # a batch shuffles under seed + its index, and is a family of tests of its own
        for x in runners.raster_local(RasterOperator(grid(spark, one), rook()), 49, 7 + k).collect():
            y = joint[(k, x.row, x.col)]
            assert (x.p_sim, x.p_fdr) == (y.p_sim, y.p_fdr) and abs(x.permutation_mean - y.permutation_mean) < 1e-12


def test_few_values(spark):
    values = with_positions(vector(spark).withColumnRenamed("value", "z"), ["id"]).withColumn("series", F.lit(0))
    h, low, high = permute.shared_draws(values, 4, range(30), 11, {0: 5})[0]
    assert (np.sort(h, 1) == np.arange(4)).all()
    z = np.array(VALUES)
    assert (low == z[h]).all() and (high == z[h + 1]).all()
    with pytest.raises(ValidationError):
        permute.local_conditional(values, values, 5, 3, 1)


def test_local_vector_inference(spark):
    values = [1.0, 2.0, 3.0, 9.0, 8.0, 7.0, 2.0, 1.0]
    found = runners.moran_local_inference(path_graph(spark, 8), vector(spark, values), 19, 3)
    assert found.count() == 8 and found.where("p_sim between 0.05 and 0.5").count() == 8 and set(found.columns) >= {"cluster", "cluster_fdr", "p_fdr"}
    panel = vector(spark, values).withColumn("variable", F.lit("a")).unionByName(vector(spark, values[::-1]).withColumn("variable", F.lit("b")))
    every = {(r.variable, r.id): r for r in runners.moran_local_inference(path_graph(spark, 8), panel, 19, 3, keys=["variable"]).collect()}
    for r in found.collect():
        assert (every["a", r.id].p_sim, every["a", r.id].p_fdr) == (r.p_sim, r.p_fdr)
    whole = runners.moran_permutations(path_graph(spark, 8), vector(spark, values), 19, 3).first()
    assert abs(whole.I - moran.moran(path_graph(spark, 8), vector(spark, values)).first().I) < 1e-12 and 0.05 <= whole.p_sim <= 0.5
    for bad in ([2.0] * 8, [1.0, math.nan, *values[2:]]):
        with pytest.raises(Exception, match="constant|NaN"):
            moran.moran_local(path_graph(spark, 8), vector(spark, bad)).collect()
    with pytest.raises(ValidationError):
        runners.moran_permutations(path_graph(spark, 9), vector(spark, values), 19, 3)


def test_fdr(spark):
    p = spark.createDataFrame([(k, x) for k, x in enumerate([0.001, 0.02, 0.2, 0.8, 0.04])], "id int, p double")
    adjusted = lambda m, df=p: [r.p_adjusted for r in fdr.adjust_pvalues(df, m).orderBy("id").collect()]
    want = {
        "fdr_bh": [0.005, 0.05, 0.25, 0.8, 0.2 / 3], "bonferroni": [0.005, 0.1, 1, 1, 0.2], "holm": [0.005, 0.08, 0.4, 0.8, 0.12], "simes-hochberg": [0.005, 0.08, 0.4, 0.8, 0.12],
        "sidak": [1 - (1 - x) ** 5 for x in (0.001, 0.02, 0.2, 0.8, 0.04)], "hommel": [0.005, 0.08, 0.4, 0.8, 0.12],
    }
    for method, values in want.items():
        assert np.allclose(adjusted(method), values), method
    c = sum(1 / k for k in range(1, 6))
    assert np.allclose(adjusted("fdr_by"), [min(1, c * x) for x in want["fdr_bh"]])
    assert np.allclose(adjusted("fdr_tsbh"), np.minimum(1, np.array(want["fdr_bh"]) * 3 / 5))  # two of five are rejected first
    assert np.allclose(adjusted("fdr_tsbky"), np.minimum(1, np.array(want["fdr_bh"]) * 4 / 5 * 1.05))
    few = spark.createDataFrame([(0, 0.001), (1, 0.002)], "id int, p double")  # all are rejected first: the factor stays
    assert np.allclose(adjusted("fdr_tsbky", few), [0.0021, 0.0021]) and np.allclose(adjusted("fdr_tsbh", few), [0.002, 0.002])
    ends = spark.createDataFrame([(0, 0.01), (1, 0.2), (2, 1.0), (3, 0.0)], "id int, p double")
    for method in fdr.METHODS:
        got = adjusted(method, ends)
        if not method.startswith("fdr_ts"):
            assert got[2] == 1 and got[3] == 0 and all(q >= x for q, x in zip(got, [0.01, 0.2, 1.0, 0.0], strict=True)), method
    ties = spark.createDataFrame([(0, 0.01), (1, 0.03), (2, 0.03), (3, 0.5)], "id int, p double")
    assert np.allclose(adjusted("fdr_bh", ties), [0.04, 0.04, 0.04, 0.5]) and np.allclose(adjusted("holm", ties), [0.04, 0.09, 0.09, 0.5])
    families = p.withColumn("f", F.col("id") % 2)
    assert fdr.adjust_pvalues(families, keys=["f"]).count() == 5 and fdr.adjust_pvalues(families, "hommel", keys=["f"]).count() == 5
    for bad in (p.union(spark.createDataFrame([(9, 1.5)], p.schema)), p.union(spark.createDataFrame([(9, None)], p.schema))):
        with pytest.raises(ValidationError):
            fdr.adjust_pvalues(bad)
    with pytest.raises(ValidationError):
        fdr.adjust_pvalues(p, "none")


def brute_hommel(p):
    """By its definition: the largest adjusted value over all intersections, by Simes."""
    p = np.array(p)
    out = []
    for k in range(len(p)):
        others, worst = np.delete(p, k), 0.0
        for size in range(len(others) + 1):
            chosen = np.sort(np.append(np.sort(others)[::-1][:size], p[k]))  # the worst set of its size
            worst = max(worst, min(1.0, np.min((size + 1) * chosen / np.arange(1, size + 2))))
        out.append(worst)
    return out


@pytest.mark.parametrize("rows", [None, 3])
def test_fdr_over_ranges(spark, monkeypatch, rows):
    """Families of any size, ranked in one task or over ranges of p-values."""
    r = np.random.default_rng(8)
    values = [(f, int(k), float(x)) for f in (0, 1, None) for k, x in enumerate(np.round(r.random(9 + (f or 0)) ** 3, 2))] + [(2, 0, 1.0), (3, 0, 0.0)]
    if rows:
        monkeypatch.setattr(fdr, "RANKED_A_TASK", rows)
    table = spark.createDataFrame(values, "f int, id int, p double")
    families = {f: [(k, x) for g, k, x in values if g == f] for f, _, _ in values}
    for method in fdr.METHODS:
        got = {(x.f, x.id): x.p_adjusted for x in fdr.adjust_pvalues(table, method, keys=["f"]).collect()}
        assert len(got) == len(values)
        for f, family in families.items():
            p = np.array([x for _, x in family])
            m, order = len(p), np.argsort(p, kind="stable")
            up = lambda raw: np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
            rank, x = np.arange(1, m + 1), p[order]
            bh, h = up(x * m / rank), sum(1 / k for k in range(1, m + 1))
            stage = {}
            for name, factor in (("fdr_tsbh", 1.0), ("fdr_tsbky", 1.05)):
                first = int((bh <= 0.05 / factor).sum())
                stage[name] = np.minimum(1, up(x * m / rank) * (factor if first in (0, m) else (m - first) / m * factor))
            want = {
                "bonferroni": np.minimum(1, x * m), "sidak": 1 - (1 - x) ** m, "holm": np.minimum(1, np.maximum.accumulate(x * (m - rank + 1))), "holm-sidak": np.maximum.accumulate(1 - (1 - x) ** (m - rank + 1)),
                "simes-hochberg": up(x * (m - rank + 1)), "fdr_bh": bh, "fdr_by": up(x * m / rank * h), "hommel": np.array(brute_hommel(x)), **stage,
            }
            assert np.allclose([got[f, family[k][0]] for k in order], want[method], atol=1e-9), (method, f)


def test_harmonic_numbers(spark):
    m = [1, 2, 63, 64, 1000, 100_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in m], "m long").select(fdr.harmonic(F.col("m"))).collect()]
    assert np.allclose(got, [math.fsum(1 / k for k in range(1, x + 1)) for x in m], rtol=1e-14)


def test_both_operators_follow_the_protocol(spark):
    from spatlas.operators.base import SpatialOperator

    matrix = weights.MatrixOperator(path_graph(spark), vector(spark).select("id"))
    assert isinstance(matrix, SpatialOperator) and isinstance(RasterOperator(grid(spark, [[1.0, 2.0]]), rook()), SpatialOperator)
    assert matrix.s0().first().s0 == 5 and matrix.islands().count() == 0 and matrix.apply(vector(spark)).where("id = 0").first().lag == 2.5


def test_command_line(spark, tmp_path):
    from spatlas.__main__ import main

    rows = [(r * 4 + c, "t", r, c, r, c, float(c), -float(r)) for r in range(4) for c in range(4)]
    g = spark.createDataFrame(rows, "cell_id long, tile_id string, row int, col int, grid_row int, grid_col int, lon double, lat double")
    g.write.parquet(str(tmp_path / "g"))
    g.select("cell_id", F.pow(F.col("cell_id") % 5, 2).alias("ntl")).write.parquet(str(tmp_path / "d"))
    out = str(tmp_path / "out")
    assert main(["audit", str(tmp_path / "g"), str(tmp_path / "d"), out + "/audit"]) == 0 and (tmp_path / "out/audit.md").exists()
    assert main(["permute", str(tmp_path / "g"), str(tmp_path / "d"), out, "9"]) == 0 and "p_sim" in (tmp_path / "out/permutations.json").read_text()
    assert main([]) == 1 and main(["other"]) == 1
    path_graph(spark, 8).write.parquet(str(tmp_path / "e"))
    vector(spark, [1.0, 2.0, 3.0, 9.0, 8.0, 7.0, 2.0, 1.0]).write.parquet(str(tmp_path / "v"))
    assert main(["validate", str(tmp_path / "e"), str(tmp_path / "v"), out, "49"]) == 0
    told = json.loads((tmp_path / "out/validation.json").read_text())
    assert told["deterministic"] and told["quadrant_mismatches"] == 0 and told["local_p_mean_abs_difference"] < 0.2


# ---------------------------------------------------------------- interpretation, audit, files
def test_interpretation(spark, tmp_path):
    local = spark.createDataFrame([("HH", True), ("LL", False), ("island", True), ("island", False), ("LH", True)], "quadrant string, significant boolean")
    counts = interpret.result_counts(local)
    assert tuple(counts.first()) == (5, 3, 0, 1, 2)
    run = [("rook", 0.5, 0.01, 9, 1, 10, 4, 0.4, 0, 1, 1, 1, 1, 1), ("queen", 0.4, 0.02, 9, 1, 10, 9, 0.9, 0, 3, 1, 1, 0, 0), ("d2_r2", 0.3, 0.03, 9, 0, 11, 0, 0.0, 0, 0, 0, 0, 0, 0)]
    table = spark.createDataFrame(run, interpret.COMPARISON)
    fixed = interpret.canonical_comparison(table, counts.withColumn("stencil", F.lit("queen")))
    assert fixed.columns.index("raw_significant_total") == fixed.columns.index("inferential_significant") - 1 and "local_FDR_share" not in fixed.columns
    told = interpret.interpretation(fixed, seed=7)
    assert told["seed"] == 7 and told["operators"]["queen"] == {
        "moran_i": 0.4, "p_sim": 0.02, "permutations": 9, "islands": 1, "valid_nonisland": 10, "raw_local_significant": 3, "significant_on_nodata": 0, "significant_on_islands": 1,
        "inferential_local_fdr_significant": 2, "inferential_local_fdr_share": 0.2,
    } and told["operators"]["rook"]["raw_local_significant"] == 5
    with pytest.raises(ValidationError):
        interpret.canonical_comparison(table)
    mask = spark.createDataFrame([(True, False, True, 1), (True, True, True, 0), (False, False, True, 2), (True, False, False, 3), (True, False, None, 3)], "v boolean, i boolean, s boolean, q int")
    assert [r[0] for r in mask.select(inferential_mask(F.col("v"), F.col("i"), F.col("s"), F.col("q"))).collect()] == [True, False, False, False, False]
    line = [tuple(r) for r in interpret.moran_scatter_line(spark, 0.5, -1.0, 2.0, 5).collect()]
    assert (0.0, 0.0) in line and len(line) == 6 and all(math.isclose(y, 0.5 * x) for x, y in line)
    assert [tuple(r) for r in interpret.moran_scatter_line(spark, 0.5, 1.0, 1.0, 2).collect()] == [(1.0, 0.5)] * 2
    for bad in ((0.5, 2.0, 1.0), (math.nan, 0.0, 1.0), (0.5, 0.0, math.inf), (0.5, 0.0, 1.0, 1)):
        with pytest.raises(ValidationError):
            interpret.moran_scatter_line(spark, *bad)
    write_json({"é": 1}, str(tmp_path / "m/metadata/example.json"))
    write_json({}, str(tmp_path / "m/manifest.json"))
    rows = interpret.manifest(spark, str(tmp_path / "m")).collect()
    assert [tuple(r)[0:2] + tuple(r)[3:] for r in rows] == [("metadata/example.json", (tmp_path / "m/metadata/example.json").stat().st_size, "metadata/json", "local-only", "")]
    marked = interpret.manifest(spark, str(tmp_path / "m"), canonical=["metadata/.*"]).first()
    assert marked.condition == "canonical" and len(marked.sha256) == 64
    assert files.hashed_files(spark, str(tmp_path / "m"), large=True).first().sha256 == files.hashed_files(spark, str(tmp_path / "m")).first().sha256


def test_frames_and_reports(spark):
    found = runners.moran_local_inference(path_graph(spark, 8), vector(spark, [1.0, 2.0, 3.0, 9.0, 8.0, 7.0, 2.0, 1.0]), 19, 3)
    frame = reports.local_frame(found)
    assert frame.columns == reports.FRAME and len(reports.FRAME) == 13 and frame.first().backend == "spark" and "n = 8" in reports.local_summary(found)
    names = spark.createDataFrame([(k, f"n{k}") for k in range(8)], "id long, label string")
    assert sorted(r.id for r in reports.local_frame(found, names).collect()) == [f"n{k}" for k in range(8)]
    for bad in (names.limit(3), names.union(names), names.union(spark.createDataFrame([(9, "x")], names.schema))):
        with pytest.raises(ValidationError):
            reports.local_frame(found, bad)
    assert "p_sim = None" in reports.global_summary(moran.moran(path_graph(spark, 8), vector(spark, [1.0, 2.0, 3.0, 9.0, 8.0, 7.0, 2.0, 1.0])).first())
    assert reports.memory_diagnostics(spark)["total_bytes"] > 0
    rows = reports.baseline_run({"path": path_graph(spark, 8)}, vector(spark, [1.0, 2.0, 3.0, 9.0, 8.0, 7.0, 2.0, 1.0]), (9,))
    assert rows[0]["nnz"] == 14 and rows[0]["n"] == 8
    timed = reports.benchmark_run(spark, (12,), 9, 1)["results"]
    assert [r["operation"] for r in timed] == ["inverse_distance_and_lag", "global_moran_9"] and timed[0]["nnz"] == 132
    assert reports.panel_benchmark(spark, 10, 2, 1, 9, 1)["repetitions"] == 1


def test_sinks_and_csv(spark, tmp_path):
    local = moran.moran_local_raster(RasterOperator(grid(spark, np.arange(9.0).reshape(3, 3)).withColumn("cell_id", F.col("row") * 3 + F.col("col")), rook()))
    write_local_parquet(local, str(tmp_path / "local"))
    back = read_local(spark, str(tmp_path / "local"))
    assert back.dtypes == [("cell_id", "int"), ("local_i", "float"), ("spatial_lag", "float"), ("quadrant", "string"), ("p_sim", "float"), ("p_fdr", "float"), ("significant", "boolean")]
    assert back.where("p_sim IS NOT NULL").count() == 0 and back.count() == 9
    metrics = spark.createDataFrame([("rook", 1), ("queen", 2)], "stencil string, n int").coalesce(1)
    write_csv(metrics, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "n int, stencil string", order=("stencil", ["rook", "queen"])).count() == 2
    with pytest.raises(ValidationError):
        files.read_csv(spark, str(tmp_path / "csv"), "n int, stencil string", order=("stencil", ["queen", "rook"]))
    with pytest.raises(ValidationError):
        files.read_csv(spark, str(tmp_path / "csv"), "n int, x string")


def test_audit(spark):
    rows = [(r * 6 + c, f"t{c // 3}", r, c % 3, r, c, float(c), 10.0 - r) for r in range(3) for c in range(6) if (r, c) != (2, 5)]
    g = spark.createDataFrame(rows, "cell_id long, tile_id string, row int, col int, grid_row int, grid_col int, lon double, lat double")
    found = audit.audit(g, g.select("cell_id", F.lit(1.0).alias("ntl")))
    assert found["continuous_national_index"] and found["holes"] == 1 and found["cross_tile_rook_edges_horizontal"] == 3 and found["cross_tile_rook_edges_vertical"] == 0
    assert found["orientation"] == {"rows": "north_to_south", "columns": "west_to_east", "grid_row_lat_spearman": pytest.approx(-1), "grid_col_lon_spearman": pytest.approx(1)}
    assert found["bounds"] == {"grid_row_min": 0, "grid_row_max": 2, "grid_col_min": 0, "grid_col_max": 5} and found["memory_estimates"]["float32"]["values_lag_local_i_bytes"] == 18 * 12
    assert found["tile_h_v_constant_within_tile"] and "north_to_south" in audit_report(found)
    two = audit.audit(g.withColumn("tile_h", F.col("col")).withColumn("row", F.lit(0)), g.limit(3).select("cell_id", F.lit(1.0).alias("ntl")))
    assert not (two["continuous_national_index"] or two["tile_row_offset_constant"] or two["tile_h_v_constant_within_tile"])


def test_synthetic_and_runtime(spark):
    assert [list(r.coords) for r in synthetic.synthetic_coordinates(spark, 5, "grid").orderBy("id").collect()] == [[0, 0], [0, 1], [0, 2], [1, 0], [1, 1]]
    for kind in ("random", "clustered"):
        a, b = (synthetic.synthetic_coordinates(spark, 50, kind).repartition(k).orderBy("id").collect() for k in (1, 3))
        assert a == b and all(0 - 0.2 < x < 1.2 for r in a for x in r.coords)
    with pytest.raises(ValidationError):
        synthetic.synthetic_coordinates(spark, 5, "ring")
    p = synthetic.synthetic_panel(spark, 400, 2, 2, missing=True)
    assert p.where("isnan(value)").count() == 10 and abs(p.where("NOT isnan(value)").agg(F.stddev("value")).first()[0] - 1) < 0.1
    assert runners.benchmark_call(lambda: spark.range(10), 2)["repetitions"] == 2 and runners.diagnostics(spark)["spark"] == spark.version
    assert abs(spark.range(1).select(two_sided_p(F.lit(1.96)).alias("p")).first().p - 0.05) < 1e-4


def test_observed_run_and_stream(spark, tmp_path):
    a = np.abs(np.random.default_rng(0).normal(size=(4, 4)))
    cells = grid(spark, a).withColumn("cell_id", (F.col("row") * 4 + F.col("col")).cast("long"))
    assert runners.observed_run(cells, str(tmp_path / "out")).count() == 6 and read_local(spark, str(tmp_path / "out/raw_rook")).count() == 16
    from spatlas.streaming.daily import stream_days

    days = cells.select("cell_id", F.lit(1).alias("day"), F.col("value").alias("ntl")).union(cells.select("cell_id", F.lit(2), F.col("value") + F.col("row")))
    days.repartition(1).write.parquet(str(tmp_path / "days"))
    places = cells.select("cell_id", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"))
    stream_days(spark, str(tmp_path / "days"), "cell_id long, day int, ntl double", places, str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination(120)
    got = {r.day: r.I for r in spark.read.parquet(str(tmp_path / "i")).collect()}
    assert abs(got[1] - moran.moran_global_raster(RasterOperator(cells, queen())).first().I) < 1e-10 and len(got) == 2


def brute(x, ids, k=None, threshold=None):
    """{(i, j): d2} of all pairs, by a loop over dimensions, ties to the smaller id."""
    d2 = np.zeros((len(x), len(x)))
    for c in x.T:
        d2 += (c[:, None] - c[None, :]) ** 2
    np.fill_diagonal(d2, np.nan)
    out = {}
    for a in range(len(x)):
        order = [b for b in np.lexsort((ids, d2[a])) if b != a][:k]
        out |= {(int(ids[a]), int(ids[b])): d2[a, b] for b in order if threshold is None or d2[a, b] <= threshold * threshold}
    return out


def scattered(spark, d, n=260):
    """Points of which some are close to others, far from the origin, with equal distances, and ids of both signs."""
    r = np.random.default_rng(d)
    x = r.normal(size=(n, d)) + 100
    x[: n // 4] = np.round(x[: n // 4] * 4) / 4 + np.arange(n // 4)[:, None] * 8
    x[n // 4 : n // 2] = x[n // 2 : n // 2 + n // 2 - n // 4] + r.normal(size=(n // 2 - n // 4, d)) * 1e-7
    ids = r.permutation(n) * (1 << 40) - (1 << 48)
    return x, ids, spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id long, coords array<double>")


@pytest.mark.parametrize("d", [1, 2, 9])
def test_nearest_in_blocks_equal_brute_force(spark, d):
    x, ids, table = scattered(spark, d)
    for k, threshold in ((1, None), (8, None), (8, 1.0)):
        want = brute(x, ids, k, threshold)
        found = {(r.i, r.j): r.d2 for r in weights.neighbour_pairs(table, threshold, k).collect()}
        assert found == want


@pytest.mark.parametrize("d", [2, 9])
def test_row_summaries_equal_edges(spark, d):
    """All pairs and bands: the rows that edges sum to, n = 0 for islands."""
    x, ids, table = scattered(spark, d, 120)
    for threshold, power, binary, standard in ((None, 2.0, False, True), (2.0, 2.0, False, True), (2.0, 1.0, False, False), (2.0, 2.0, True, False)):
        edges = {(r.i, r.j): r.w for r in weights.inverse_distance_weights(table, power, threshold, None, standard, binary).collect()}
        assert edges.keys() == brute(x, ids, None, threshold).keys()
        rows = {r.i: r for r in weights.row_summaries(table, power, threshold, standard, binary).collect()}
        assert rows.keys() == set(ids.tolist())
        for i, r in rows.items():
            own = {j: w for (a, j), w in edges.items() if a == i}
            assert (r.n, r.sum_j) == (len(own), sum(own))
            got = (r.sum_w, r.sum_wj, r.min_w or 0.0, r.max_w or 0.0)
            assert np.allclose(got, (sum(own.values()), sum(j * w for j, w in own.items()), min(own.values(), default=0), max(own.values(), default=0)), rtol=1e-9, atol=1e-12)
        full = weights.inverse_distance_weights(table, power, threshold, None, standard, binary)
        a, b = weights.weight_diagnostics(full, table).first().asDict(), weights.summary_diagnostics(weights.row_summaries(table, power, threshold, standard, binary)).first().asDict()
        assert a.keys() == b.keys() and all(math.isclose(a[c], b[c], rel_tol=1e-9) for c in a)


def test_band_queries_make_no_edges(spark, tmp_path):
    """The plans of the dense queries neither shuffle nor join pairs, so disk and rows grow as the points do."""
    r = np.random.default_rng(8)
    spark.createDataFrame([(k, [float(v) for v in r.normal(size=6)], k % 3) for k in range(50)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("idw_full", "idw_threshold", "idw_binary", "distance_band_weights", "weight_diagnostics"):
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "CartesianProduct" not in plan, name
    for name in ("idw_knn", "idw_power1", "transform_b"):  # pairs come ranked from the task that holds them all
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" not in plan and "Window" not in plan, name


def test_many_points_are_not_joined(spark, monkeypatch):
    """The catalyst strategy gives the same pairs in blocks, beyond the size that a join of all pairs is for."""
    x, ids, table = scattered(spark, 5, 60)
    joined = {tuple(r) for r in weights.neighbour_pairs(table, k=6, strategy="catalyst").collect()}
    monkeypatch.setattr(weights, "JOINED", 10)
    found = weights.neighbour_pairs(table, k=6, strategy="catalyst")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == joined and len(joined) == 360


def test_repeated_ids_are_not_their_own_neighbours(spark):
    table = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [5.0, 0.0]), (3, [6.0, 0.0])], "id long, coords array<double>")
    assert {(r.i, r.j) for r in weights.neighbour_pairs(table, k=1).collect()} == {(1, 2), (2, 3), (3, 2)}
    assert {r.i: r.n for r in weights.row_summaries(table, threshold=1.5).collect()} == {1: 0, 2: 1, 3: 1}


def test_stencil_over_tiles(spark):
    """Cells meet across the borders of tiles, on both sides of zero, and a task's rows don't multiply before they are dealt."""
    r = np.random.default_rng(6)
    a, mask = r.normal(size=(9, 150)), r.random((9, 150)) < 0.8
    for stencil in (rook(), inverse_distance(2), Stencil("far", [(0, 40, 1.0), (3, -33, 2.0)])):
        moved = grid(spark, a, mask).withColumns({"row": F.col("row") - 4, "col": F.col("col") - 70})
        plain = RasterOperator(moved, stencil).apply()
        got = {(x.row + 4, x.col + 70): x.lag for x in plain.where("valid").collect()}
        cells, w = stencil_matrix(mask, stencil)
        total = w.sum(1)
        want = np.divide(w @ np.array([a[c] for c in cells]), total, out=np.zeros(len(cells)), where=total > 0)
        assert len(got) == len(cells) and np.allclose([got[c] for c in cells], want)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert plain._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1


def test_global_values_reach_tasks_by_file(spark, monkeypatch):
    """Several blocks a series, and nothing collected or broadcast: the driver never holds all values."""
    r = np.random.default_rng(9)
    rows = [(s, k, float(r.normal() + s)) for s, n in ((0, 23), (3, 40)) for k in range(n)]
    values = spark.createDataFrame(rows, "series int, pos long, value double").repartition(5)
    edges = spark.createDataFrame([(k, (k + 1) % 23, 1.0) for k in range(23)], "i long, j long, w double")
    whole = {(x.series, x.rep): x.sim for x in permute.simulate_global(edges, values, 19, 3).collect()}
    monkeypatch.setattr(permute, "PLACES", 7)
    monkeypatch.setattr(permute, "_dense", lambda *a: pytest.fail("values on the driver"))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: pytest.fail("values are broadcast"))
    cut = {(x.series, x.rep): x.sim for x in permute.simulate_global(edges, values, 19, 3).collect()}
    assert len(cut) == 40 and all(math.isclose(cut[k], whole[k], rel_tol=1e-9, abs_tol=1e-12) for k in whole)
    z = np.array([x[2] for x in rows[:23]])
    z = z - z.mean()
    assert math.isclose(cut[0, -1], (z * np.roll(z, -1)).sum() / (z @ z), rel_tol=1e-9)


def test_neighbours_are_found_once(spark, tmp_path):
    """What standardizes or transforms nearest neighbours reads them again, and doesn't compare the points again."""
    r = np.random.default_rng(8)
    spark.createDataFrame([(k, [float(v) for v in r.normal(size=6)], k % 3) for k in range(50)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("idw_knn", "knn_weights", "idw_power1", "idw_knn_and_threshold", "transform_d", "transform_v", "transform_b"):
        if name == "knn_weights":  # 50 points are few enough for a join of all
            plan = weights.knn_weights(queries.points(spark, str(tmp_path)), k=6)._jdf.queryExecution().executedPlan().toString()
        else:
            plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan, name


def test_ties_are_gathered_in_pieces(monkeypatch):
    """Thousands of equal distances: the coordinates of a bounded number of pairs are held at once, in tiles that don't divide the block."""
    n, d, k = 300, 300, 5
    base = np.zeros(n, np.dtype([("id", "<i8"), ("x", "<f8", (d,))]))
    base["id"], base["x"] = np.random.default_rng(4).permutation(n), np.eye(n)
    gathered, exact = [], blocks._exact_of
    monkeypatch.setattr(blocks, "TILE", (64, 128))
    monkeypatch.setattr(blocks, "GATHERED", 1000)
    monkeypatch.setattr(blocks, "_exact_of", lambda a, b: gathered.append(len(a)) or exact(a, b))
    found = blocks._Nearest(blocks.Points("", n, d, np.full(d, 0.5), 1.0, False), base, 0, k)
    for first in (0, 200):
        found.meet(base[first : first + 200], first)
    least = np.arange(k)[None, :] + (np.arange(k)[None, :] >= base["id"][:, None])
    assert max(gathered) <= 1000 and (found.d2 == 2).all() and (found.j == least).all()


def test_first_block_leaves_few_candidates(monkeypatch):
    """What a tile shows of the k-th distance holds for the block's next tiles, also before any pair is merged."""
    n, d, k = 4096, 64, 8
    own = np.zeros(n, np.dtype([("id", "<i8"), ("x", "<f8", (d,))]))
    own["id"], own["x"] = np.arange(n), np.random.default_rng(3).normal(size=(n, d))
    met, exact = [], blocks._exact_of
    monkeypatch.setattr(blocks, "_exact_of", lambda a, b: met.append(len(a)) or exact(a, b))
    found = blocks._Nearest(blocks.Points("", n, d, np.zeros(d), 0.125, False), own[:256], 0, k)
    found.meet(own, 0)
    want = np.sort(((own["x"][:256, None] - own["x"][None]) ** 2).sum(2), axis=1)[:, 1 : k + 1]
    assert np.allclose(found.d2, want) and sum(met) < 256 * 50  # 44 a row; 64 if every tile began anew


def test_chunks_that_read_every_block_are_tasks(spark, monkeypatch):
    """No task takes several long chunks while other cores have none left."""
    monkeypatch.setattr(blocks, "CHUNKS", (32, 32))
    points = blocks.Points("", 32 * 100, 64, np.zeros(64), 1.0, False)
    assert blocks._dealt(spark, points, None, "i long").rdd.getNumPartitions() == 100
