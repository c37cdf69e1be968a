"""All pairs of points in bounded memory: the points are one file that every executor gets once, and a task reads it block by block
for its own chunk of points. Nothing is shuffled, and rows come only of what is asked for.

Points of up to ``LOW`` dimensions are in the file in the order of a space-filling curve, so that a block lies within a small box and
blocks out of reach are not read. Beyond, boxes overlap in all but name: every block is read, and a matrix product tells which pairs can matter."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, frexp

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.storage import handed_out

#: Dimensions up to which boxes of points are worth a look.
LOW = 4
#: Points of a block, by dimensions: few or many; points of a chunk; pairs that are held at once, and those that are weighed at once, by dimensions.
BLOCKS, CHUNKS, HELD, WEIGHED = (1024, 4096), (256, 4096), 1 << 21, (1 << 16, 1 << 18)
#: Rows and columns of a matrix product, which its buffer and the cache hold; pairs whose coordinates are gathered at once.
TILE, GATHERED = (2048, 512), 1 << 12
#: Bytes of one packed row.
PACKED = 4 << 20
#: Bits of an id's lower part: sums over a block of either part are exact in doubles.
ID_BITS = 26


@dataclass(frozen=True)
class Points:
    """What tasks must know about the file."""

    name: str
    n: int
    d: int
    centre: np.ndarray
    scale: float
    repeated: bool

    @property
    def low(self) -> bool:
        return self.d <= LOW

    @property
    def record(self) -> np.dtype:
        return np.dtype([("id", "<i8"), ("x", "<f8", (self.d,))])


def _morton(low: np.ndarray, high: np.ndarray):
    bits = 62 // len(low)
    span = np.where(high > low, high - low, 1.0)

    def key(x: np.ndarray) -> np.ndarray:
        """Places on the curve: the bits of the coordinates by turns."""
        cells = np.minimum((x - low) / span * 2.0**bits, 2.0**bits - 1).astype(np.int64)
        out = np.zeros(len(x), np.int64)
        for bit in range(bits - 1, -1, -1):
            for k in range(len(low)):
                out = (out << 1) | ((cells[:, k] >> bit) & 1)
        return out

    return key


def _coordinates(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("coords").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), d)


def _keyed(d: int, low: np.ndarray, high: np.ndarray):
    key = _morton(low, high)

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("coords"), pa.array(key(_coordinates(batch, d)))], names=["id", "coords", "key"])

    return scan


def _packed(d: int):
    record = np.dtype([("id", "<i8"), ("x", "<f8", (d,))])
    step = max(1, PACKED // record.itemsize)

    def scan(batches):
        for batch in batches:
            rows = np.empty(len(batch), record)
            rows["id"], rows["x"] = batch.column("id").to_numpy(), _coordinates(batch, d)
            for at in range(0, len(rows), step):
                yield pa.RecordBatch.from_arrays([pa.array([rows[at : at + step].tobytes()], pa.binary())], names=["rows"])

    return scan


def hand_out(points: DataFrame, n: int, d: int) -> Points:
    """The file of ``n`` checked points (id, coords) of ``d`` dimensions. The driver holds one partition of it, and the next as it comes."""
    held = points.select(F.col("id").cast("long").alias("id"), F.col("coords").cast("array<double>").alias("coords"))
    repeated = held.select("id").distinct().count() < n
    if d <= LOW:
        found = held.agg(*[f(F.col("coords")[k]) for f in (F.min, F.max) for k in range(d)]).first()
        low, high = np.array(found[:d]), np.array(found[d:])
        held = held.mapInArrow(_keyed(d, low, high), "id long, coords array<double>, key long").orderBy("key", "id").drop("key")
    rows = held.mapInArrow(_packed(d), "rows binary").toLocalIterator(prefetchPartitions=True)
    corners = [np.full(d, np.inf), np.full(d, -np.inf)]

    def chunks():
        for row in rows:
            x = np.frombuffer(row.rows, np.dtype([("id", "<i8"), ("x", "<f8", (d,))]))["x"]
            corners[:] = np.minimum(corners[0], x.min(0)), np.maximum(corners[1], x.max(0))
            yield bytes(row.rows)

    name = handed_out(points.sparkSession, chunks())
    centre = corners[0] / 2 + corners[1] / 2
    return Points(name, n, d, centre, 2.0 ** -frexp(float((corners[1] - centre).max()))[1], repeated)


# ---------------------------------------------------------------- in a task
class _File:
    def __init__(self, points: Points):
        self.points, self.file = points, open(SparkFiles.get(points.name), "rb")  # noqa: SIM115
        self.size = BLOCKS[0 if points.low else 1]
        self.blocks = ceil(points.n / self.size)
        if points.low:
            corners = [(x.min(0), x.max(0)) for x in (self.read(b * self.size, self.size)["x"] for b in range(self.blocks))]
            self.lows, self.highs = (np.array(c) for c in zip(*corners, strict=True))

    def read(self, first: int, count: int) -> np.ndarray:
        self.file.seek(first * self.points.record.itemsize)
        return np.fromfile(self.file, self.points.record, min(count, self.points.n - first))

    def order(self, x: np.ndarray, first: int) -> list[tuple[int, float]]:
        """Blocks with the smallest squared distance that a pair can have: near ones first, or from that of the points themselves on."""
        own = first // self.size
        if not self.points.low:
            return [((own + b) % self.blocks, 0.0) for b in range(self.blocks)]
        least, low, high = np.zeros(self.blocks), x.min(0), x.max(0)
        for k in range(self.points.d):
            gap = np.maximum(np.maximum(self.lows[:, k] - high[k], low[k] - self.highs[:, k]), 0.0)
            least += gap * gap
        least[own] = -1.0
        return [(int(b), float(least[b])) for b in np.argsort(least, kind="stable")]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``a`` to every row of ``b``, dimension by dimension."""
    d2 = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        d2 += gap * gap
    return d2


def _exact_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, summed in the same order."""
    d2 = np.zeros(len(a))
    for k in range(a.shape[1]):
        gap = a[:, k] - b[:, k]
        d2 += gap * gap
    return d2


def _same(points: Points, own: np.ndarray, at: int, base: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a point meets itself, or an id itself if ids repeat."""
    if points.repeated:
        return np.nonzero(own["id"][:, None] == base["id"][None, :])
    c = np.arange(at, at + len(own)) - first
    r = np.flatnonzero((c >= 0) & (c < len(base)))
    return r, c[r]


class _Nearest:
    """The k nearest of a chunk's points so far, by distance, then id."""

    def __init__(self, points: Points, own: np.ndarray, at: int, k: int):
        self.points, self.own, self.at, self.k = points, own, at, k
        self.d2, self.j = np.full((len(own), k), np.inf), np.full((len(own), k), np.iinfo(np.int64).max)
        if not points.low:
            x = (own["x"] - points.centre) * points.scale
            self.norms = (x * x).sum(1)
            self.left = np.concatenate([-2 * x, np.ones((len(x), 1))], axis=1).astype(np.float32)
            self.tile = np.empty(TILE[0] * TILE[1], np.float32)

    def _near(self, base: np.ndarray) -> tuple[np.ndarray | None, float]:
        """What a matrix product takes of the block, and the largest squared norm."""
        if self.points.low:
            return None, 0.0
        x = (base["x"] - self.points.centre) * self.points.scale
        norms = (x * x).sum(1)
        return np.concatenate([x, norms[:, None]], axis=1).astype(np.float32).T.copy(), float(norms.max())

    def _limits(self, rows: slice, largest: float) -> tuple[np.ndarray, np.ndarray]:
        """Up to what ``near`` may be of a pair that still matters, and by how much it may be wrong."""
        bound = self.d2[rows, -1]
        if self.points.low:
            return bound.copy(), np.zeros(len(bound))
        slack = (self.points.d + 8) * 2.0**-23 * (self.norms[rows] + 2 * largest) + 1e-30
        return bound * self.points.scale**2 - self.norms[rows] + slack, slack

    def _candidates(self, base: np.ndarray, first: int, rows: slice, right: np.ndarray | None, limit: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within ``limit``; rows that have met fewer than k points lower theirs to what they find here."""
        own = self.own[rows]
        if self.points.low:
            near = _exact(own["x"], base["x"])
        else:
            near = self.tile[: len(own) * len(base)].reshape(len(own), len(base))
            np.matmul(self.left[rows], right, out=near)  # the squared distance less the own norm, within slack
        at = self.at + rows.start
        if self.points.repeated or at < first + len(base) and first < at + len(own):
            near[_same(self.points, own, at, base, first)] = np.inf
        if len(base) > self.k and np.isinf(self.d2[rows, -1]).any():
            np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack, out=limit)
        top = np.nextafter(limit.astype(near.dtype), near.dtype.type(np.inf))
        some = np.flatnonzero(near.min(axis=1) <= top)  # soon few rows
        near = near[some]
        r, c = np.nonzero((near <= top[some, None]) & np.isfinite(near))
        return some[r] + rows.start, c

    def meet(self, base: np.ndarray, first: int) -> None:
        right, largest = self._near(base)
        width = len(base) if self.points.low else TILE[1]
        step = max(1, HELD // len(base)) if self.points.low else TILE[0]
        for begin in range(0, len(self.own), step):
            rows = slice(begin, min(begin + step, len(self.own)))
            limit, slack = self._limits(rows, largest)
            found = []
            for at in range(0, len(base), width):
                r, c = self._candidates(base[at : at + width], first + at, rows, None if right is None else right[:, at : at + width], limit, slack)
                found.append((r, c + at))
            r, c = (np.concatenate(f) for f in zip(*found, strict=True))
            for at in range(0, len(r), GATHERED):
                i, j = r[at : at + GATHERED], c[at : at + GATHERED]
                self._merge(i, base["id"][j], _exact_of(self.own["x"][i], base["x"][j]))

    def _merge(self, r: np.ndarray, j: np.ndarray, d2: np.ndarray) -> None:
        in_reach = d2 <= self.d2[r, -1]
        r, j, d2 = r[in_reach], j[in_reach], d2[in_reach]
        rows = np.unique(r)
        r, j, d2 = np.concatenate([np.repeat(rows, self.k), r]), np.concatenate([self.j[rows].ravel(), j]), np.concatenate([self.d2[rows].ravel(), d2])
        order = np.lexsort((j, d2, r))
        starts = np.searchsorted(r[order], rows)
        best = order[(starts[:, None] + np.arange(self.k)[None, :])]
        self.j[rows], self.d2[rows] = j[best], d2[best]

    @property
    def reach(self) -> float:
        return float(self.d2[:, -1].max())


def _sparse(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of few true ones: by words of eight, where rows are words."""
    width = kept.shape[1]
    if width % 8:
        return np.nonzero(kept)
    words = np.flatnonzero(kept.reshape(-1).view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)[None, :]).ravel()
    return np.divmod(at[kept.reshape(-1)[at]], width)


def _runs(points: Points, each):
    """A task: ``each(file, own points, place of the first)`` of its chunks."""

    def scan(batches):
        file = None
        for batch in batches:
            for first, count in zip(batch.column("first").to_pylist(), batch.column("count").to_pylist(), strict=True):
                file = file or _File(points)
                yield from each(file, file.read(first, count), first)

    return scan


def _dealt(spark: SparkSession, points: Points, each, schema: str) -> DataFrame:
    tasks = 8 * spark.sparkContext.defaultParallelism
    size = max(32, min(CHUNKS[0 if points.low else 1], ceil(points.n / tasks)))
    chunks = ceil(points.n / size)
    # a task that reads all blocks is long enough for one chunk, and no core waits for the last few; boxes are made once a task
    places = spark.range(0, chunks, 1, min(chunks, tasks if points.low else 64 * tasks)).select((F.col("id") * size).alias("first"), F.lit(size).cast("long").alias("count"))
    return places.mapInArrow(_runs(points, each), schema)


def nearest(spark: SparkSession, points: Points, k: int) -> DataFrame:
    """(i, j, d2) of every point's k nearest others; ties go to the smaller id."""

    def each(file, own, first):
        found = _Nearest(points, own, first, k)
        for block, least in file.order(own["x"], first):
            if least > found.reach:
                break
            found.meet(file.read(block * file.size, file.size), block * file.size)
        i, j, d2 = np.repeat(own["id"], k), found.j.ravel(), found.d2.ravel()
        there = np.isfinite(d2)
        yield pa.RecordBatch.from_arrays([pa.array(i[there]), pa.array(j[there]), pa.array(d2[there])], names=["i", "j", "d2"])

    return _dealt(spark, points, each, "i long, j long, d2 double")


def pairs(spark: SparkSession, points: Points, squared: float | None) -> DataFrame:
    """(i, j, d2) of all pairs, or those whose squared distance is at most ``squared``. A narrow step, a few rows of points at a time."""
    limit = np.inf if squared is None else squared

    def each(file, own, first):
        for block, least in file.order(own["x"], first):
            if least > limit:
                break
            base = file.read(block * file.size, file.size)
            step = max(1, (1 << 17) // len(base))
            for begin in range(0, len(own), step):
                part = own[begin : begin + step]
                d2 = _exact(part["x"], base["x"])
                keep = d2 <= limit
                keep[_same(points, part, first + begin, base, block * file.size)] = False
                r, c = np.nonzero(keep)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(part["id"][r]), pa.array(base["id"][c]), pa.array(d2[r, c])], names=["i", "j", "d2"])

    return _dealt(spark, points, each, "i long, j long, d2 double")


SUMS = "i long, n long, sum_j long, sum_w double, sum_wj double, min_w double, max_w double"


def _product(points: Points, a: np.ndarray, b: np.ndarray, squared: float) -> np.ndarray:
    """Squared distances by a matrix product; those that cancellation harms, and those close to the threshold, are taken anew."""
    x, y = a - points.centre, b - points.centre
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    d2 = (-2 * x) @ y.T
    d2 += nx[:, None]
    d2 += ny[None, :]
    doubt = d2 < 1e-2 * (nx[:, None] + ny.max())
    if np.isfinite(squared):
        doubt |= np.abs(d2 - squared) <= 1e-9 * (nx[:, None] + ny.max())
    r, c = _sparse(doubt)
    if len(r) * 8 > d2.size:
        return _exact(a, b)
    d2[r, c] = _exact_of(a[r], b[c])
    return d2


def row_sums(spark: SparkSession, points: Points, squared: float | None, weight) -> DataFrame:
    """Of every point, over the others in reach: their number, the sum of their ids, of ``weight(d2)`` and of weight times id, and the least
    and largest weight. Points without any have n = 0, and no least and largest. The pairs themselves never leave the task."""
    limit = np.inf if squared is None else squared

    def each(file, own, first):
        n, sum_j = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        sum_w, sum_wj, low, high = np.zeros(len(own)), np.zeros(len(own)), np.full(len(own), np.inf), np.full(len(own), -np.inf)
        for block, least in file.order(own["x"], first):
            if least > limit:
                break
            base = file.read(block * file.size, file.size)
            ids = base["id"]
            parts = np.stack([np.ones(len(ids)), (ids & ((1 << ID_BITS) - 1)).astype(np.float64), (ids >> ID_BITS).astype(np.float64)], axis=1)
            step = max(1, WEIGHED[0 if points.low else 1] // len(base))
            for begin in range(0, len(own), step):
                rows = slice(begin, min(begin + step, len(own)))
                part = own[rows]
                d2 = _exact(part["x"], base["x"]) if points.low else _product(points, part["x"], base["x"], limit)
                same = _same(points, part, first + begin, base, block * file.size)
                w = weight(d2)
                if squared is None:
                    out, gone = same, np.zeros((len(part), 3))
                    np.add.at(gone, same[0], parts[same[1]])
                    counts = (parts.sum(0) - gone).astype(np.int64)
                else:
                    keep = d2 <= limit
                    keep[same] = False
                    out = ~keep
                    counts = (keep.astype(np.float64) @ parts).astype(np.int64)
                w[out] = 0.0
                n[rows] += counts[:, 0]
                sum_j[rows] += counts[:, 1] + (counts[:, 2] << ID_BITS)
                sum_w[rows] += w.sum(1)
                sum_wj[rows] += w @ ids.astype(np.float64)
                high[rows] = np.maximum(high[rows], np.where(counts[:, 0] > 0, w.max(1), -np.inf))
                w[out] = np.inf
                low[rows] = np.minimum(low[rows], w.min(1))
        some = n > 0
        columns = [own["id"], n, sum_j, sum_w, sum_wj]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(low, mask=~some), pa.array(high, mask=~some)], names=["i", "n", "sum_j", "sum_w", "sum_wj", "min_w", "max_w"])

    return _dealt(spark, points, each, SUMS)
