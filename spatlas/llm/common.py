"""Shared pieces: row identities, NumPy word hashing, packed buckets and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.storage import discard, stored

U64 = np.uint64
#: Bytes of text that one NumPy pass works on; bounds a Python worker's memory at about 40 times this.
CHUNK = 2 << 20


def row_uid(text: str = "text") -> Column:
    """Identity of a row's content beside its ``doc_id``: equal for repeated rows, defined for null texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


#: Bytes of packed records that a bucket has at most, if keys are spread evenly.
BUCKET_BYTES = 64 << 20


def n_buckets(spark: SparkSession, size: int) -> int:
    """Buckets for so many bytes of records: as the data grow there are more, not larger ones, and a task takes one or a few of them."""
    return max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


# ---------------------------------------------------------------- Arrow text
def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (or one row): (first, last + 1, bytes, offsets from 0). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# ---------------------------------------------------------------- hashing
def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


BYTE_NAMES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_NAMES = BYTE_NAMES[_LOWER]
BASE = 0xA24BAED4963EE407
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, CHUNK + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(n, base, U64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, names: np.ndarray = LOWER_NAMES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of several texts, and where each text's words begin (len(offsets) entries).

    ``is_word`` says for each byte value if words hold it, ``names`` has a number for it. A text longer than a chunk is cut between words."""
    pieces, counts = [], []
    total = len(data)
    if total <= 2 * CHUNK:
        return _words(data, offsets, is_word, names)
    assert len(offsets) == 2, "a run of several texts is at most a chunk"
    at = 0
    while at < total:
        end = min(total, at + CHUNK)
        while end < total and is_word[data[end - 1]] and is_word[data[end]]:  # not within a word
            gap = np.flatnonzero(~is_word[data[end : end + CHUNK]])
            end = end + int(gap[0]) if len(gap) else min(total, end + CHUNK)
        hashes, _ = _words(data[at:end], np.array([0, end - at]), is_word, names)
        pieces.append(hashes)
        counts.append(len(hashes))
        at = end
    return np.concatenate(pieces), np.array([0, sum(counts)])


def _words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _pow(n)
    sums = np.cumsum(names[data] * up[:n])
    h = sums[stops]
    before = starts > 0
    h[before] -= sums[starts[before] - 1]
    h *= down[starts]
    return mix(h ^ ((stops - starts).astype(U64) * U64(0xFF51AFD7ED558CCD))), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, U64(0x1000193 * k))
    for j in range(k):
        h = (h + words[j : j + n]) * U64(0xC2B2AE3D27D4EB4F)
        h ^= h >> U64(33)
    return mix(h)


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


# ---------------------------------------------------------------- packed buckets
class Packer:
    """Gathers fixed-size records by bucket of a key hash; gives (bucket, blob) rows once enough are pending."""

    def __init__(self, dtype: np.dtype, buckets: int, limit: int = 24 << 20):
        self.dtype, self.buckets, self.limit = np.dtype(dtype), buckets, limit
        self.pending: list[np.ndarray] = []
        self.size = 0

    def add(self, records: np.ndarray) -> bool:
        if len(records):
            self.pending.append(records)
            self.size += records.nbytes
        return self.size >= self.limit

    def rows(self, key: str, reduce=None) -> Iterator[tuple[int, bytes]]:
        if not self.pending:
            return
        records = np.concatenate(self.pending)
        self.pending, self.size = [], 0
        if reduce is not None:
            records = reduce(records)
        bucket = ((records[key] >> U64(20)) % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        records, bucket = records[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(records)], strict=True):
            yield int(bucket[a]), pack(records[a:b])


_zstd = pa.Codec("zstd", compression_level=1)


def pack(records: np.ndarray, extra: bytes = b"") -> bytes:
    """Records column by column, then ``extra`` bytes, compressed."""
    data = b"".join([np.int64([len(records), len(extra)]).tobytes(), *(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names), extra])
    return len(data).to_bytes(8, "little") + bytes([records.dtype.itemsize]) + _zstd.compress(data, asbytes=True)


def unpack_one(blob: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    data = _zstd.decompress(blob[9:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, extra = np.frombuffer(data, np.int64, 2)
    out, at = np.zeros(int(n), dtype), 16
    for f in out.dtype.names:
        width = out.dtype[f].itemsize * int(n)
        out[f] = np.frombuffer(data[at : at + width], out.dtype[f])
        at += width
    return out, data[at : at + int(extra)]


def unpack(blobs, dtype) -> np.ndarray:
    parts = [unpack_one(b, dtype)[0] for b in blobs if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b long): component is the smallest node reachable.

    Labels flow along edges and are then looked up at their own node, so long chains shrink fast. Each round is
    stored. Sums by node are combined before the shuffle; a hot node's join is left to AQE's skew handling."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    labels = last = stored(labels, f"{name}-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        step = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "seen").alias("to"))
        jump = step.join(labels.select(F.col("node").alias("to"), F.col("component").alias("far")), "to", "left")
        new = stored(jump.select("node", "old", F.least("to", F.coalesce("far", "to")).alias("component")), f"{name}-labels")
        discard(last)
        labels, last = new.select("node", "component"), new
        if not new.where("component <> old").limit(1).count():
            discard(both)
            return labels
