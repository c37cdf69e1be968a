"""Exact substring deduplication by classes of equal substrings.

The corpus order is (doc_id, byte offset), nulls first. A start whose next ``length`` bytes also start earlier has a
longest previous factor of at least ``length``; every byte that such a string covers is removed, so the first copy stays.

A whole suffix array of the corpus can't be held in a task. Suffixes are therefore first dealt by content: the smallest
hash of the ``SEED`` byte strings within the next ``length`` bytes (a minimiser) names the bucket, and equal strings have equal
minimisers. Starts that follow one another with the same minimiser form a block. Blocks whose whole content occurs earlier are
later copies; blocks that alone have their minimiser can't repeat; only the rest are compared. There suffixes
are grouped by the names of their ``length``-byte prefixes (nested doubling hashes, as in Karp, Miller and Rosenberg's naming), and a start
has an earlier match exactly where its class's smallest position is smaller. So the operator runs hash classes with class minima, no
suffix order and no factor lengths; ``suffix_array``, ``smaller_neighbours`` and ``longest_previous_factors`` give those for one text and are
not on its path. Batches keep the smallest position of a string before the shuffle, so a hot string adds one record a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatlas.llm.common import BYTE_NAMES, CHUNK, U64, Packer, mix, n_buckets, pack, row_uid, text_chunks, unpack, unpack_one
from spatlas.storage import stored

SEED = 32  # bytes of a seed string; a power of two
BLOCK = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("uid", "<u4"), ("start", "<u4"), ("count", "u1"), ("loops", "u1"), ("hot", "u1")])
SUFFIX = np.dtype([("name", "<u8"), ("anchor", "<u8"), ("doc", "<i8"), ("uid", "<u4"), ("start", "<u4")])
MARK = np.dtype([("start", "<u4"), ("count", "<u4"), ("kind", "u1")])
#: REPEAT: all these starts have earlier matches. GROW: their block goes to the suffix array of its minimiser. SPREAD: each
#: of them goes to that of its own string, as the minimiser is in too many different blocks for one task.
REPEAT, GROW, SPREAD = 0, 1, 2
#: Different blocks of a minimiser in one batch, and in all, from which it is spread.
BATCH_HOT, HOT = 4, 512
NULL_DOC = np.iinfo(np.int64).min
MARKS = "doc_id long, uid long, marks binary, grow boolean"
BOTH = f"{MARKS}, bucket long, blob binary"


# ---------------------------------------------------------------- longest previous factors
def suffix_array(text: bytes) -> np.ndarray:
    """Suffix array by prefix doubling."""
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - step)] = rank[step:] if step < n else []
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1:
            break
    return order


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a sequence of distinct positions, the places of the previous and next smaller one (-1: none)."""
    n = len(order)
    before, after, stack = np.full(n, -1), np.full(n, -1), []
    for i in range(n):
        while stack and order[stack[-1]] > order[i]:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else -1
        stack.append(i)
    return before, after


def longest_previous_factors(text: bytes) -> np.ndarray:
    """For each position the length of the longest string there that also starts earlier (overlaps count)."""
    order = suffix_array(text)
    before, after = smaller_neighbours(order)
    out = np.zeros(len(text), np.int64)
    for place, i in enumerate(order):
        for other in (before[place], after[place]):
            if other >= 0:
                j, m = int(order[other]), int(out[i])
                while i + m < len(text) and text[i : i + m + 1] == text[j : j + m + 1]:
                    m += 1
                out[i] = max(out[i], m)
    return out


def has_earlier(classes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Given suffixes in suffix order with their class of equal prefixes, which have a smaller position in their class.

    Only factors of the full prefix length count, so the previous or next smaller position is one of the same class exactly
    where the class's smallest position is smaller: that position bounds both searches. Equal positions (repeated rows) are not earlier."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, bool)
    heads = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
    run = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, n]))
    least = np.minimum.reduceat(doc, heads)[run]
    where = np.where(doc == least, start, np.iinfo(np.int64).max)
    return (doc > least) | (start > np.minimum.reduceat(where, heads)[run])


def _classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


# ---------------------------------------------------------------- names of strings
def _seed_names(data: np.ndarray) -> np.ndarray:
    h, size = BYTE_NAMES[data], 1
    while size < SEED:
        n = len(h) - size
        if n <= 0:
            return np.zeros(0, U64)
        x = h[:n] * U64(0x9DDFEA08EB382D69)
        x += h[size:] ^ (h[size:] >> U64(17))
        x ^= x >> U64(30)
        x *= U64(0xD1B54A32D192ED03 + 2 * size)
        h, size = x, 2 * size
    return h ^ (h >> U64(32))


def _string_names(seeds: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """Names of the ``length`` bytes at ``starts``, from the seeds that cover them."""
    h = np.zeros(len(starts), U64)
    for at in [*range(0, length - SEED, SEED), length - SEED]:
        h = (h + seeds[starts + at]) * U64(0xC2B2AE3D27D4EB4F)
        h ^= h >> U64(29)
    return mix(h)


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, h
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def _segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1): whole texts, or overlapping parts of one long text."""
    if len(offsets) > 2 or offsets[-1] <= 2 * CHUNK:
        yield 0, len(offsets) - 1, 0, int(offsets[-1])
        return
    for a in range(0, int(offsets[-1]) - length + 1, CHUNK):
        yield 0, 1, a, min(int(offsets[-1]), a + CHUNK + length - 1)


def _blocks(data: np.ndarray, offsets: np.ndarray, length: int, base: int) -> np.ndarray:
    """Blocks of a segment as BLOCK records (doc: row number here)."""
    seeds = _seed_names(data)
    width = length - SEED + 1
    if len(seeds) < width:
        return np.zeros(0, BLOCK)
    least = _window_min(seeds, width)
    n = len(least)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    fits = np.arange(n) + length <= offsets[1:][row]
    new = np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])]
    heads = np.flatnonzero(new)
    number = np.arange(n) - np.repeat(heads, np.diff(np.r_[heads, n]))
    new |= number % width == 0  # a longer run of one minimiser is cut, so that its two outer strings cover it
    heads = np.flatnonzero(new & fits)
    ends = np.maximum.reduceat(np.where(fits, np.arange(n), -1), np.flatnonzero(new)) if len(heads) else heads
    ends = ends[fits[np.flatnonzero(new)]] if len(heads) else heads
    out = np.zeros(len(heads), BLOCK)
    out["anchor"], out["count"], out["doc"] = least[heads], ends - heads + 1, row[heads]
    first, last = _string_names(seeds, length, heads), _string_names(seeds, length, ends)
    out["content"] = mix(first ^ (last * U64(3)) ^ (out["count"].astype(U64) << U64(50)))
    # a minimiser that comes twice in a short span may repeat strings within one block
    pad = np.zeros(width - 1, U64)
    held = np.flatnonzero(seeds[: n + width - 1] == ~_window_min(~np.concatenate([pad, least, pad]), width))
    twice = (seeds[held][1:] == seeds[held][:-1]) & (np.diff(held) < width)
    out["loops"] = np.isin(out["anchor"], seeds[held][1:][twice])
    out["start"] = heads + base - offsets[row[heads]]
    return out


def _each_segment(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    docs = batch.column("doc_id").fill_null(NULL_DOC).to_numpy(zero_copy_only=False)
    uids = batch.column("uid").to_numpy(zero_copy_only=False)
    for i, j, data, offsets in text_chunks(batch.column("text")):
        for r, s, a, b in _segments(offsets, length):
            yield docs[i + r : i + s], uids[i + r : i + s], data[a:b], offsets if a == 0 and b == offsets[-1] else np.array([0, b - a]), a, i


NAMES = ["doc_id", "uid", "marks", "grow", "bucket", "blob"]


def _marks_rows(x: np.ndarray, marks: np.ndarray, bucket: int | None = None) -> pa.RecordBatch:
    """One row a document with its packed marks; repeats that follow one another are joined."""
    order = np.lexsort((marks["start"], marks["kind"], x["uid"], x["doc"]))
    doc, uid, marks = x["doc"][order], x["uid"][order].astype(np.int64), marks[order]
    other = (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1]) if len(doc) else np.zeros(0, bool)
    if len(doc):
        end = marks["start"] + marks["count"]
        run = np.flatnonzero(np.r_[True, other | (marks["kind"][1:] != REPEAT) | (marks["kind"][:-1] != REPEAT) | (marks["start"][1:] != end[:-1])])
        tail = np.r_[run[1:], len(doc)] - 1
        joined = marks[run]
        joined["count"] = end[tail] - joined["start"]
        doc, uid, marks = doc[run], uid[run], joined
    heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1])]) if len(doc) else np.zeros(0, int)
    blobs = [marks[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(doc)][: len(heads)], strict=True)]
    grow = np.maximum.reduceat(marks["kind"], heads) > REPEAT if len(doc) else heads.astype(bool)
    columns = [pa.array(doc[heads]), pa.array(uid[heads]), pa.array(blobs, pa.binary()), pa.array(grow)]
    if bucket is not None:  # rows that pass by the reducers are dealt over them evenly
        columns += [pa.array((doc[heads] + bucket) % bucket), pa.nulls(len(heads), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=NAMES[: len(columns)])


def _packed(rows) -> pa.RecordBatch:
    rows = list(rows)
    none = pa.nulls(len(rows), pa.int64())
    columns = [none, none, pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.bool_()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def _marks_in(blobs) -> np.ndarray:
    parts = [np.frombuffer(b, MARK) for b in blobs or [] if b]
    return np.concatenate(parts) if parts else np.zeros(0, MARK)


def _parted(table: pa.Table, solve) -> pa.Table:
    """A reducer's rows: marks pass as they are, blobs are solved together."""
    mask = pa.compute.is_valid(table.column("blob"))
    rest = table.filter(pa.compute.invert(mask)).select(NAMES[:4])
    return pa.concat_tables([rest, pa.Table.from_batches([solve(table.filter(mask).column("blob").to_pylist())])])


def _as_marks(records: np.ndarray, kind) -> np.ndarray:
    out = np.zeros(len(records), MARK)
    out["start"], out["kind"] = records["start"], kind
    out["count"] = records["count"] if "count" in records.dtype.names else 1
    return out


def _sift(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in order of anchor and content, which of them are later copies, and how many contents their anchor has."""
    order, content = _classes(x["anchor"], x["content"])
    x = x[order]
    later = has_earlier(content, x["doc"], x["start"])
    if not len(x):
        return x, later, np.zeros(0, np.int64)
    heads = np.flatnonzero(np.r_[True, x["anchor"][1:] != x["anchor"][:-1]])
    tails = np.r_[heads[1:], len(x)]
    return x, later, np.repeat(content[tails - 1] - content[heads] + 1, tails - heads)


def _scan(length: int, buckets: int):
    def scan(batches):
        packer, direct = Packer(BLOCK, buckets), []

        def sift(x):
            x, later, contents = _sift(x)
            direct.append((x[later], REPEAT))
            x, contents = x[~later], contents[~later]
            hot = contents > BATCH_HOT
            direct.append((x[hot], SPREAD))
            x["hot"] = hot
            change = x["anchor"][1:] != x["anchor"][:-1]  # one record tells the others that an anchor is hot
            return x[~hot | np.r_[True, change]] if len(x) else x

        def flush():
            yield _packed(packer.rows("anchor", sift))
            for x, kind in direct:
                if len(x):
                    yield _marks_rows(x, _as_marks(x, kind), buckets)
            direct.clear()

        for batch in batches:
            for docs, uids, data, offsets, base, _ in _each_segment(batch, length):
                x = _blocks(data, offsets, length, base)
                x["uid"], x["doc"] = uids[x["doc"]], docs[x["doc"]]
                if packer.add(x):
                    yield from flush()
        yield from flush()

    return scan


def _judge(blobs) -> pa.RecordBatch:
    x, later, contents = _sift(unpack(blobs, BLOCK))
    if len(x):
        heads = np.flatnonzero(np.r_[True, x["anchor"][1:] != x["anchor"][:-1]])
        hot = np.repeat(np.maximum.reduceat(x["hot"], heads), np.diff(np.r_[heads, len(x)])).astype(bool) | (contents > HOT)
    else:
        hot = later
    kinds = np.where(later, REPEAT, np.where(hot, SPREAD, GROW))
    keep = later | hot | (contents > 1) | (x["loops"] > 0)
    return _marks_rows(x[keep], _as_marks(x, kinds)[keep])


def _grown(length: int, buckets: int):
    """Blocks that may hold matches with other blocks: their bytes by minimiser, or their single suffixes by string."""

    def grown(batches):
        packer, direct, blocks, texts, size = Packer(SUFFIX, buckets), [], [], [], 0

        def lpf(x):
            x, later, classes = _matched(x)
            direct.append(x[later])
            x, classes = x[~later], classes[~later]
            return x[np.r_[True, classes[1:] != classes[:-1]]] if len(x) else x

        def flush():
            nonlocal size
            yield _packed(packer.rows("name", lpf))
            for x in direct:
                if len(x):
                    yield _marks_rows(x, _as_marks(x, REPEAT), buckets)
            if blocks:
                yield _packed(_bytes_by_anchor(np.concatenate(blocks), b"".join(texts), length, buckets))
            for x in (direct, blocks, texts):
                x.clear()
            size = 0

        for batch in batches:
            lists = batch.column("marks").to_pylist()
            for docs, uids, data, offsets, base, first in _each_segment(batch, length):
                parts = [_marks_in(lists[first + r]) for r in range(len(docs))]
                row = np.repeat(np.arange(len(docs)), [len(p) for p in parts])
                marks = np.concatenate(parts)
                at = marks["start"].astype(np.int64) + offsets[row] - base
                mine = (marks["kind"] > REPEAT) & (at >= offsets[row]) & (at + length <= offsets[row + 1])
                row, marks, at = row[mine], marks[mine], at[mine]
                if not len(marks):
                    continue
                seeds = _seed_names(data)
                grow = marks["kind"] == GROW
                if grow.any():
                    x = np.zeros(int(grow.sum()), BLOCK)
                    x["doc"], x["uid"], x["start"], x["count"] = docs[row[grow]], uids[row[grow]], marks["start"][grow], marks["count"][grow]
                    x["anchor"] = [int(seeds[a : a + length - SEED + 1].min()) for a in at[grow]]
                    blocks.append(x)
                    texts.append(b"".join(data[a : a + c + length - 1].tobytes() for a, c in zip(at[grow], x["count"].astype(int), strict=True)))
                    size += len(texts[-1])
                count = marks["count"][~grow].astype(np.int64)
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row, where = np.repeat(row[~grow], count), np.repeat(at[~grow], count) + within
                x = _suffix_records(seeds, length, where)
                x["doc"], x["uid"], x["start"] = docs[row], uids[row], where - offsets[row] + base
                if packer.add(x) or size > 16 << 20:
                    yield from flush()
        yield from flush()

    return grown


def _bytes_by_anchor(x: np.ndarray, text: bytes, length: int, buckets: int):
    sizes = x["count"].astype(np.int64) + length - 1
    at = np.cumsum(sizes) - sizes
    bucket = ((x["anchor"] >> U64(20)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1), len(x)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = order[a:b]
        yield int(bucket[own[0]]), pack(x[own], b"".join(text[at[k] : at[k] + sizes[k]] for k in own))


def _suffix_records(seeds: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    x = np.zeros(len(at), SUFFIX)
    x["name"] = _string_names(seeds, length, at)
    x["anchor"] = seeds[at] ^ (seeds[at + length - SEED] * U64(0x9E3779B97F4A7C15)) if len(at) else 0
    return x


def _matched(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix records in suffix order, which of them have a longest previous factor of full length, and their classes."""
    order, classes = _classes(x["anchor"], x["name"])
    x = x[order]
    return x, has_earlier(classes, x["doc"], x["start"]), classes


def _suffixes(length: int):
    def suffixes(blobs) -> pa.RecordBatch:
        parts = []
        for blob in blobs:
            if blob[8] == SUFFIX.itemsize:
                parts.append(unpack_one(blob, SUFFIX)[0])
                continue
            x, text = unpack_one(blob, BLOCK)  # blocks come with their text
            count = x["count"].astype(np.int64)
            sizes = count + length - 1
            begin = np.cumsum(sizes) - sizes
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner = np.repeat(np.arange(len(x)), count)
            y = _suffix_records(_seed_names(np.frombuffer(text, np.uint8)), length, begin[owner] + within)
            y["doc"], y["uid"], y["start"] = x["doc"][owner], x["uid"][owner], x["start"][owner] + within
            parts.append(y)
        x, later, _ = _matched(np.concatenate(parts) if parts else np.zeros(0, SUFFIX))
        return _marks_rows(x[later], _as_marks(x[later], REPEAT))

    return suffixes


def _kept(length: int):
    def kept(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            n_bytes, n_removed, n_spans, digests, rest, spans = [], [], [], [], [], []
            for text, blobs in zip(texts, batch.column("marks"), strict=True):
                data = text.as_py()
                m = _marks_in(blobs.as_py())
                m = m[m["kind"] == REPEAT]
                a, b = _union(m["start"].astype(np.int64), m["start"].astype(np.int64) + m["count"] + length - 1)
                left = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True)) if len(a) else data
                n_bytes.append(len(data))
                n_removed.append(int((b - a).sum()))
                n_spans.append(len(a))
                digests.append(hashlib.sha256(left).hexdigest())
                rest.append(left)
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests), pa.array(rest, pa.binary()), pa.array(spans, span)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )

    return kept


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open ranges; ranges that touch are one run."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[new[1:], True]]


def suffix_dedup(documents: DataFrame, length: int = 100) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans.

    A null text is empty. A null doc_id comes before all others. Rows that share a doc_id share its place in the order, so
    equal strings at the same offset of both are not earlier than one another; repeated rows get equal results. Texts shorter
    than ``length`` stay whole. Other columns, whatever their names, are not read. An empty table gives an empty result."""
    if length < 2 * SEED:
        raise ValueError(f"length must be at least {2 * SEED}")
    # blocks and suffixes that are compared come with about as many bytes as the texts have
    buckets = n_buckets(documents.sparkSession, documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    docs = documents.select(F.col("doc_id").cast("long"), "text", row_uid().bitwiseAND(F.lit(0xFFFFFFFF)).alias("uid"))
    named = docs.select(F.coalesce("doc_id", F.lit(NULL_DOC)).alias("d"), "uid", "doc_id", "text")

    def solved(rows: DataFrame, solve) -> DataFrame:
        return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda table: _parted(table, solve), MARKS)

    def joined(marks: DataFrame, how: str) -> DataFrame:
        by_doc = marks.groupBy(F.col("doc_id").alias("d"), "uid").agg(F.collect_list("marks").alias("marks"))
        return named.join(by_doc, ["d", "uid"], how).select("doc_id", "uid", "text", "marks")

    marks = stored(solved(docs.mapInArrow(_scan(length, buckets), BOTH), _judge), "lpf-marks")
    found = solved(joined(marks.where("grow"), "inner").mapInArrow(_grown(length, buckets), BOTH), _suffixes(length))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"
    return joined(marks.union(found), "left").mapInArrow(_kept(length), schema)
