"""Exact n-gram Jaccard join with token-combination prefixes.

Each text is its set of distinct word shingles; equal sets are one node. Tokens are ordered by frequency class, rare first,
then by hash. Two sets of the wanted similarity share a token of their prefixes of n - ceil(t n) + 1 tokens, and k tokens of the prefixes
that are k - 1 tokens longer. If the first shared token is of a rare class, it is indexed alone. Otherwise all shared tokens are of frequent
classes, and of these combinations of two are indexed: the prefix is extended until B + 1 tokens must be shared, tokens are dealt by hash over B
blocks, and two of the shared ones fall into one block, so only combinations within a block are needed. B grows with the set,
which keeps them about as many as tokens; a set is indexed for the B of every size that a partner can have. Frequency
classes come from counts of all tokens in a table of fixed size; collisions there change the order alike for every set, hence cost, never results.

Nodes with a signature in common are candidates. As only connected components are asked for, a first round verifies each
signature's nodes against one of them; a second verifies each node's likeliest partner in another component, and a third all
pairs that are left between components. A signature's nodes are compared in pairs of blocks of bounded size. Whole sets are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.llm.common import U64, Packer, components, gram_hashes, mix, n_buckets, row_uid, signed, text_chunks, unpack, words_of
from spatlas.storage import stored

IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False
#: Cells of the frequency table: 2 ** CELL_BITS of two bytes. Fixed, so it can be broadcast.
CELL_BITS, CHUNK_BITS = 22, 16
NEED_BITS = 25
#: Nodes of a signature, and bytes of their parity bits, that are compared with as many others in one task.
BLOCK_NODES, BLOCK_BYTES = 4096, 16 << 20
#: A node's smallest groups that are known wherever it is compared.
LOW = 16
#: Pairs that one verifying task compares with one set.
SALT_EVERY = 1000
SCANNED = ["doc_id", "uid", "node", "n", "bits", "part", "blob"]
TOKEN = np.dtype([("sig", "<u8"), ("node", "<u8"), ("n", "<u4")])


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text. Fewer words than ``width`` are one shingle; none give an empty set."""
    for i, j, data, offsets in text_chunks(column):
        words, begin = words_of(data, offsets, IS_WORD)
        grams = gram_hashes(words, width)
        for r in range(j - i):
            a, b = int(begin[r]), int(begin[r + 1])
            if b - a < width:
                yield i + r, gram_hashes(words[a:b], b - a) if b > a else grams[:0]
            else:
                s = np.sort(grams[a : b - width + 1])
                yield i + r, s[np.r_[True, s[1:] != s[:-1]]]


def node_of(tokens: np.ndarray) -> int:
    """Identity of a set: 0 of the empty one."""
    if not len(tokens):
        return 0
    total = np.array([mix(tokens).sum() + U64(len(tokens))], U64)
    return int(mix(total ^ np.bitwise_xor.reduce(mix(tokens + U64(0x51ED2701))))[0]) or 1


def parity_bits(tokens: np.ndarray) -> bytes:
    """For each of 2 to 4 cells a token, whether an odd number of tokens falls there. Cells in which two sets differ hold tokens that
    only one of them has, so their number never exceeds that of such tokens."""
    cells = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    counts = np.bincount((tokens & U64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differing_cells(a: bytes, b: bytes) -> int:
    """Of the finer table, cells a power of two apart are joined first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def least_shared(n, percent: int):
    """Tokens that a set of n shares at least with any set of the wanted similarity."""
    return (percent * n + 99) // 100


def _nodes(width: int):
    def scan(batches):
        counts, pending, size, seen = np.zeros(1 << CELL_BITS, np.int64), [], 0, set()
        for batch in batches:
            nodes, sizes, bits = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [None] * len(batch)
            for row, tokens in shingle_sets(batch.column("text"), width):
                node = node_of(tokens)
                nodes[row], sizes[row] = np.uint64(node).astype(np.int64), len(tokens)
                if node not in seen:  # of copies within a task, one counts
                    seen.add(node)
                    bits[row] = parity_bits(tokens)
                    pending.append((tokens >> U64(64 - CELL_BITS)).astype(np.int32))
                    size += len(tokens)
                if size > 4 << 20:
                    counts += np.bincount(np.concatenate(pending), minlength=1 << CELL_BITS)
                    pending, size = [], 0
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(nodes), pa.array(sizes), pa.array(bits, pa.binary()), none, pa.nulls(len(batch), pa.binary())], names=SCANNED)
        if pending:
            counts += np.bincount(np.concatenate(pending), minlength=1 << CELL_BITS)
        if counts.any():
            parts = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, 1 << CHUNK_BITS)
            none = pa.nulls(len(parts), pa.int64())
            blobs = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in parts]
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(blobs, pa.binary())], names=SCANNED)

    return scan


def _add_parts(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << CHUNK_BITS, np.uint32)
    for blob in table.column("blob").to_pylist():
        total += np.frombuffer(pa.decompress(blob, 2 << CHUNK_BITS, codec="zstd", asbytes=True), np.uint16)
    return pa.table({"part": table.column("part").slice(0, 1), "blob": pa.array([total.tobytes()], pa.binary())})


def _classes(parts: DataFrame) -> np.ndarray:
    """The frequency class of each cell: 0 up to twice the mean load, then one more with each doubling."""
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    for row in parts.groupBy("part").applyInArrow(_add_parts, "part int, blob binary").toLocalIterator():  # 2 ** 22 numbers in all
        counts[row.part << CHUNK_BITS : (row.part + 1) << CHUNK_BITS] = np.frombuffer(row.blob, np.uint32)
    usual = 2 * counts.mean() + 16
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for at in range(0, len(counts), 1 << CHUNK_BITS):  # a part at a time, as the driver's memory is small
        some = counts[at : at + (1 << CHUNK_BITS)].astype(np.float64)
        out[at : at + (1 << CHUNK_BITS)] = np.where(some <= usual, 0, np.floor(np.log2(np.maximum(some, usual) / usual)) + 1)
    return out


def blocks_of(n: int) -> int:
    """Blocks over which the frequent tokens of sets of n are dealt, a power of two."""
    return 1 << max(0, (n // 16).bit_length() - 1)


def _combined(often: np.ndarray, blocks: int) -> np.ndarray:
    """All combinations of two tokens of one block."""
    block = often & U64(blocks - 1)
    order = np.lexsort((often, block))
    often, block = often[order], block[order]
    parts = [often[:0]]
    for gap in range(1, len(often)):
        same = block[gap:] == block[:-gap]
        if not same.any():
            break
        parts.append(mix(often[:-gap][same] * U64(0x9DDFEA08EB382D69) + mix(often[gap:][same]) + U64(blocks)))
    return np.concatenate(parts)


def signatures(tokens: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    """What a set is indexed by: rare tokens of its prefix, and combinations of the frequent ones of its extended prefixes."""
    n = len(tokens)
    most, shared = 100 * n // percent, least_shared(n, percent)
    if most < 2:
        return tokens[:0]  # only an equal set could be similar
    level = cells[tokens >> U64(64 - CELL_BITS)]
    rare = level == 0
    if rare.sum() > n - shared:
        return tokens[rare][: n - shared + 1]
    order = np.lexsort((tokens, level))
    parts, blocks = [tokens[rare]], blocks_of(n)
    while blocks <= blocks_of(most):
        reach = order[: n - shared + blocks + 1]
        parts.append(_combined(tokens[reach][level[reach] > 0], blocks))
        blocks *= 2
    if shared < 2:  # a partner may share a single token
        parts.append(mix(tokens[~rare] ^ U64(0xA0761D6478BD642F)))
    return np.concatenate(parts)


def _index(width: int, percent: int, cells, buckets: int):
    def scan(batches):
        packer, seen = Packer(TOKEN, buckets), set()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*packer.rows("sig"), strict=True)) or [[], []], (pa.int64(), pa.binary()), strict=True)], names=["bucket", "blob"])
        for batch in batches:
            for _, tokens in shingle_sets(batch.column("text"), width):
                node = node_of(tokens)
                if node in seen:
                    continue
                seen.add(node)
                sigs = signatures(tokens, cells.value, percent)
                x = np.zeros(len(sigs), TOKEN)
                x["sig"], x["node"], x["n"] = sigs, node, len(tokens)
                if packer.add(x):
                    yield rows()
        yield rows()

    return scan


CANDIDATES = "a long, b long, grp long, node long, n long"


def _rows(a=(), b=(), grp=(), node=(), n=()) -> pa.Table:
    k = max(len(a), len(node))
    fill = lambda x: pa.array(signed(np.ascontiguousarray(x, U64))) if len(x) == k and k else pa.nulls(k, pa.int64())
    return pa.table({"a": fill(a), "b": fill(b), "grp": fill(grp), "node": fill(node), "n": fill(n)})


def _candidates(percent: int):
    def candidates(table: pa.Table) -> pa.Table:
        """Pairs with each signature's first node; the nodes of signatures with more than two, each such group once."""
        x = unpack(table.column("blob").to_pylist(), TOKEN)
        x = x[np.lexsort((x["node"], x["sig"]))]
        if len(x):
            x = x[np.r_[True, (x["sig"][1:] != x["sig"][:-1]) | (x["node"][1:] != x["node"][:-1])]]
        if not len(x):
            return _rows()
        heads = np.flatnonzero(np.r_[True, x["sig"][1:] != x["sig"][:-1]])
        sizes = np.diff(np.r_[heads, len(x)])
        several = np.repeat(sizes > 1, sizes)
        first = np.repeat(heads, sizes)
        others = several & (first != np.arange(len(x)))
        n, m = x["n"][others].astype(np.int64), x["n"][first[others]].astype(np.int64)
        fits = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
        pairs = np.unique(np.stack([x["node"][first[others]][fits], x["node"][others][fits]], 1), axis=0)
        large = np.repeat(sizes > 2, sizes)
        y = x[large]
        if not len(y):
            return _rows(pairs[:, 0], pairs[:, 1])
        heads = np.flatnonzero(np.r_[True, y["sig"][1:] != y["sig"][:-1]])
        sizes = np.diff(np.r_[heads, len(y)])
        name = mix(np.add.reduceat(mix(y["node"]), heads) + sizes.astype(U64))  # equal groups get equal names
        _, once = np.unique(name, return_index=True)
        keep = np.zeros(len(heads), bool)
        keep[once] = True
        keep, name = np.repeat(keep, sizes), np.repeat(name, sizes)
        return pa.concat_tables([_rows(pairs[:, 0], pairs[:, 1]), _rows(grp=name[keep], node=y["node"][keep], n=y["n"][keep])])

    return candidates


def _bit_rows(bits: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """Parity bits of rows that all have ``size`` bytes, as words."""
    _, offsets, data = bits.buffers()
    at = np.frombuffer(offsets, np.int32)[bits.offset :][rows]
    return np.frombuffer(data, np.uint8)[at[:, None] + np.arange(size)].view(U64)


def _halved(words: np.ndarray) -> np.ndarray:
    return words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]


def _nearest(pairs: np.ndarray, differ: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of candidate pairs (x, y), each x's with the fewest differing cells for its size."""
    order = np.lexsort((pairs[:, 1], differ / total, pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.r_[True, pairs[1:, 0] != pairs[:-1, 0]]]


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of at most LOW numbers as rows, filled up with the largest number."""
    offsets = lists.offsets.to_numpy()
    counts = np.diff(offsets)
    out = np.full((len(lists), LOW), np.iinfo(np.int64).max)
    row = np.repeat(np.arange(len(lists)), counts)
    out[row, np.arange(counts.sum()) - np.repeat(offsets[:-1] - offsets[0], counts)] = lists.flatten().to_numpy()
    return out


def _elsewhere(low: np.ndarray, p: np.ndarray, q: np.ndarray, grp: int) -> np.ndarray:
    """Which pairs of rows are surely together in a smaller group, too, where they are looked at instead."""
    out = np.zeros(len(p), bool)
    for k in range(LOW):
        own = low[p, k]
        out |= (own < grp) & (low[q] == own[:, None]).any(1)
    return out


def _group_pairs(node, n, comp, bits, sizes, low, grp: int, left, right, percent: int, nearest: bool) -> Iterator[np.ndarray]:
    """Pairs of a row of ``left`` and one of ``right`` (row numbers) in different components that neither sizes nor parity bits rule out; or the nearest
    such of each row that is compared. Near copies meet in many groups: a pair is left to the smallest, as far as both rows' smallest groups show.

    Rows of the largest component are only compared with the others. Sets that may be alike have tables of one size
    or sizes a factor of 2 apart, of which the finer is joined to the coarser."""
    both = left if left is right else np.concatenate([left, right])
    names, counts = np.unique(comp[both], return_counts=True)
    largest = names[counts.argmax()]
    yield from _few_pairs(node, n, comp, bits, sizes, low, grp, left[comp[left] != largest], right, percent, nearest)
    if left is not right:
        yield from _few_pairs(node, n, comp, bits, sizes, low, grp, right[comp[right] != largest], left, percent, nearest)


def _few_pairs(node, n, comp, bits, sizes, low, grp: int, few, rows, percent: int, nearest: bool) -> Iterator[np.ndarray]:
    for size in np.unique(sizes[few]):
        own = few[sizes[few] == size]
        words = _bit_rows(bits, own, int(size))
        for scale in (0.5, 1, 2):
            every = rows[sizes[rows] == size * scale]
            if not len(every) or size * scale < 8:
                continue
            other, mine = _bit_rows(bits, every, int(size * scale)), words
            if scale == 2:
                other = _halved(other)
            elif scale == 0.5:
                mine = _halved(words)
            step = max(1, (4 << 20) // max(1, other.nbytes))
            for i in range(0, len(own), step):
                left = own[i : i + step]
                a, b = n[left][:, None], n[every][None, :]
                keep = (comp[left][:, None] != comp[every][None, :]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                x, y = np.nonzero(keep)
                for k in range(0, len(x), 1 << 16):
                    p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    differ = np.bitwise_count(mine[i + p] ^ other[q]).sum(1, dtype=np.int64)
                    near = (100 + percent) * differ <= (100 - percent) * (n[left[p]] + n[every[q]])
                    p, q, differ = left[p[near]], every[q[near]], differ[near]
                    here = ~_elsewhere(low, p, q, grp)
                    if here.any():
                        p, q, differ = p[here], q[here], differ[here]
                        pairs = np.stack([node[p], node[q]], 1)
                        yield _nearest(pairs, differ, n[p] + n[q]) if nearest else pairs


def _across(percent: int, nearest: bool):
    def across(batches):
        """Of rows sorted by group and pair of blocks: pairs of nodes in different components that may have the similarity."""
        held = None

        def starts_of(table: pa.Table) -> np.ndarray:
            grp, x, y = (table.column(c).to_numpy() for c in ("grp", "x", "y"))
            return np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])

        def pairs_of(table: pa.Table) -> pa.RecordBatch:
            node, n, comp, own, x, y = (table.column(c).to_numpy() for c in ("node", "n", "comp", "own", "x", "y"))
            bits, low = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (table.column(k).combine_chunks() for k in ("bits", "low")))
            low, grp = _padded(low), table.column("grp").to_numpy()
            sizes = pa.compute.binary_length(bits).to_numpy(zero_copy_only=False)
            found, cuts = [], [*starts_of(table), table.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = np.arange(a, b)
                left, right = (rows, rows) if x[a] == y[a] else (rows[own[a:b] == x[a]], rows[own[a:b] == y[a]])
                if b - a > 1 and len(left) and len(right):
                    found += _group_pairs(node, n, comp, bits, sizes, low, int(grp[a]), left, right, percent, nearest)
            pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0) if found else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = int(starts_of(table)[-1])  # the last pair of blocks may go on in the next batch
            if last:
                yield pairs_of(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield pairs_of(held)

    return across


def _bits_of(batches):
    """The nodes' places in a table of bits, as (word, bits) rows."""
    for batch in batches:
        x = np.unique(mix(batch.column("node").to_numpy().view(U64)) >> U64(64 - NEED_BITS))
        word, bit = (x >> U64(5)).astype(np.int64), np.int64(1) << (x & U64(31)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array(word[heads]), pa.array(np.bitwise_or.reduceat(bit, heads) if len(heads) else bit)], names=["word", "bits"])


def node_filter(nodes: DataFrame) -> np.ndarray:
    """2 ** NEED_BITS bits, however many nodes; a node that isn't wanted may pass, one that is does."""
    bits = np.zeros(1 << (NEED_BITS - 5), np.uint32)
    words = nodes.select("node").mapInArrow(_bits_of, "word long, bits long").groupBy(F.expr("word div 4096").alias("part"))
    packed = words.applyInArrow(_or_words, "part long, blob binary")
    for row in packed.collect():  # 4 MB in all
        bits[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.blob, np.uint32)
    return bits


def _or_words(table: pa.Table) -> pa.Table:
    word, bits = table.column("word").to_numpy(), table.column("bits").to_numpy()
    out = np.zeros(4096, np.int64)
    np.bitwise_or.at(out, word % 4096, bits)
    return pa.table({"part": [int(word[0]) // 4096], "blob": pa.array([out.astype(np.uint32).tobytes()], pa.binary())})


def _sets(width: int, wanted):
    def scan(batches):
        seen = set()
        for batch in batches:
            nodes, blobs, size = [], [], 0
            for _, tokens in shingle_sets(batch.column("text"), width):
                node = node_of(tokens)
                at = int(mix(np.array([node], U64))[0] >> U64(64 - NEED_BITS))
                if node in seen or not wanted.value[at >> 5] >> (at & 31) & 1:
                    continue
                seen.add(node)
                nodes.append(np.uint64(node).astype(np.int64))
                # 48 bits tell the tokens of two sets apart
                blobs.append(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes())
                size += len(blobs[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["b", "tokens"])
                    nodes, blobs, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["b", "tokens"])

    return scan


def _tokens(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _verified(percent: int):
    def verified(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        seen, own, found = set(), None, []
        nodes, blobs = table.column("b").to_pylist(), table.column("tokens")
        own = next((_tokens(blobs[i].as_py()) for i, b in enumerate(nodes) if b == a), None)
        for i, b in enumerate(nodes):
            if b == a or b in seen:
                continue
            seen.add(b)
            other = _tokens(blobs[i].as_py())
            small, big = (own, other) if len(own) < len(other) else (other, own)
            at = np.minimum(np.searchsorted(big, small), len(big) - 1)
            shared = int((big[at] == small).sum())
            if 100 * shared >= percent * (len(own) + len(other) - shared):
                found.append(b)
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return verified


def _alike(percent: int):
    def alike(batches):
        """Pairs whose cells don't already show too many tokens that only one set has."""
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            # of n + m tokens, those in one set only are at most (100 - percent) / (100 + percent)
            keep = pa.array([(100 + percent) * differing_cells(a, b) <= (100 - percent) * (k + j) for a, b, k, j in zip(x, y, n, m, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return alike


def possible(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The pairs that their parity bits don't rule out; only bits are moved, not sets."""
    first, second = (cells.select(F.col("node").alias(k), F.col("bits").alias(v), F.col("n").alias(w)) for k, v, w in (("a", "x", "n"), ("b", "y", "m")))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_alike(percent), "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have the similarity. A node with many partners is dealt over several tasks."""
    spark = docs.sparkSession
    salts = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {SALT_EVERY}) as int)").alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.expr("pmod(xxhash64(b), salts)").alias("salt"))
    own = salts.select("a", F.col("a").alias("b"), F.explode(F.expr("sequence(0L, cast(salts - 1 as long))")).alias("salt"))
    ends = salted.union(own)
    wanted = spark.sparkContext.broadcast(node_filter(ends.select(F.col("b").alias("node"))))
    sets = docs.select("text").mapInArrow(_sets(width, wanted), "b long, tokens binary")
    found = stored(ends.join(sets, "b").groupBy("a", "salt").applyInArrow(_verified(percent), "a long, b long"), "join-links")
    wanted.destroy()
    return found


def ngram_join(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, uid, component.

    component_id is the smallest doc_id that links reach, itself included; a link holds two texts of which
    100 * shared >= percent * all shingles. Texts without words (null, empty, white space) link with nothing. Rows with equal
    sets are one node whatever their ids, so repeated rows share a component. A null doc_id is never a component's smallest unless
    the component has no other; then component_id is null. ``component`` names the component itself, 0 for texts without words.
    Other columns aren't read. An empty table gives an empty result. ``percent`` is from 50 to 100."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark: SparkSession = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text", row_uid().alias("uid"))
    scanned = stored(docs.mapInArrow(_nodes(width), "doc_id long, uid long, node long, n long, bits binary, part int, blob binary"), "join-nodes")
    nodes = scanned.where("part is null").select("doc_id", "uid", "node", F.col("n").alias("n_shingles"))
    parity = scanned.where("bits IS NOT NULL").groupBy("node").agg(F.first("bits").alias("bits"), F.first("n").alias("n"))
    cells = spark.sparkContext.broadcast(_classes(scanned.where("part is not null").select("part", "blob")))
    # a set has about as many signatures as tokens
    tokens = scanned.where("bits IS NOT NULL").agg(F.sum("n")).first()[0] or 0
    buckets = n_buckets(spark, TOKEN.itemsize * tokens)
    index = docs.select("text").mapInArrow(_index(width, percent, cells, buckets), "bucket long, blob binary").repartition(buckets, "bucket")
    found = stored(index.groupBy("bucket").applyInArrow(_candidates(percent), CANDIDATES), "join-candidates")
    cells.destroy()
    pairs = stored(found.where("a is not null").select("a", "b").distinct(), "join-pairs")
    likely = stored(possible(pairs, parity, percent), "join-likely")
    links = verify(docs, likely, width, percent)
    groups = stored(found.where("grp is not null").select("grp", "node", "n").distinct(), "join-groups")
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # at first only each node's nearest of another component: what is alike is then mostly joined, and few pairs are left for the last round
    labels = components(links, "join-components")
    for nearest in (True, False):
        labelled = groups.join(labels, "node", "left").select("grp", "node", "n", F.coalesce("component", "node").alias("comp"))
        # parity bits have half a byte a token at most
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / (2 * BLOCK_BYTES))).cast("int").alias("blocks")
        split = labelled.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), blocks).where("x <> y").select("grp", "blocks")
        mixed = stored(labelled.join(split, "grp").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) AS int)")), "join-mixed")
        dealt = mixed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
        lowest = mixed.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("grp")), 1, LOW).alias("low"))
        placed = dealt.join(parity.select("node", "bits").join(lowest, "node"), "node").select("grp", "x", "y", "own", "node", "n", "comp", "bits", "low")
        across = placed.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(_across(percent, nearest), "a long, b long").distinct()
        rest = stored(across.join(tried, ["a", "b"], "left_anti"), "join-rest")
        if not rest.limit(1).count():
            continue
        tried, new = tried.union(rest), verify(docs, rest, width, percent)
        if new.limit(1).count():
            links = links.union(new)
            labels = components(links, "join-components")
    own = nodes.join(labels, "node", "left").select("doc_id", "uid", "n_shingles", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = own.where("n_shingles > 0").join(least, "component").select("doc_id", "n_shingles", "component_id", "uid", "component")
    return joined.union(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "uid", "component"))


ORACLE = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t AS (SELECT r AS x, r AS y FROM d UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x),
m AS (SELECT x AS r, min(doc_id) AS m FROM t JOIN d ON d.r = t.y GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.m AS component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""
