"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words, the smallest hash of their ``gram``-word strings (the rightmost of equal ones) is kept as
fingerprint. Equal windows keep equal grams, so each window that a document shares with a benchmark item shows as a shared
fingerprint. Hits are then extended over the words around both: a stretch of at least ``window`` equal words is contaminated.
Items of fewer words are one window each and are looked up whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatlas.llm.common import U64, gram_hashes, mix, row_uid, signed, text_chunks, words_of
from spatlas.storage import stored

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bits of the table that tells a document scan which fingerprints the benchmark has; more items only make it coarser.
BITS = 24


def fingerprints(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that winnowing keeps; none of fewer than ``window`` words."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h, width = gram_hashes(words, gram), window - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(h, width)[:, ::-1]
    at = np.unique(np.arange(len(views)) + width - 1 - views.argmin(1))
    return at, h[at]


def _around(words: np.ndarray, at: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The words of every window that can hold the gram at each place; 0 beyond the text's ends."""
    side = window - gram
    padded = np.concatenate([np.zeros(side, U64), words, np.zeros(side, U64)])
    return padded[at[:, None] + np.arange(2 * side + gram)]


def _texts(column: pa.Array):
    for i, j, data, offsets in text_chunks(column):
        words, begin = words_of(data, offsets, IS_WORD)
        words[words == 0] = 1
        for r in range(j - i):
            yield i + r, words[begin[r] : begin[r + 1]]


def _whole(words: np.ndarray, size: int) -> np.ndarray:
    return mix(gram_hashes(words, size) ^ U64(size * 0x9E37 + 1))


def _items(window: int, gram: int):
    def scan(batches):
        for batch in batches:
            ids, fps, around, short = [], [], [], []
            items = batch.column("item_id").to_pylist()
            for row, words in _texts(batch.column("text")):
                if 0 < len(words) < window:
                    h, w, size = _whole(words, len(words)), [b""], len(words)
                else:
                    at, h = fingerprints(words, window, gram)
                    w, size = [x.tobytes() for x in _around(words, at, window, gram)], 0
                ids += [items[row]] * len(h)
                fps += signed(h).tolist()
                around += w[: len(h)]
                short += [size] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(around, pa.binary()), pa.array(short, pa.int32())], names=["item_id", "fp", "item_words", "short"])

    return scan


def _bit_table(prints: DataFrame) -> np.ndarray:
    """2 ** BITS bits: those of the fingerprints' leading bits."""
    rows = prints.select(F.expr(f"shiftrightunsigned(fp, {64 - BITS})").alias("cell")).groupBy(F.expr("cell div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))").alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for part in rows.groupBy(F.expr("word div 8192").alias("part")).agg(F.collect_list(F.struct("word", "bits")).alias("cells")).toLocalIterator():
        for word, bits in part.cells:  # 2 MB in all, however many fingerprints
            out[word] = bits
    return out.view(U64)


def _in_table(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell = h >> U64(64 - BITS)
    return (bits[(cell >> U64(6)).astype(np.int64)] >> (cell & U64(63))) & U64(1) == 1


def _documents(window: int, gram: int, bits, sizes: list[int]):
    hit = pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("words", pa.binary())])

    def scan(batches):
        for batch in batches:
            n_words, hits = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))]
            for row, words in _texts(batch.column("text")):
                n_words[row] = len(words)
                at, h = fingerprints(words, window, gram)
                keep = _in_table(bits.value, h)
                at, h = at[keep], h[keep]
                hits[row] = [{"fp": f, "at": a, "words": w.tobytes()} for f, a, w in zip(signed(h).tolist(), at.tolist(), _around(words, at, window, gram), strict=True)]
                for size in sizes:
                    h = _whole(words, size)
                    at = np.flatnonzero(_in_table(bits.value, h))
                    hits[row] += [{"fp": f, "at": a, "words": b""} for f, a in zip(signed(h[at]).tolist(), at.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(n_words), pa.array(hits, pa.list_(hit))], names=["doc_id", "uid", "n_words", "hits"])

    return scan


def _extended(window: int, gram: int):
    side = window - gram

    def extend(batches):
        """Candidates whose equal words reach the window's length: the range of document words."""
        for batch in batches:
            at, short = batch.column("at").to_numpy().astype(np.int64), batch.column("short").to_numpy().astype(np.int64)
            low, high = at.copy(), at + short
            long = np.flatnonzero(short == 0)
            if len(long):
                both = [np.frombuffer(b"".join(batch.column(c).take(pa.array(long)).to_pylist()), U64).reshape(len(long), -1) for c in ("words", "item_words")]
                same = (both[0] == both[1]) & (both[0] != 0)
                left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(1)
                right = np.cumprod(same[:, side + gram :], axis=1).sum(1)
                core = same[:, side : side + gram].all(1)
                low[long] -= left
                high[long] = np.where(core & (left + gram + right >= window), at[long] + gram + right, low[long])
            keep = pa.array(high > low)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("doc_id", "uid", "item_id")), pa.array(low).filter(keep), pa.array(high).filter(keep)], names=["doc_id", "uid", "item_id", "low", "high"])

    return extend


#: Length of the union of an array of sorted ranges.
COVERED = "aggregate(ranges, struct(0L as n, 0L as end), (s, r) -> struct(s.n + greatest(0L, r.high - greatest(r.low, s.end)) as n, greatest(s.end, r.high) as end), s -> s.n)"


def winnow(documents: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, uid.

    ``benchmark`` has item_id and text. Null texts have no words. A null item_id contaminates but isn't counted or listed. Repeated
    items count once; repeated documents get equal results. Without items, or without documents, nothing is hit. Other columns aren't read."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_items(window, gram), "item_id long, fp long, item_words binary, short int")
    prints = stored(items, "winnow-items")
    sizes = [r.short for r in prints.where("short > 0").select("short").distinct().collect()]  # under ``window`` numbers
    bits = documents.sparkSession.sparkContext.broadcast(_bit_table(prints))
    docs = documents.select(F.col("doc_id").cast("long"), "text", row_uid().alias("uid"))
    scanned = stored(docs.mapInArrow(_documents(window, gram, bits, sorted(sizes)), "doc_id long, uid long, n_words long, hits array<struct<fp:long,at:int,words:binary>>"), "winnow-documents")
    hits = scanned.where("size(hits) > 0").dropDuplicates(["doc_id", "uid"]).select("doc_id", "uid", F.explode("hits").alias("h")).select("doc_id", "uid", "h.*")
    found = hits.join(prints, "fp").mapInArrow(_extended(window, gram), "doc_id long, uid long, item_id long, low long, high long")
    # sets of ranges and of items are made before the shuffle, so a passage in many items adds little
    by_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("uid").alias("u")).agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("ranges"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = by_doc.select("d", "u", F.expr(COVERED).alias("hit"), "items")
    empty = F.array().cast("array<string>")
    joined = scanned.join(covered, scanned.doc_id.eqNullSafe(covered.d) & (scanned.uid == covered.u), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("items", empty)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", empty)).cast("binary"), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"), "uid",
    )


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
p AS (SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT r, j, k, item_id FROM p JOIN i USING (k, g)),
x AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(j, j + k)) AS q FROM h) GROUP BY r),
y AS (SELECT r, count(*) AS n, string_agg(z, ',' ORDER BY z) AS l FROM (SELECT DISTINCT r, item_id::VARCHAR AS z FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_hit, coalesce(y.n, 0)::BIGINT AS n_items, sha256(coalesce(y.l, '')) AS items_sha256, coalesce(x.n, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)"""
