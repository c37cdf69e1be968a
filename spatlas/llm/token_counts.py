"""Exact token-length histogram: documents by encoded length, and suffix sums over the lengths.

Each batch is encoded whole and counted at once, so what is shuffled is (length, documents), not documents. Totals, quantiles and
totals truncated at any context limit then come from sums over the longer lengths, taken in blocks of ``BLOCK`` lengths
so that no task holds them all."""

from __future__ import annotations

import base64
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatlas.storage import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-pair encoding from a file of ranks; special tokens' strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(path: str):
    def counted(batches):
        encode, counts = encoder(path).encode_ordinary, Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts[len(encode(text.as_py() or ""))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["n_tokens", "n_docs"])

    return counted


def length_histogram(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(n_tokens, n_docs) over all rows of ``documents`` (text), stored, so that texts are encoded once whatever is asked of it. Null and
    empty texts have no tokens and are counted at 0; repeated rows count each time; other columns aren't read; an empty table
    gives no rows. ``tokenizer`` must be on every executor."""
    counts = documents.select("text").mapInArrow(_counted(tokenizer), "n_tokens long, n_docs long")
    return stored(counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "length-histogram")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L that occurs: n_docs of it, docs_longer and tokens_longer (of documents over L), and truncated_total, the
    tokens left if every document is cut at L. Between two lengths truncated_total grows by docs_longer a token."""
    tokens = F.col("n_docs") * F.col("n_tokens")
    rows = histogram.withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK lengths
    zero = F.lit(0).cast("long")
    after = blocks.select("block", F.coalesce(F.sum("d").over(later), zero).alias("d"), F.coalesce(F.sum("t").over(later), zero).alias("t"), F.sum("t").over(Window.partitionBy()).alias("all"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("d1", F.coalesce(F.sum("n_docs").over(inner), zero)).withColumn("t1", F.coalesce(F.sum(tokens).over(inner), zero)).join(after, "block")
    return summed.select(
        "n_tokens", "n_docs", (F.col("d") + F.col("d1")).alias("docs_longer"), (F.col("t") + F.col("t1")).alias("tokens_longer"),
        (F.col("all") - F.col("t") - F.col("t1") + (F.col("d") + F.col("d1")) * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens that a context limit leaves, for any limit, from ``suffix_sums``; 0 of an empty corpus."""
    row = sums.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("truncated_total", "docs_longer", "n_tokens"), "n_tokens").alias("r"))
    first = sums.agg(F.min_by(F.col("docs_longer") + F.col("n_docs"), "n_tokens").alias("docs"))
    cut = F.col("r.truncated_total") + F.col("r.docs_longer") * (F.lit(limit) - F.col("r.n_tokens"))
    return row.crossJoin(first).select(F.coalesce(cut, F.col("docs") * limit, F.lit(0)).cast("long").alias("truncated_total"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents doesn't exceed."""
    total = sums.agg(F.max(F.col("docs_longer") + F.col("n_docs")).alias("total"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    reached = sums.crossJoin(total).select("n_tokens", "docs_longer", "total", wanted).where(F.col("total") - F.col("docs_longer") >= F.col("share") * F.col("total"))
    return reached.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
