"""Mixing sources to target weights by iterative proportional fitting, from SQL functions alone.

Documents are summed into cells of source, language and topic; the cells' token weights are raked to the three target marginals
in turn until all hold. A cell's weight over its tokens, scaled to the token budget, is the expected number of copies of each
of its documents; the fraction is decided by a hash of the row, so a rerun picks the same documents. Sums of a category
are combined before the shuffle; no step gathers a category's rows in one task."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatlas.storage import discard, stored

DIMENSIONS = ["source", "lang", "topic"]
#: Word classes that stand for topics where a table names none.
TOPICS = 8
#: Cells that one task rakes; more are raked by more tasks, with shuffles between the dimensions.
CELLS_A_TASK, ROUNDS_A_JOB = 200_000, 4


def word_count(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def lexical_topic(text: Column, classes: int = TOPICS) -> Column:
    """The class (a hash, one of at most 10) that most content words of the whole text are of, the smallest of equal ones; '' without such
    words. Content words have three letters or more; characters beyond ASCII count as letters."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: F.length(w) >= 3)
    marks = F.array_join(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(classes)).cast("string")), "")
    return _most(F.transform(F.array(marks), lambda m: F.array(*[_times(m, k) for k in range(classes)]))[0], [f"topic{k}" for k in range(classes)])


def _times(marks: Column, k: int) -> Column:
    return F.length(marks) - F.length(F.replace(marks, F.lit(str(k))))


def _most(counts: Column, names: list[str]) -> Column:
    """The name of the largest count, the first of equal ones; '' if all are 0."""
    best = F.transform(F.array(counts), lambda c: F.when(F.array_max(c) > 0, F.element_at(F.array(*map(F.lit, names)), F.array_position(c, F.array_max(c)).cast("int"))).otherwise(""))
    return best[0]


def topic_by_terms(text: Column, terms: dict[str, list[str]]) -> Column:
    """The topic of whose listed words the whole text has most, in the lists' order among equal ones; '' without any."""
    every = "|".join(sorted({w.lower() for words in terms.values() for w in words}, key=lambda w: (-len(w), w)))
    hits = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<![\\p{{L}}\\p{{N}}])({every})(?![\\p{{L}}\\p{{N}}])"))

    def count(found: Column, words: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin([x.lower() for x in words])))

    counts = F.transform(F.array(hits), lambda found: F.array(*[count(found, words) for words in terms.values()]))
    return _most(counts[0], list(terms))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """A target marginal, up to its scale: each category's tokens to a power. Under 1 it takes from a hot source."""
    return cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def _shares(cells: DataFrame, dimension: str, target: DataFrame) -> DataFrame:
    """(_c, _target_d) of every category of the cells: targets of categories with tokens, scaled to sum to 1; 0 for others."""
    wanted = target.select(F.col(dimension).alias("_d"), F.col("target").cast("double").alias("_t"))
    sums = cells.groupBy(F.col(dimension).alias("_c")).agg(F.sum("tokens").alias("_n"))
    met = stored(sums.join(wanted, F.col("_c").eqNullSafe(F.col("_d")), "left").select("_c", F.when(F.col("_n") > 0, F.coalesce("_t", F.lit(0.0))).otherwise(0.0).alias("_t")), "shares")
    whole = met.agg(F.sum("_t")).first()[0]
    return met.select("_c", (F.col("_t") / (whole or 1.0)).alias(f"_target_{dimension}"))


def _scaled(cells: DataFrame, dimension: str, total: float) -> DataFrame:
    """Cells with ``_have``, their category's weight, scaled to its target; ``_gap`` is the largest share that had to move in this round."""
    moved = F.abs(F.col("_have") / total - F.col(f"_target_{dimension}"))
    weight = F.coalesce(F.col("_weight") * F.col(f"_target_{dimension}") * total / F.expr("nullif(_have, 0)"), F.lit(0.0))
    return cells.withColumns({"_gap": F.greatest("_gap", moved), "_weight": weight}).drop("_have")


def _round(cells: DataFrame, dimensions: list[str], total: float, few: bool) -> DataFrame:
    """Every dimension once. Few cells are one task's windows, without a shuffle; sums of many are combined, joined and stored by dimension."""
    cells = cells.withColumn("_gap", F.lit(0.0))
    for d in dimensions:
        if few:
            cells = _scaled(cells.withColumn("_have", F.sum("_weight").over(Window.partitionBy(d))), d, total)
        else:
            sums = cells.groupBy(F.col(d).alias("_c")).agg(F.sum("_weight").alias("_have"))
            last, cells = cells, stored(_scaled(cells.join(sums, F.col(d).eqNullSafe(F.col("_c"))).drop("_c"), d, total), "rake")
            if hasattr(last, "_stored_at"):
                discard(last)
    return cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-4, rounds: int = 200) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: as tokens, but with the target shares in every dimension.

    A target is (category, target), at any scale; null is a category. One without target gets weight 0; targets of categories without tokens
    can't be met and are left out. A round scales the weights to one dimension after the other, and the rounds end
    when none had to move a share by more than ``tolerance``. Targets that empty cells contradict never get there: after ``rounds`` a
    warning tells the gap, and only the last dimension's marginal holds exactly. Up to 200,000 cells are raked by one task, a few rounds
    a job; more by as many tasks as they need."""
    own, names = cells.columns, list(targets)
    n, total = cells.agg(F.count("*"), F.sum("tokens").cast("double")).first()
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    few = n <= CELLS_A_TASK
    start = cells
    for d in names:
        start = start.join(_shares(cells, d, targets[d]), F.col(d).eqNullSafe(F.col("_c"))).drop("_c")
    raked, done = stored(start.withColumn("_weight", F.col("tokens").cast("double")), "rake"), 0
    while True:
        new = raked.coalesce(1) if few else raked
        for _ in range(min(ROUNDS_A_JOB, rounds - done) if few else 1):
            new, done = _round(new.drop("_gap"), names, total, few), done + 1
        if few:
            last, new = raked, stored(new, "rake")
            discard(last)
        raked, gap = new, new.agg(F.max("_gap")).first()[0]
        if gap <= tolerance:
            break
        if done >= rounds:
            warnings.warn(f"after {rounds} rounds shares still move by {gap:.2g}: empty cells contradict the targets", stacklevel=2)
            break
    return raked.select(*own, F.col("_weight").alias("weight"))


def mix(documents: DataFrame, share: float = 0.5, targets: dict[str, DataFrame] | None = None, power: float = 0.5, seed: int = 7, topic: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``documents`` (doc_id, text, source, lang) with topic, n_tokens, weight (expected copies) and n_copies.

    ``share`` is the token budget as part of all tokens; ``targets`` by dimension, or tempered by ``power``. Tokens are words; texts without
    words have weight 0. ``topic`` is a column of the table, or the class of most content words. A null source, language or topic is the
    category ''. Rows that are equal in doc_id and text are drawn alike. ``keep`` names more columns to carry; those named
    as a result are replaced by it. The rows are measured once and stored. An empty table gives an empty result."""
    results = ["topic", "n_tokens", "weight", "n_copies"]
    carried = ["doc_id", *[c for c in dict.fromkeys(keep or []) if c not in ("doc_id", *results)]]
    roll = F.expr(f"xxhash64(doc_id, coalesce(text, ''), {seed}L) & {(1 << 53) - 1}L") / float(1 << 53)
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "lang")] + [F.coalesce(topic if topic is not None else lexical_topic(F.col("text")), F.lit("")).alias("topic")]
    rows = stored(documents.select(F.struct(*carried).alias("kept"), *named, word_count().alias("tokens"), roll.alias("u")), "mix-rows")
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, targets or {d: tempered(cells, d, power) for d in DIMENSIONS})
    each = raked.select(*DIMENSIONS, F.coalesce(F.lit(share) * F.col("weight") / F.expr("nullif(tokens, 0)"), F.lit(0.0)).alias("weight"))
    drawn = rows.join(each, DIMENSIONS)
    worded = F.col("tokens") > 0
    copies = F.floor("weight") + F.when(F.col("u") < F.col("weight") - F.floor("weight"), 1).otherwise(0)
    return drawn.select(*[F.col("kept")[c].alias(c) for c in carried], "topic", F.col("tokens").alias("n_tokens"), F.when(worded, F.col("weight")).otherwise(0.0).alias("weight"), F.when(worded, copies).otherwise(0).cast("long").alias("n_copies"))
