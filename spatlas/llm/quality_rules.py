"""Rule bitmask ledger: every rule is evaluated once; policies and ablations only read its bits.

``measure`` adds the measurements of each text, ``ledger`` one long whose bit k tells that rule k failed. A policy is a mask
of rules with a version; a document is kept where no bit of the mask failed. ``ablation`` sums bit patterns.
Built from SQL functions alone; everything happens within a row, so no key can be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatlas.storage import stored

SPACE = "[\\x20\\x09-\\x0D]"
#: (name, SQL condition of failure over the measurements). A rule's bit is its place: append, never reorder.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("upper_case", "100 * n_upper > 40 * word_chars"),
]
#: The base rules hold in every policy.
BASE = 0b11
POLICIES = {"v1": 0b000111, "v2": 0b111111}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _without(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def measure(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the measurements of ``text``; a null text has no words, and all its counts are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = documents.select(*keep, text.alias("_t"), F.array_remove(F.split(text, f"{SPACE}+"), "").alias("_w"))
    counted = words.select(
        *keep,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _without(F.col("_t"), "[#*$%&|<>]").alias("n_symbols"),
        _without(F.col("_t"), "[A-Z]").alias("n_upper"),
        F.expr(f"filter(split(_t, '\\n'), l -> rlike(l, '{SPACE.replace('[', '[^').replace(chr(92), chr(92) * 2)}'))").alias("_l"),
    )
    # windows of three words by hash; most texts have none twice and need no sort
    grams = counted.withColumn("_g", F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2)))"))
    ordered = grams.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN sort_array(transform(_g, (g, i) -> struct(g AS g, i AS i))) END"))
    twice = ordered.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> x.g <=> get(_s, k - 1).g OR x.g <=> get(_s, k + 1).g), x -> x.i))"))
    covered = "aggregate(_p, struct(0L AS n, 0 AS end), (a, i) -> struct(a.n + (i + 3 - greatest(i, a.end)) AS n, i + 3 AS end), a -> a.n)"
    return twice.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"), "n_upper",
    )


def ledger(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default doc_id), the measurements, and ``failed``: the bits of the rules that each row of ``documents`` fails; stored.

    Texts are measured once, whatever policies and ablations read the ledger. One row per row: repeated rows, null ids and null texts
    (which have no words) are measured like others. Columns that are not in ``keep`` aren't read, so their names can't clash; those
    in ``keep`` that are named like a measurement are replaced by it."""
    keep = [c for c in dict.fromkeys(keep or ["doc_id"]) if c not in (*MEASURES, "failed", "base_failed", "kept")]
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, (_, rule) in enumerate(RULES))
    return stored(measure(documents, keep).withColumn("failed", F.expr(bits)), "rule-ledger")


def verdict(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; no text is read again."""
    return entries.withColumn("base_failed", F.expr(f"failed & {BASE}L <> 0")).withColumn("kept", F.expr(f"failed & {POLICIES[policy] | BASE}L = 0"))


def ablation(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that are kept once it is left out.

    Rows are first counted by bit pattern (at most 2 ** rules groups, combined before the shuffle)."""
    mask = POLICIES[policy] | BASE
    patterns = entries.groupBy(F.expr(f"failed & {mask}L").alias("bits")).agg(F.count("*").alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if mask >> k & 1]))
    each = patterns.select("bits", "n", names.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.expr("CASE WHEN bits & bit <> 0 THEN n ELSE 0 END")).alias("n_failed"), F.sum(F.expr("CASE WHEN bits = bit THEN n ELSE 0 END")).alias("n_only"), F.sum(F.expr("CASE WHEN bits & ~bit = 0 THEN n ELSE 0 END")).alias("n_kept_without"),
    )


_WORD = "[^\\x20\\x09-\\x0D]+"
_MEASURED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS a FROM w),
g AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM g WHERE c IS NOT NULL),
m AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM n WHERE k > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n, count(DISTINCT x) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
q AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n - l.k, 0)::BIGINT AS n_dup_lines,
  coalesce(m.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM w LEFT JOIN m USING (r) LEFT JOIN l USING (r))"""
ORACLE = f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES[0][1]}) OR ({RULES[1][1]}) AS base_failed,
  NOT ({" OR ".join(f"({rule})" for k, (_, rule) in enumerate(RULES) if POLICIES["v2"] >> k & 1)}) AS kept
FROM q"""


def _ablation_sql() -> str:
    """For each policy and rule, counted over the rules' conditions rather than bits."""
    parts = []
    for policy, mask in POLICIES.items():
        held = {name: rule for k, (name, rule) in enumerate(RULES) if (mask | BASE) >> k & 1}
        for name, rule in held.items():
            others = " OR ".join(f"({r})" for n, r in held.items() if n != name)
            parts.append(f"SELECT '{policy}' AS policy, '{name}' AS rule, count(*) FILTER ({rule}) AS n_failed, count(*) FILTER (({rule}) AND NOT ({others})) AS n_only, count(*) FILTER (NOT ({others})) AS n_kept_without FROM q")
    return f"{_MEASURED} " + " UNION ALL ".join(parts)


ABLATION_ORACLE = _ablation_sql()
