"""Line deduplication with a log-template tree.

A line is parsed to a leaf of a tree of fixed depth: its token count, then its leading tokens, where tokens with digits are
wildcards. Within a leaf, variable fields are generalised: a token stays in the template only if enough lines of the leaf have it
at that place; if too few stay, the line is its own template. A template that recurs in enough distinct documents is boilerplate and its lines are dropped.

Documents that mostly consist of recurring lines may be copies of one another, whose lines are theirs. What else such a document
holds tells: lines of its own, other than near variants of recurring lines, make it distinct, however little they are, and so do the
recurring lines beside the one that is voted on.

A line can only recur if its leaf holds enough lines, so the leaves are counted first and all but the lines of such leaves are put
aside; the tokens of the others' lines are never moved. Leaves are never gathered either: all of this is counts by (leaf, place,
token), (leaf, line) and (template, document), combined before each shuffle, so a hot line or leaf costs a few rows a task. Where
lines meet the table of templates, both are dealt over salts, as one line may be a third of all."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatlas.llm.common import row_uid
from spatlas.llm.winnowing import _bit_table, _in_table
from spatlas.storage import stored

_DIGIT = re.compile(r"[0-9]")
_FIELD = re.compile(r"\S*[0-9]\S*")
LINES = "doc_id long, uid long, line int, leaf long, shape long, chars long, rest long, fresh boolean, doc_chars long"
TOKENS = "leaf long, shape long, tokens array<int>"
#: Tasks over which the lines of one template, and copies of the templates, are dealt.
SALTS = 8


def _signed(n: int, bits: int = 64) -> int:
    return n - (1 << bits) if n >> (bits - 1) else n


def parse(line: str, depth: int) -> tuple[int, int, list[str]]:
    """Leaf, hash of the whole line, and tokens, with tokens that hold digits as wildcards."""
    tokens = _FIELD.sub("<*>", line).split() if _DIGIT.search(line) else line.split()
    leaf = xxhash.xxh64_intdigest(f"{len(tokens)} {' '.join(tokens[:depth])}")
    return _signed(leaf), _signed(xxhash.xxh64_intdigest(" ".join(tokens))), tokens


def _scan(depth: int, min_tokens: int):
    """Lines of enough tokens; ``rest`` names the document's other lines, ``doc_chars`` is the length of these."""

    def scan(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, uid, text in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), batch.column("text"), strict=True):
                seen, start, short, chars = set(), len(out), xxhash.xxh64(), 0
                for at, line in enumerate((text.as_py() or "").split("\n")):
                    leaf, shape, tokens = parse(line, depth)
                    if len(tokens) < min_tokens:
                        if tokens:
                            short.update(f"{' '.join(tokens)}\n")
                        continue
                    out.append((doc_id, uid, at, leaf, shape, len(line), (leaf, shape) not in seen))
                    seen.add((leaf, shape))
                    chars += len(line)
                rest = _signed(short.intdigest())
                out[start:] = [(*x[:6], rest, x[6], chars) for x in out[start:]]
                if len(out) > 50_000:
                    yield _table(out)
                    out = []
            yield _table(out)

    return scan


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in LINES.split(", ")])


def _token_scan(depth: int, min_tokens: int, leaves, docs):
    """(leaf, shape, tokens) of the lines of leaves that may be wanted, or of documents that may be; each line once a batch."""

    def scan(batches):
        for batch in batches:
            mine = _in_table(docs.value, batch.column("fp").to_numpy().view(np.uint64)) if docs else np.ones(len(batch), bool)
            found: dict[tuple[int, int], list[int]] = {}
            for text in batch.column("text").filter(pa.array(mine)):
                parsed = [x for x in (parse(line, depth) for line in (text.as_py() or "").split("\n")) if len(x[2]) >= min_tokens]
                if leaves and parsed:
                    wanted = _in_table(leaves.value, np.array([x[0] for x in parsed], np.int64).view(np.uint64))
                    parsed = [x for x, keep in zip(parsed, wanted, strict=True) if keep]
                for leaf, shape, tokens in parsed:
                    if (leaf, shape) not in found:
                        found[leaf, shape] = [_signed(xxhash.xxh32_intdigest(t), 32) for t in tokens]
            columns = [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["leaf", "shape", "tokens"])

    return scan


def _filter(bits):
    def scan(batches):
        for batch in batches:
            yield batch.filter(pa.array(_in_table(bits.value, batch.column(0).to_numpy().view(np.uint64))))

    return scan


def _maybe(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` (a hash) may be among those ``wanted`` (fp), by 2 MB of bits: rows that can't meet aren't shuffled."""
    bits = rows.sparkSession.sparkContext.broadcast(_bit_table(wanted))
    keyed = rows.select(key.alias("_key"), *rows.columns)
    return keyed.mapInArrow(_filter(bits), keyed.schema).drop("_key")


def _doc_print(doc: str = "doc_id", uid: str = "uid") -> Column:
    return F.xxhash64(doc, uid)


def _with_templates(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with ``template``: that of their (leaf, shape), or the line itself."""
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = lines.withColumn("_salt", F.pmod(_doc_print(), F.lit(SALTS)).cast("int")).join(salted, ["leaf", "shape", "_salt"], "left")
    return joined.withColumn("template", F.coalesce("template", "shape")).drop("_salt")


def templates(lines: DataFrame, tokens: DataFrame, min_docs: int, constant_share: float, depth: int) -> DataFrame:
    """(leaf, shape, template) of the lines whose fields are generalised. A line counts once a document."""
    counted = lines.where("fresh").groupBy("leaf", "shape").agg(F.count("*").alias("n"))
    distinct = stored(counted.join(tokens, ["leaf", "shape"]), "template-lines")
    fields = distinct.select("leaf", "shape", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "token"))
    often = fields.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support")).where(f"support >= {min_docs}").drop("support")
    often = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = fields.withColumn("_salt", F.pmod("shape", F.lit(SALTS)).cast("int")).join(often, ["leaf", "place", "token", "_salt"])
    kept = kept.groupBy("leaf", "shape").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("kept"))
    enough = f"size(kept) >= {constant_share} * size AND size(kept) > {depth}"
    return kept.where(enough).select("leaf", "shape", F.xxhash64(F.lit(1), "kept").alias("template"))


def _variants(tokens: DataFrame, own: DataFrame, sources: DataFrame) -> DataFrame:
    """Those of ``own`` (leaf, shape) that share a third of their runs of three tokens, ends included, with one of ``sources``.

    A run stands for one source, the smallest that has it, so a frequent run adds one row."""
    wanted = own.distinct().withColumn("source", F.lit(False)).union(sources.withColumn("source", F.lit(True)))
    padded = wanted.join(tokens, ["leaf", "shape"]).select("leaf", "shape", "source", F.concat(F.array(F.lit(0)), "tokens", F.array(F.lit(1))).alias("p"))
    runs = padded.withColumn("runs", F.expr("array_distinct(transform(sequence(0, size(p) - 3), i -> xxhash64(p[i], p[i + 1], p[i + 2])))"))
    runs = stored(runs.select("leaf", "shape", "source", F.size("runs").alias("n"), F.explode("runs").alias("run")), "variant-runs")
    first = runs.where("source").groupBy("run").agg(F.min(F.xxhash64("leaf", "shape")).alias("of"))
    shared = runs.where("NOT source").join(first, "run").groupBy("leaf", "shape", "of").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return shared.where("3 * c >= n").select("leaf", "shape").distinct()


def _votes(tokens: DataFrame, suspects: DataFrame, sources: DataFrame) -> DataFrame:
    """(leaf, template, n, votes): how many of ``suspects`` have a recurring template, and how many distinct ones that are."""
    variants = _variants(tokens, suspects.where("NOT recurs").select("leaf", "shape"), sources).withColumn("variant", F.lit(True))
    h = F.xxhash64("leaf", "template")
    own = ~F.col("recurs") & F.col("variant").isNull()
    rests = suspects.join(variants, ["leaf", "shape"], "left").groupBy(F.col("doc_id").alias("d"), F.col("uid").alias("u")).agg(
        F.count_if(own).alias("n_own"), F.bit_xor(F.when(own, h)).alias("own"), F.slice(F.sort_array(F.collect_set(F.when(F.col("recurs"), h))), 1, 2).alias("low"), F.first("rest").alias("short")
    )
    beside = F.when(F.get("low", F.lit(0)) == h, F.get("low", F.lit(1))).otherwise(F.get("low", F.lit(0)))
    vote = F.when(F.col("n_own") > 0, F.xxhash64(F.lit(1), "own")).otherwise(F.xxhash64(F.lit(2), beside, "short"))
    cast = suspects.where("recurs").join(rests, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")))
    return cast.groupBy("leaf", "template").agg(F.count("*").alias("n"), F.countDistinct(vote).alias("votes"))


def line_dedup(documents: DataFrame, min_docs: int = 5, depth: int = 3, constant_share: float = 0.7, min_tokens: int = 3, copied_share: float = 0.5) -> DataFrame:
    """The rows of ``documents`` with ``text`` without the lines of recurring templates; n_lines, n_dropped and uid are added.

    Lines are cut at line feeds; lines of fewer than ``min_tokens`` tokens are never dropped. Documents whose lines (by
    characters) are recurring ones for more than ``copied_share`` count once towards ``min_docs`` for each distinct set of lines of their own; those
    without any, once for each smallest other recurring line and short lines. Boilerplate is dropped from all. Passages that repeat in fewer than ``min_docs`` stay. A null
    text stays null and has no lines; a text can become empty, its row stays. Rows equal in doc_id and text are one document and get
    equal results. Columns named n_lines, n_dropped or uid are replaced, all others kept. An empty table gives an empty result."""
    keys = ["doc_id", "uid"]
    spark = documents.sparkSession
    docs = documents.withColumn("uid", row_uid())
    texts = docs.select(F.col("doc_id").cast("long"), "uid", "text")
    lines = stored(texts.mapInArrow(_scan(depth, min_tokens), LINES), "lines")
    leaves = stored(lines.where("fresh").groupBy("leaf").agg(F.count("*").alias("n"), (F.min("shape") != F.max("shape")).alias("busy")).where(f"n >= {min_docs}").drop("n"), "busy-leaves")
    active = spark.sparkContext.broadcast(_bit_table(leaves.select(F.col("leaf").alias("fp"))))
    first = lines.select("leaf", *[c for c in lines.columns if c != "leaf"])
    live = stored(first.mapInArrow(_filter(active), first.schema).join(leaves, "leaf").dropDuplicates([*keys, "line"]), "live-lines")
    scanned = texts.select(_doc_print().alias("fp"), "text")
    tokens = stored(scanned.mapInArrow(_token_scan(depth, min_tokens, active, None), TOKENS).join(leaves, "leaf").groupBy("leaf", "shape").agg(F.first("tokens").alias("tokens"), F.first("busy").alias("busy")), "line-tokens")
    found = stored(templates(live.where("busy"), tokens.where("busy").drop("busy"), min_docs, constant_share, depth), "templates")

    def by_document(some: DataFrame) -> DataFrame:
        what = [F.sum("chars").alias("chars"), F.collect_set("line").alias("at"), F.min("shape").alias("shape"), F.first("rest").alias("rest"), F.first("doc_chars").alias("doc_chars")]
        return _with_templates(some, found).groupBy("leaf", "template", *keys).agg(*what)

    by_doc = stored(by_document(live), "line-templates")
    recurring = stored(by_doc.groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("shape").alias("example")).where(f"docs >= {min_docs}"), "recurring-templates")
    again = recurring.select("leaf", "template", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("recurs"))

    def marked(some: DataFrame) -> DataFrame:
        joined = some.withColumn("_salt", F.pmod(_doc_print(), F.lit(SALTS)).cast("int")).join(again, ["leaf", "template", "_salt"], "left")
        return joined.withColumn("recurs", F.coalesce("recurs", F.lit(False))).drop("_salt")

    copied = F.sum(F.when(F.col("recurs"), F.col("chars")).otherwise(0)) > copied_share * F.first("doc_chars")
    maybe = stored(marked(by_doc).groupBy(*keys).agg(copied.alias("copied")).where("copied").select(F.col("doc_id").alias("d"), F.col("uid").alias("u"), _doc_print().alias("fp")), "maybe-copies")
    of_maybe = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u"))
    theirs = _maybe(lines, _doc_print(), maybe.select("fp")).join(maybe, of_maybe, "left_semi").dropDuplicates([*keys, "line"])
    suspects = stored(marked(by_document(theirs)).select(*keys, "leaf", "template", "shape", "rest", "recurs"), "maybe-copied-lines")
    copies = spark.sparkContext.broadcast(_bit_table(maybe.select("fp")))
    own = scanned.mapInArrow(_token_scan(depth, min_tokens, None, copies), TOKENS)
    told = stored(tokens.drop("busy").union(own).groupBy("leaf", "shape").agg(F.first("tokens").alias("tokens")), "variant-tokens")
    voted = _votes(told, suspects, recurring.select("leaf", F.col("example").alias("shape")))
    distinct = F.col("docs") - F.coalesce("n", F.lit(0)) + F.coalesce("votes", F.lit(0))
    boilerplate = recurring.join(voted, ["leaf", "template"], "left").where(distinct >= min_docs).select("leaf", "template")
    boilerplate = boilerplate.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = by_doc.withColumn("_salt", F.pmod(_doc_print(), F.lit(SALTS)).cast("int")).join(boilerplate, ["leaf", "template", "_salt"])
    dropped = lost.groupBy(F.col("doc_id").alias("_d"), F.col("uid").alias("_u")).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("_at"))
    joined = docs.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("uid") == F.col("_u")), "left").drop("_d", "_u")
    left = "transform(array(struct(split(text, '\\n') AS l, _at AS a)), s -> array_join(transform(array_except(sequence(0, size(s.l) - 1), s.a), i -> s.l[i]), '\\n'))[0]"
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    counted = joined.withColumn("n_lines", n_lines).withColumn("n_dropped", F.coalesce(F.size("_at"), F.lit(0)).cast("long"))
    return counted.withColumn("text", F.expr(f"CASE WHEN _at IS NULL THEN text ELSE {left} END")).drop("_at")
