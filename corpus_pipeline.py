"""A training-data pipeline over ``documents``: each stage gets what the one before kept, written as Parquet and read again.

In every stage a null text is an empty one, rows equal in doc_id and text are treated alike, a null doc_id is an id that sorts last, whole
texts are read, other columns than ``COLUMNS`` are left behind before the first stage (so their names can't clash), and an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatlas.llm import mixing, quality_rules
from spatlas.llm.common import row_uid
from spatlas.llm.line_templates import line_dedup
from spatlas.llm.ngram_join import ngram_join
from spatlas.llm.winnowing import winnow
from spatlas.storage import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _chosen(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, uid) is among those chosen."""
    right = chosen.select(F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    left = docs.withColumn("uid", row_uid())
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("uid") == F.col("u")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects; texts without words fail it. The ledger is stored with the documents and read by the policy."""
    return quality_rules.verdict(quality_rules.ledger(docs, keep=COLUMNS), "v2").where("kept").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents; n_chars follows the text. A text can become empty, its row stays."""
    return line_dedup(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, of equal ids that of the smallest hash. Repeated rows are one; documents
    without words all stay, but for repeated rows."""
    found = ngram_join(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.uid")
    none = found.where("n_shingles = 0").select("doc_id", "uid")
    return _chosen(docs, first.union(none)).dropDuplicates(["doc_id", "uid"]).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item; repeated rows stay or go together."""
    found = winnow(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _chosen(docs, found.where("NOT contaminated").select("doc_id", "uid").distinct()).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample: documents with the copies that the calibrated weights give them, at least one, and topic, n_tokens and weight beside them."""
    return mixing.mix(docs, share=0.5, power=0.5, seed=7, keep=COLUMNS).where("n_copies > 0")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed)]
#: Fingerprints, sampling by hash and raking have no short SQL; tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
