"""Corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
scratch folder and reads it again as the next stage's documents. All stages but the last return the columns of
``documents``. Stages keep every row that they have no reason to drop, rows with null ids or texts included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import decontam, line_dedup, packing, simhash, toxicity
from auditlake.llm.common import by_name, free_name, table
from auditlake.plans.registry import query
from auditlake.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 go. The model learns from the labelled documents of the table itself."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    scored = toxicity.score_texts(docs, model, name=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred before go; so do documents of which nothing is left. ``n_chars`` follows the text."""
    left = line_dedup.drop_lines(docs, line_dedup.repeated_lines(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (Jaccard similarity of 5-word shingles of 0.8 or more) stays: the smallest id.

    Of rows with equal id and text one stays; null ids come last.
    """
    classes = simhash.near_duplicates(docs)
    order = F.struct(F.col("first_id").isNull(), "first_id", "text_key")
    best = classes.groupBy("component").agg(F.min(order).alias("best"))
    keep = materialize(best.select(F.col("best.first_id").alias("keep_id"), F.col("best.text_key").alias("keep_key")), "near-kept")
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(by_name(docs, "text"), F.lit(""))))
    met = keyed.join(keep, (keyed[key] == keep["keep_key"]) & keyed["doc_id"].eqNullSafe(keep["keep_id"]), "left_semi").drop(key)
    return met.dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs go."""
    leaks = free_name(docs, "leaks")
    marked = decontam.mark_leaks(docs, table(spark, sf_dir, "benchmark"), name=leaks)
    return marked.where(F.size(leaks) == 0).drop(leaks)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: A trained classifier and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
