"""The corpus pipeline: language ID, quality, near-duplicates, decontamination, mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import mixing, queries
from plumbline.llm.decontam import without_leaks
from plumbline.llm.langid import fit_prototypes, identify
from plumbline.llm.neardup import near_duplicates
from plumbline.llm.quality import fit_quality, score_quality
from plumbline.llm.session import crc32_mod, cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts under this cosine to every language have no language's letters.
LEAST_COSINE = 0.05
#: Texts under this chance of label 1 are rejected.
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language (no letter, or a cosine under LEAST_COSINE)."""
    prototypes = fit_prototypes(docs.filter(crc32_mod(F.col("doc_id"), 4) != 2))
    scored = identify(docs.withColumn("__in", F.col("text")), prototypes, COLUMNS, text="__in")
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_COSINE)).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose lines are mostly bad."""
    model = fit_quality(docs, queries.marks(table(spark, sf_dir, "labels"), "quality").filter(crc32_mod(F.col("doc_id"), 5) != 0))
    return score_quality(docs.withColumn("__in", F.col("text")), model, COLUMNS, text="__in").filter(F.col("score") >= LEAST_QUALITY).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every group of near-duplicates; of rows that repeat its doc_id, the smallest by all columns."""
    gone = near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    kept = docs.select(COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti").select(COLUMNS)
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    rest = [c for c in COLUMNS if c != "doc_id"]
    several = kept.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("one")).select("doc_id", "one.*").select(COLUMNS)
    return kept.join(repeated.select("doc_id"), "doc_id", "left_anti").select(COLUMNS).union(several)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents to train on, with the number of times each is used."""
    return mixing.mix_sources(docs, F.expr(queries.MIX_DOMAIN_SQL), **queries.MIX)


STAGES = [("language_id", language), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("source_mixing", mix)]

#: Three stages use trained models or whole-text similarity, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
