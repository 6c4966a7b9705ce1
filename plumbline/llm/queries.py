"""One query for each of the thirteen corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, neardup
from .chat import format_chats
from .decontam import leaks
from .fingerprints import fingerprint_documents
from .html_extract import extract_main_text, fit_extractor
from .langid import fit_prototypes, identify
from .neardup import near_duplicates
from .pii import KINDS, find_personal_data, written
from .quality import fit_quality, score_quality
from .resampling import oracle_sql as resampling_sql
from .resampling import resample
from .session import crc32_mod, table
from .tokens import count_tokens, load_vocabulary
from .toxicity import fit_toxicity, score_toxicity
from .whitening import whiten


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc32_mod(F.col("doc_id"), 4)
    prototypes = fit_prototypes(docs.filter(fold != 2))
    return identify(docs, prototypes, ["doc_id"]).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_main_text(table(spark, sf_dir, "pages"), fit_extractor(), ["page_id", "url"])
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def marks(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows that have the label."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label IS NOT NULL")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 5)
    model = fit_quality(docs, marks(table(spark, sf_dir, "labels"), "quality").filter(fold != 0))
    return score_quality(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 3)
    model = fit_toxicity(docs.filter(fold != 1), marks(table(spark, sf_dir, "labels"), "toxic").filter(fold != 1))
    return score_toxicity(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_vocabulary(), ["doc_id"])


#: The mix: a domain is the first digit of a source's number.
MIX = {"weights": {"domain": {"d1": 4, "d2": 2}, "lang": {"en": 3, "de": 2, "fr": 2}, "source": {"src10": 3, "src11": 2}}, "share": 0.6, "epochs": 3, "seed": "mix-1"}
MIX_DOMAIN_SQL = "'d' || substr(source, 4, 1)"


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), F.expr(MIX_DOMAIN_SQL), **MIX)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_source_mixing": op7_source_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_whitening": op11_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_personal_data": op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": neardup.ORACLE_SQL,
    "op7_source_mixing": mixing.oracle_sql("documents", MIX_DOMAIN_SQL, **MIX),
    "op12_importance_resampling": resampling_sql(),
}
