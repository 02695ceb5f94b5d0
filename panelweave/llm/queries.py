"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelweave.llm import alignment, exact_dedup, language_id, mixing, near_dedup, packing, pii, quality_rules, secrets, spelling, substring_dedup, token_count, toxicity
from panelweave.llm.common import held_out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = documents(spark, sf_dir), held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~mark), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return language_id.identify(docs, model).select("doc_id", mark.alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.spans_of(docs)
    return pii.pii(docs, pii.fit(docs, found=found), found=found)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir).filter(~held_out(F.col("doc_id"))))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.fit(docs, labels(spark, sf_dir)))


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table as domains: toxic, low (quality 0), high."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    return labels(spark, sf_dir).select("doc_id", domain.alias("domain"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    domains = mixing.fit_domains(docs, domain_labels(spark, sf_dir))
    return mixing.mix(docs, domains, {"high": 0.7, "low": 0.2, "toxic": 0.1})


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_token_counts": op2_token_counts,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_minhash": op10_minhash,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_secrets": op13_secrets,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH forms AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS digest
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
               doc_id = first_value(doc_id) OVER best AS kept, digest AS text_sha256
        FROM forms WINDOW best AS (PARTITION BY digest ORDER BY n_chars DESC, doc_id)""",
}
