"""The corpus pipeline: filter, deduplicate, mix and pack the documents, one operator of ``panelweave.llm`` per stage.

Every stage takes the session, the documents that the stage before kept, and the folder of the tables. All but the last
return the columns of ``documents``; each result is written as Parquet and read again before the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from panelweave.llm.common import stage

#: Shares of tokens that the mix aims at; the total of good text stays as it is, and nothing is repeated.
WEIGHTS = {"high": 0.95, "low": 0.05}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that score 0.5 or more; a NULL text is scored as empty, and without labels no row goes."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def reject_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts without white space; a NULL text is empty, and NULL and repeated ids are judged by text."""
    return exact_dedup.drop_exact_duplicates(docs)


def reject_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; texts without words stay, and rows that repeat an id and text share their verdict."""
    return near_dedup.drop_near_duplicates(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row or none of it, by its own rate; good rows stay as far as the fit lets them, and without labels all rows stay."""
    domain = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    domains = mixing.fit_domains(docs, _labels(spark, sf_dir).select("doc_id", domain.alias("domain")))
    return mixing.mixed_rows(docs, domains, WEIGHTS, anchor="high", most=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document and its place in a sequence of at most 2,048 tokens; a NULL text is empty."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", reject_exact_copies),
    ("near dedup", reject_near_copies),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: The toxicity and mixing stages learn models, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
