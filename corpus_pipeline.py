"""The corpus pipeline: language ID, exact dedup, near-copy dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and hands the
table to the next stage. All stages but the last return the columns of ``documents``.

Defined results, stage by stage: a text that is null or has no letters, or whose n-grams are hardly known in any
learned language, goes at the first stage; of equal texts the row of the largest id stays (null ids lose; of rows that
repeat id and text one stays); of near copies the row of the least id stays, rows of null id stay, and texts too
short for a shingle of five words are one shingle each; personal data is masked and ``n_chars`` follows; every
remaining row is packed, very long texts in several pieces. An empty table gives an empty table; extra columns
travel to the last stage but one under any name.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from triplewright.llm import exact_dedup, jaccard_join, language_id, packing, pii
from triplewright.llm.common import id_crc, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text has a language that the labelled rows teach."""
    return language_id.keep_identified(docs, language_id.fit(docs.where(id_crc("doc_id") % 4 != 2)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the largest id of each text."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the least id of each group of texts linked by a similarity of 0.8 over five-word shingles."""
    return jaccard_join.drop_near_copies(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the token ids of all texts in sequences of at most 1024."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False))


STAGES: list[tuple[str, Stage]] = [("language_id", language), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("pii", personal_data), ("packing", pack)]

#: SQL can't express trained filters, fields and tokenizers; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
