"""A pipeline over ``documents``: quality, near-duplicates, decontamination, pseudonyms, packing.

Each stage works on all rows that the one before has kept; all but the last
return the columns of ``documents``.

Defined results: null and empty texts and texts of few words fail the quality rules; null ids are kept
unless the row goes for its text; of repeated rows one stays; texts of any length are
taken whole; columns besides doc_id, text, lang and source are kept up to the last stage, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontam, packing, pii, quality, simhash
from brindle.llm._common import discard, stored_alone, table
from brindle.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their bucket's fences go."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (words in fives, 0.8 or more) stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gets pseudonyms."""
    return pii.pseudonymise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pieces(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: Sketches, hashes of shingles, keyed pseudonyms and token ids have no SQL; tests hold the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # only the newest copy of the documents stays
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
