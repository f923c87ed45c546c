"""A training corpus in five stages: language, exact dedup, near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
to the shared folder and reads again as the next stage's ``docs``. All but the last
return the columns they were given. Verdicts are on rows: rows may repeat a doc_id or
have none, and rows that are equal in all columns still count one by one, so that of
a group of copies exactly one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm import concat_cut, extendible_dedup, language_mixture, markov_secrets, simhash_balls
from citemill.llm.common import staged, table, with_place


PLACE = "row_place"


def _kept(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``groups`` keeps, row by row and not by their ids."""
    rows = groups.where("kept").select(F.col(PLACE))
    return docs.join(rows.hint("merge"), PLACE, "left_semi").drop(PLACE)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a language: null texts and texts without a letter."""
    return language_mixture.with_language(docs, *language_mixture.trained_on(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts only the row with the largest doc_id stays; of several such rows, one."""
    placed = with_place(docs, PLACE)
    return _kept(placed, extendible_dedup.exact_groups(placed, place=PLACE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies only the row with the smallest doc_id stays; of several, one."""
    placed = with_place(docs, PLACE)
    return _kept(placed, simhash_balls.near_groups(placed, place=PLACE))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; documents without one pass unchanged."""
    return markov_secrets.redact(docs, markov_secrets.train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return concat_cut.packed_pieces(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# Trained models, fingerprint links and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
