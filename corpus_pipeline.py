"""The corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs. All but
the last return the columns of documents. Classifiers learn from the labelled rows of their own input.

SQL can express none of the first two stages (they fit models), so run() has no SQL; tests hold it against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import jaccard, packing, quality, toxicity
from firnline.llm.common import remainder, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier takes for good (score of at least 0.5)."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(3) != 1, "quality")
    return quality.with_scores(docs, weights, "__score").filter(F.col("__score") >= 0.5).drop("__score")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.with_tags(docs, model, "__tags").filter(F.col("__tags.score") < 0.5).drop("__tags")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of documents linked by 3/4 of their word 5-grams."""
    return jaccard.without_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the token pieces of all documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
