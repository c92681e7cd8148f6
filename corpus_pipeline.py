"""From raw documents to encoded training text, stage by stage.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents; each is written
as Parquet and read again as the docs of the next. ``run`` applies them to the documents table.

In every stage a null text counts as empty, rows without a doc_id are rows like others, repeated rows are told apart as
the stage says, an empty table gives an empty one, and columns of any other name pass through as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import cube_mix, ngram_join, pair_index_bpe, suffix_dedup, toxic_cnn
from orbweave.llm.storage import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from a bounded sample of the labelled documents. Equal texts
    go or stay together, a score on the threshold goes, and without labels of both kinds all stay or, where all labels
    are 1, go."""
    return toxic_cnn.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id; of repeated rows one. Null and empty
    texts are one group; rows without a doc_id come before all others."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller doc_id has go from the text; every document stays,
    with an empty text where all of it goes. Rows with one doc_id take nothing from each other."""
    return suffix_dedup.without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice. A null source is one of its own;
    repeated rows are drawn each for itself."""
    return cube_mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, a row for each row; empty texts have none."""
    return pair_index_bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_copies),
    ("substring_dedup", repeated_passages),
    ("mixing", mixing),
    ("bpe", encoding),
]

#: The classifier and the sampling have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
