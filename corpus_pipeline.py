"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents, by their exact
names, and no others. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import knn, ngram_join, packing, spans
from shelfmark.llm.queries import table, tokenizer_file, word_pattern
from shelfmark.llm.store import picked, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(docs: DataFrame) -> DataFrame:
    return picked(docs, **{name: name for name in COLUMNS})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on labelled rows of the table as given.

    Null and empty texts have the score of the prior, the share of label 1 in the fit, and stay if that reaches the threshold; equal texts share their
    fate, whatever their ids; rows keep their number and null ids.
    """
    model = knn.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return knn.scored(documents(docs), model).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id (five-word shingles, similarity of 0.8 or more).

    Groups are made by texts alone: rows without an id take part and stay only where no row with one does; texts that share an id are apart unless they are alike; of rows that
    are equal in all columns, or have one id and like texts, one stays. Null texts and texts without words are near nothing and all stay.
    """
    return ngram_join.representatives(documents(docs), width=5, threshold=ngram_join.Threshold(80, 100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences under repeated runs go, but for the first place of each; n_chars follows the text where something went.

    All rows stay, even if nothing is left of a text. Null texts stay null. Rows that repeat an id and its text are one document and stay alike; other texts
    under one id, or without an id, are documents of their own, and those without an id come first.
    """
    out = spans.deduplicated(documents(docs), **spans.PASSAGES)
    return out.withColumn("n_chars", F.when(F.col("removed_runs") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of ``packing.packed``: a null or empty text is one piece with the end token; every row is packed, ids that repeat or are null too."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"), word_pattern())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
