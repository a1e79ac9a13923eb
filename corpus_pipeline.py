"""The corpus pipeline: its stages, each a function of (spark, docs, sf_dir), and their run over documents.

Every stage works on all rows that the one before it kept and returns their columns as they are; the last one emits the
documents as often as the mix takes them. Texts and classifiers' labels come from the tables under ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontam, mixing, neardup, quality, toxicity
from larkspur.llm.common import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.3.

    The model learns from the labelled documents among those given, a bounded sample of each class. Null and empty texts score as
    empty ones, very long texts by the highest of all their windows, repeated rows alike; a score of just 0.3 goes; null
    ids and other columns stay as they are. An empty table, or one without labels, keeps its rows.
    """
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores at 0.5 or more.

    The model learns from the labelled documents among those given, a bounded sample of each class. Null and empty texts score as
    empty ones, very long texts from all their words, repeated rows alike; a score of just 0.5 stays; null ids and other
    columns stay as they are. An empty table, or one without labels, keeps its rows.
    """
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: five-word shingles, 80 % alike.

    Rows of one id are one document, of which the row with the least hash of the text stays. Null and empty texts are like
    nothing and stay, as do all rows with a null id; very long texts are compared whole; an empty table gives none.
    """
    return neardup.keep_one(docs, 5, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, within an edit for every ten of its characters.

    Null and empty texts, and null ids, stay; very long texts are searched whole; repeated rows go or stay alike; an
    empty table or benchmark drops nothing.
    """
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, numbered from 1 in column ``copy``.

    Null sources are one source; null and empty texts have no words but are taken as others of their source; repeated rows
    are taken alike, null ids as one id; sources of equal size by weight go by name; an empty table gives none.
    """
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]
#: Trained models decide two of the stages, so SQL can't give these rows; a test compares run()'s with plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.write(docs, f"stage-{k}")
            work.drop(f"stage-{k - 1}")
    return docs
