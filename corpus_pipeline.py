"""A training corpus from the table of documents, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nodeloom.lineage import forget, scratch, stored
from nodeloom.llm.common import table
from nodeloom.llm.exact_dedup import exact_dedup
from nodeloom.llm.mixing import take_mix
from nodeloom.llm.near_dedup import near_dedup
from nodeloom.llm.pieces import encoded
from nodeloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field, fitted on the labelled ones, scores under 0.5."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of five-word shingles, the one with the smallest id."""
    return near_dedup(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it, shard by shard in shuffled order."""
    return take_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens, round_trip of each document.

    Workers serve the other stages as well, so they keep less than where they only encode.
    """
    got = encoded(docs, carry=["doc_id", "lang", "source"], keep=(200_000, 500_000))
    return got.select("row.doc_id", "row.lang", "row.source", "token_ids", "n_tokens", "round_trip")


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("encoding", encoding)]

#: Scores of a fitted model and shortest paths have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on the documents; what a stage has written goes when the next one is done with it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch():
            now = stored(stage(spark, docs, sf_dir), result=True)
        forget(docs)
        docs = now
    return STAGES[-1][1](spark, docs, sf_dir)
