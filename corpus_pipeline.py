"""Corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arenalake.llm import mixing, packing, secrets, simhash, toxicity
from arenalake.llm.common import discard, materialise, table

#: What the domains other than clean keep of the tokens they are expected to hold in the stage's own input.
#: Clean gets the rest, so never less than it has, and documents mainly clean have rates of 1 or more: none goes.
MIX_REST = 0.5


# Every stage takes documents with nulls in any column, empty and very long texts, repeated rows, ties
# and extra columns of any name, keeps their columns (but for packing), and gives an empty table for one.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours call toxic go.

    Equal texts go or stay together, whatever their ids. Null and blank texts have no neighbours
    and score the prior; a null doc_id is scored like any other. Ties at 0.5 go.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest doc_id.

    Ties (repeated and null ids) are settled by the text's hash, then by all columns'; null ids come
    last. Null and blank texts share fingerprint zero, so one of them stays.
    """
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts and n_chars is counted anew; no document goes.

    Null texts stay null; rows that share a doc_id are redacted each by its own text.
    """
    return secrets.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rough documents are thinned and clean ones repeated until the others hold MIX_REST of their present share.

    Null and blank texts have the prior as posterior; equal rows are repeated or go alike. Warns if
    no rates meet the targets.
    """
    return mixing.resample(docs, table(spark, sf_dir, "labels"), keep="clean", rest=MIX_REST)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placements of all words in training sequences; null and blank texts have none, repeats are each placed."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: The label model, the fingerprints and best-fit packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table is removed when the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
