"""From raw documents to mixed, encoded training text.

Each stage takes (spark, docs, sf_dir) and returns the table of documents that the next one works on; the last returns the
encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, mixing, near_text, pii, toxicity
from quillspark.llm.queries import VOCABULARY
from quillspark.llm.shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled documents of the input, calls toxic go.

    Null and empty texts count as texts without words, long ones are read whole, repeated rows go or stay together, all
    columns stay whatever their names, and an empty table gives an empty one.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the least id; of equal ids, any one.

    Rows are told apart by a number of their own, so repeated ids and null ids do no harm.  Null and empty texts are copies
    of nothing and stay; long texts are compared whole; all columns stay whatever their names; an empty table gives an empty
    one.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")), "pipeline-rows")
    found = near_text.near_duplicates(rows.select("number", "row.text"), id_col="number").select(F.col("doc_id").alias("number"), "component_id")
    found = rows.select("number", F.col("row.doc_id").alias("id")).join(found, "number")
    found = materialize(found.select("component_id", F.col("id").isNull().alias("last"), "id", "number"), "pipeline-found")
    # joined by the rows' own numbers, as a group may hold very many of them
    first = found.groupBy("component_id").agg(F.min(F.struct("last", "id", "number")).alias("first")).select(F.col("first.number").alias("number"))
    copies = found.select("number").join(materialize(first, "pipeline-first"), "number", "left_anti")
    return rows.join(materialize(copies, "pipeline-copies"), "number", "left_anti").select("row.*")


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and terms that disclose them are replaced in every text.

    Null and empty texts stay as they are, long ones are searched whole, equal texts change alike, all columns stay whatever
    their names, and an empty table gives an empty one.
    """
    return pii.scrub(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own; null and empty texts have no words; rows with equal ids and sizes are taken alike;
    all columns stay whatever their names; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their count and digests; null texts count as empty, and long ones are read whole."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("personal data", remove_personal_data), ("mixing", mix_sources), ("encoding", encode)]
#: Training and set similarity have no SQL form; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
