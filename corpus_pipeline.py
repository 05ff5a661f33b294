"""A corpus pipeline from operators of ``millrace.llm``; part of that subpackage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last keep the columns of documents, and
extra ones whatever their names.

A document is a row's doc_id and text.  Null texts count as empty.  Rows without doc_id are
documents like others; of copies and near copies they stay only where no row has an id.  Rows
that repeat both doc_id and text are one document: kept or dropped alike, and mixed one by
one.  Texts of any length are taken whole.  An empty table passes every stage and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace
from millrace.llm import bpe, exact_dedup, mixing, simhash, toxicity
from millrace.llm.shared import materialise, table

#: The score's column on the way; no table has it.
SCORE = "_toxicity_of_the_text"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    millrace.ship(spark)
    return toxicity.score(docs, toxicity.trained(spark, docs, sf_dir), name=SCORE).where(F.col(SCORE) < 0.5).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    millrace.ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash the smallest doc_id."""
    millrace.ship(spark)
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    return mixing.mixed_texts(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    millrace.ship(spark)
    return bpe.encode(docs.select("doc_id", "source", "text"), bpe.rank_file()).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: Stages hold a learned lexicon, seeded fingerprints and BPE, which SQL cannot express.
ORACLE_SQL = None
