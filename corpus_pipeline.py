"""From raw documents to packed training sequences, each stage by one of the training-data operators.

Every stage works on all rows that its predecessor kept; its result is written as Parquet and read again. All but the
last return the columns of documents. Defined cases are those of the operators; a document whose language is ``und``
(null, empty or without a letter) goes in the first stage, so later stages see text. A null lang is filled there with the
predicted one, by which the mixing tree sorts it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import exact_dedup, jaccard, langid, mixing, packing
from umbra.llm.runtime import Scratch, documents, remainder

#: Names of columns that no table of documents has.
PREDICTED, SURE = "umbra_language", "umbra_certainty"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is recognised, which stands for a missing lang.

    With no labelled row there is no language to tell: all documents with a letter stay.
    """
    model = langid.fit(docs, F.coalesce(remainder("doc_id", 3) != 1, F.lit(True)))
    if model is None:
        return langid.lettered(docs)
    found = langid.identify(docs, model, (PREDICTED, SURE)).where(F.col(PREDICTED) != "und")
    return found.withColumn("lang", F.coalesce("lang", PREDICTED)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts, that of the smallest doc_id."""
    return exact_dedup.duplicates_dropped(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard.near_duplicates_dropped(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes nine tenths of the tokens by the tree's weights, whole documents in a seeded order."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language id", language), ("exact dedup", exact), ("near duplicates", near), ("mixing", mixture), ("packing", pack)]

#: Tokenizing and classifying can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return scratch.finish(docs)
