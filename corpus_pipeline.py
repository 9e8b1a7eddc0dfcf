"""The corpus pipeline: documents to packed training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm._common import prepare, renamed, table
from grainsift.llm.automaton import remove_shared
from grainsift.llm.kneser_ney import drop_low_quality
from grainsift.llm.mixing import mix_sources
from grainsift.llm.packing import pack
from grainsift.llm.simhash_trie import drop_near_copies
from grainsift.sources.index import Files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go: a perplexity above the threshold of the
    row's language, or no token at all (null, empty and blank texts). A null language
    is a language of its own; rows of a language without trusted texts stay. Repeated
    rows fare alike, null ids are judged by their text; without labels nothing with
    tokens goes. Extra columns, whatever their names, are kept. Empty stays empty."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id,
    of several texts under one id the least text. Rows with a null id, and texts that
    are null or hold no word, have no copies and stay. Extra columns, whatever their
    names, are kept. Empty stays empty."""
    return drop_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 50 or more that a document with a smaller doc_id holds go, from
    texts of any length; ``n_chars`` follows the text (0 where nothing is left, null
    for null). Rows with equal ids aren't matched with each other, null ids with
    none; null and short texts stay as they are. Extra columns, whatever their names,
    are kept. Empty stays empty."""
    inner, at = renamed(remove_shared(docs))
    return inner.withColumn(at["n_chars"], F.length(at["text"]).cast("long")).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks, each at least once: the budget
    is the least that cuts no source below one epoch. A null source is a source; null
    texts and those without tokens cost nothing and come along; rows with equal ids
    (null ones too) are drawn together. Rows come in the order of the scan: packing
    spreads documents by hash, so the order of the permutation is of no use to it.
    Extra columns, whatever their names, are kept. Empty stays empty."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins, ``(doc_id, copy, piece, start, tokens, bin_id)``.
    ``copy`` numbers rows with equal ids and lengths, null ids too; long texts are
    several pieces; null texts and those without tokens are one row without a bin.
    Ties go to the bin opened first. Extra columns play no part. Empty gives none."""
    return pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("substrings", substrings), ("mixture", mixture), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages a table is written to the shared
    folder, so that lineage is cut and the next one reads just the columns it needs;
    it goes once the next one is written (the last is read by the result)."""
    prepare(spark)
    folder, files = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}", Files(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.remove(before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
