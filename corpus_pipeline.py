"""A training corpus from `documents`: each stage reads what the one before it kept.

toxicity        documents whose noisy-or of sentence scores reaches 0.5 go
near_copies     of the documents that link by 5-word shingles (Jaccard of 0.75 or more, directly or through others) the one of the smallest id stays
substrings      passages that an earlier document keeps are cut from the text; n_chars follows
decontamination documents that hold a window of a benchmark item go
packing         power-of-two pieces of the token ids, one row for each

Every stage reads whole tables and texts; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rangeweave.llm import decontaminate, ngram_join, packing, substrings, toxicity as toxic
from rangeweave.llm.common import fresh, materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(fresh(docs, "cut_bytes")) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("substrings", substring_dedup), ("decontamination", decontamination), ("packing", pack)]
#: The classifier, the chunking and the tokenizer have no SQL.  Tests hold near copies, decontamination and packing against plain Python, substrings against a search for words, and toxicity against the model's own sentences, with held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
