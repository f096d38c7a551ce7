"""Corpus pipeline: quality, line deduplication, near-duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, which has the columns of documents; all but the
last return those columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, lines, neardup, quality
from tidemark.llm.storage import settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned on the given tables, finds good: probability 0.5 or more. Null and empty
    texts get the model's bias and go or stay together; equal texts get equal scores; rows without an id are scored too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(labelled, labels, "quality", ~quality.held_out(F.col("doc_id"), 4, 2))
    score = "_" * max(map(len, docs.columns), default=0) + "score"  # no column has this name
    return quality.score(docs, model, out=score).where(F.col(score) >= 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier like line makes superfluous; documents that lose every line go. Null and empty texts
    and rows without an id stay as they are. n_chars, where there is one, is counted anew."""
    out = lines.dedup_lines(docs).where("n_removed < n_lines or n_lines = 0")
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 in shingles of five words, the document with the smallest id. Null, empty
    and blank texts are linked with nothing and stay, as do rows without an id; rows that share an id stay or go together."""
    groups = neardup.near_duplicates(docs)
    gone = settle(groups.where("not kept").select(F.col("id").alias("doc_id")).distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage like an item of the benchmark. Null and empty texts and rows without an id stay; rows
    that share an id go together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens: the token ids of each text, none of a null or empty one; one row for each row."""
    out = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("byte_bpe", encode),
]

#: The classifier's weights and the tokenizer's merges can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the whole documents table; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
