"""From raw documents to packed training sequences: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet to the shared folder and rereads it as the
next stage's documents. All but the last keep the columns of `documents`. Labels come from sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclog.llm import packing, quality, simhash, suffixes, toxicity
from doclog.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more."""
    return docs.filter(quality.scored(quality.train(docs, table(spark, sf_dir, "labels"))) >= quality.THRESHOLD)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    return docs.filter(toxicity.scored(toxicity.train(docs, table(spark, sf_dir, "labels"))) < 0.5)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (0.8 of their five-word shingles alike): the first with the smallest id."""
    return simhash.keep_one(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages, of 400 bytes or of over 50 words; n_chars follows the text."""
    found = suffixes.dedup_texts(docs, words=suffixes.WORDS)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and the sequences that hold them."""
    # after four other stages an executor's heap is full-grown: workers keep less here than where packing runs alone
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), chunks=150_000, characters=1 << 20)
    digests = pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return packing.pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("simhash", no_near_copies),
    ("suffixes", no_repeated_passages),
    ("packing", packed),
]

#: SQL can't express the classifiers or the search for bins; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
