"""A training corpus from `documents`: quality rules, near-duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import neardup, packing, quality, secrets, suffixes
from framelake.llm.registry import tokenizer
from framelake.llm.shared import lookup_side, scratch, settled
from framelake.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted by lines frequent on their host.

    Null and empty texts fail the base rules and go; a null source is a host of its own; repeated rows are judged
    alike and all stay or go; texts of any length are read whole; an empty table stays empty; only the columns of
    documents are kept.
    """
    return quality.quality_rules(docs).where("kept").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the smallest doc_id, once if its row repeats.

    Texts without words are like nothing and stay, as do rows without a doc_id; an empty table stays empty.
    """
    gone = settled(spark, lambda: neardup.near_duplicates(docs, percent=80, k=5).where("not kept").select("doc_id").distinct())
    kept = docs.join(lookup_side(gone), "doc_id", "left_anti")
    twice = docs.groupBy("doc_id").count().where("count > 1").head(1)
    return (kept.dropDuplicates(["doc_id", "text"]) if twice else kept).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 400-byte strings, and without passages of over 50 words of any length, that also start elsewhere; documents with nothing left go, null and empty texts with them.

    Repeated rows of 400 bytes or of 51 words or more remove each other's text; n_chars follows the text; an empty table stays empty.
    """
    out = suffixes.remove_repeats(docs, length=400, words=51)
    return out.where(F.length(F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))) > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; all documents stay, null texts as null, repeated rows alike; an empty table stays empty."""
    return secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens, neighbours along the curve together.

    A null or empty text is its end token alone; repeated rows are packed each; ties along the curve go by doc_id; an
    empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_each_group),
    ("repeated passages", without_repeats),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The near-duplicate, suffix and packing stages have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written in the shared folder and read again as the next one's."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        at = f"{scratch(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
