"""The corpus pipeline: quality, exact, near and substring deduplication, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.llm.exact import exact_dedup
from streamcheck.llm.minhash import near_dedup, text_hash
from streamcheck.llm.pack import pack
from streamcheck.llm.quality import keep_good
from streamcheck.llm.shared import Scratch, free_names, table
from streamcheck.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer rejects go, and those without a word (null, empty or blank text).

    Rows that repeat a text share its fate.
    """
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the one of the largest id stays; rows that repeat id and text become one."""
    key, print_ = free_names(docs, "key", "sha")
    found = Scratch(spark, "stage-exact").write(exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "decided")
    dropped = found.where("not kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(print_))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    left = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(key)) & (sha == F.col(print_)), "left_anti")
    if found.where("kept and n > 1").isEmpty():
        return left
    return left.withColumn(print_, sha).dropDuplicates(["doc_id", print_]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; rows without an id stay.

    Rows that repeat an id with other texts are documents of their own: what goes is told by id and text.
    """
    key, print_ = free_names(docs, "key", "fp")
    dropped = near_dedup(docs, text_fp=True).where("doc_id is not null and not kept").select(F.col("doc_id").alias(key), F.col("text_fp").alias(print_)).distinct()
    return docs.join(dropped, (F.col("doc_id") == F.col(key)) & (text_hash("text") == F.col(print_)), "left_anti")


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word passages that an earlier document has go; n_chars follows the text.

    Null text stays null; rows of one id take nothing from each other; a row without an id stays whole.
    """
    return remove_repeats(docs, keep_text=True).withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.lit(0))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; null text is empty, repeated rows are packed each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substring), ("packing", packing)]

#: The classifier and the sequences are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written.write(stage(spark, docs, sf_dir), name)
        if k > 1:
            written.drop(STAGES[k - 2][0])
    return docs
