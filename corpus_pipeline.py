"""Training-data pipeline over ``documents``: each stage works on all that the stage before it kept.

quality (rejects toxic and low-quality documents), exact (one of each group of equal texts stays), near (one
of each group of similar texts stays), repeats (passages that occur elsewhere are cut), pack (windows of
2048 tokens). All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import ship
from lattica.llm.common import stage as staged
from lattica.llm.common import table
from lattica.llm.exact_dedup import exact_dedup
from lattica.llm.near_dedup import near_dedup
from lattica.llm.ordinal import grade_documents
from lattica.llm.packing import pack_documents
from lattica.llm.suffix_dedup import remove_repeats

#: Bytes of a string that repeats; and words, of which more than fifty count in fewer bytes too.
REPEAT_BYTES, REPEAT_WORDS = 256, 51
WINDOW, END_ID = 2048, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 7) expects to be of the highest grade more likely than not."""
    ship(spark)
    return grade_documents(docs, table(spark, sf_dir, "labels")).filter("selected").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (operator 8) the one with the largest id."""
    ship(spark)
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that operator 9 links: by fingerprints at two bits or fewer, found by its index
    over byte positions, and, as these miss most pairs at 0.8, by five-word shingles similar by 0.8."""
    ship(spark)
    return near_dedup(docs, words=5, similarity=0.8, bits=2).filter("kept").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur elsewhere (operator 10); n_chars counts what is left."""
    ship(spark)
    cut = remove_repeats(docs, REPEAT_BYTES, repair=True, words=REPEAT_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in windows (operator 3)."""
    ship(spark)
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), WINDOW, END_ID)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("repeats", repeats), ("pack", pack)]
#: SQL has neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = staged(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
