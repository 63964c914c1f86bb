"""Corpus preparation: five stages over `documents`, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what it returns as Parquet and gives the next
stage that table. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import drop_written, table, text_of, written
from auditloom.llm.exact_dedup import drop_exact
from auditloom.llm.jaccard_join import one_of_each
from auditloom.llm.packing import pack_documents
from auditloom.llm.quality import fit, scorer
from auditloom.llm.repeats import drop_repeats


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores at 0.5 or more; it learns from the dataset's documents and labels.

    Null texts are scored as empty; repeated rows share their fate.
    """
    net = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(scorer(spark, net)(text_of("text")) >= 0.5)


def keep_first_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside, null as empty) the row of the smallest id; rows that repeat it stay."""
    return drop_exact(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more) the row of the smallest id.

    Rows without an id, and texts without words, stay.
    """
    return one_of_each(docs, words=5, ratio=(80, 100))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that start earlier; rows of which nothing is left go, unless they were empty.

    Rows without an id stay as they are; n_chars follows the text.
    """
    return drop_repeats(docs, keep_emptied=False).withColumn("n_chars", F.length(text_of("text")).cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text goes in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_first_copy),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the tokenizer and the packing can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, of documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            drop_written(before)
        before = docs
    return docs
