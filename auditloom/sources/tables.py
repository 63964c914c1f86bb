"""Readers: JSON lines with a fixed schema, page tables, indexed collections, and caches by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.text import looks_like_front_matter

CLAUSE = "clause_id string, kind string, path string, text string, page_start int, page_end int, chapter string, chapter_title string, article int, article_title string, annex string, annex_title string, part string, section string, paragraph string, n_words int, text_sha1 string"
PASSAGE = "passage_id string, section string, section_title string, text string, page_start int, page_end int, n_words int, part int, n_parts int, text_sha1 string"
GOLD = "passage_id string, section string, section_title string, labels map<string,int>, provenance map<string,array<string>>, n_primary int, n_total int"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, broken ones stop the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, or no rows where nothing is at the path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)


def gold_labels(gold: DataFrame) -> DataFrame:
    """(query_id, scope, grade) of the label maps."""
    return gold.select(F.col("passage_id").alias("query_id"), F.explode("labels").alias("scope", "grade"))


def document_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the texts of pages (key, page, text) joined by line ends in page order."""
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("_p"))
    return rows.select(key, F.array_join(F.transform("_p", lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"))


def content_pages(pages: DataFrame, key: str = "doc_id", most: int = 2, skip_front_matter: bool = True) -> tuple[DataFrame, DataFrame]:
    """The first `most` pages with content, and the numbers of front-matter pages skipped before the last of them."""
    front = looks_like_front_matter(F.col("text")) if skip_front_matter else F.trim(F.coalesce("text", F.lit(""))) == ""
    rows = pages.withColumn("_front", front)
    kept = rows.where(~F.col("_front")).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("page"))).where(F.col("_n") <= most)
    last = kept.groupBy(F.col(key).alias("_k")).agg(F.when(F.count("*") >= most, F.max("page")).alias("_last"))
    skipped = rows.where("_front").join(last, F.col(key) == F.col("_k"), "left").where(F.col("_last").isNull() | (F.col("page") < F.col("_last")))
    return kept.drop("_front", "_n"), skipped.select(key, "page")


def missing_keys(wanted: DataFrame, cached: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key a cache does not have yet."""
    return wanted.join(cached.select(*keys).distinct(), list(keys), "left_anti")
