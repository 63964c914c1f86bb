"""Hierarchical scopes: dotted keys, their ancestors, and joins on them without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(key: Column) -> Column:
    """A dotted key and all its prefixes that end before a dot: the scopes that it lies within."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def is_within(key: Column, scope: Column) -> Column:
    return (key == scope) | F.startswith(key, F.concat(scope, F.lit(".")))


def scope_join(left: DataFrame, key: str, scopes: DataFrame, scope: str) -> DataFrame:
    """Rows of `left` with those of `scopes` that their key lies within: an equi-join on exploded ancestors."""
    return left.withColumn("_scope", F.explode(ancestors(F.col(key)))).join(scopes, F.col("_scope") == F.col(scope)).drop("_scope")


def expand_labels(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of every corpus row within a label's scope; the higher grade wins."""
    hit = scope_join(corpus.select("doc_id"), "doc_id", labels.select("query_id", "scope", "grade"), "scope")
    return hit.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def label_counts(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, grade, n, first): how many corpus keys expand_labels() gives each query, and the first of them.

    Keys whose innermost label scope is the same are counted together before they meet a query.
    """
    depth = F.size(F.split("scope", r"\."))
    own = corpus.select("doc_id", F.explode(ancestors(F.col("doc_id"))).alias("scope")).join(labels.select("scope").distinct(), "scope", "left_semi")
    inner = own.groupBy("doc_id").agg(F.max_by("scope", depth).alias("_inner")).groupBy("_inner").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    hit = scope_join(inner, "_inner", labels.select("query_id", "scope", "grade"), "scope").groupBy("query_id", "_inner").agg(F.max("grade").alias("grade"), F.first("n").alias("n"), F.first("first").alias("first"))
    return hit.groupBy("query_id", "grade").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def scope_recall(queries: DataFrame, ranked: DataFrame, scopes: DataFrame, k: int) -> DataFrame:
    """query_id and the share of its primary scopes with a document among the first k."""
    own = scopes.where("grade = 2").select(F.col("query_id").alias("_q"), "scope").distinct()
    hit = ranked.where(F.col("rk") <= k).withColumn("_scope", F.explode(ancestors(F.col("doc_id"))))
    hit = hit.join(own, (F.col("query_id") == F.col("_q")) & (F.col("_scope") == F.col("scope"))).groupBy("query_id").agg(F.countDistinct("scope").alias("hit"))
    n = own.groupBy(F.col("_q").alias("query_id")).agg(F.count("*").alias("n"))
    rows = queries.select("query_id").join(n, "query_id", "left").join(hit, "query_id", "left")
    return rows.select("query_id", F.coalesce(F.try_divide("hit", "n"), F.lit(0.0)).alias("scope_recall"))
