"""Retrieval metrics of ranked lists (query_id, rk, doc_id) against grades (query_id, doc_id, grade), for all queries at once.

Binary metrics take grade 2 (primary) alone; graded ones take all grades above 0. Every query of `queries` gets a value,
0 where it has no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIMARY = 2


def graded(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """The ranked rows with their grade, 0 where there is none."""
    return ranked.join(gold.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def grade_counts(gold: DataFrame) -> DataFrame:
    """(query_id, grade, n)."""
    return gold.groupBy("query_id", "grade").agg(F.count("*").alias("n"))


def ideal_dcg(counts: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, idcg) of grade counts: the first places of the best ranking, however many rows have a grade."""
    order = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)
    best = counts.where("grade > 0 AND n > 0").withColumn("upto", F.sum("n").over(order)).withColumn("begin", F.col("upto") - F.col("n")).where(F.col("begin") < max(ks))
    best = best.withColumn("at", F.explode(F.sequence(F.col("begin") + 1, F.least("upto", F.lit(max(ks)).cast("long")))))
    best = best.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("at <= k")
    return best.groupBy("query_id", "k").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("at") + 1.0)).alias("idcg"))


def metrics_at(queries: DataFrame, ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, k and hit_rate, recall, precision, mrr, ap, dcg, ndcg, context_precision of the first k places, for every k from one pass over the ranking."""
    return metrics_of(queries, graded(ranked.where(F.col("rk") <= max(ks)), gold), grade_counts(gold), ks)


def metrics_of(queries: DataFrame, hits: DataFrame, counts: DataFrame, ks: list[int]) -> DataFrame:
    """The same of a ranking with grades (query_id, rk, grade) and the counts of all grades, where grades follow from a rule and need no row for each query and document."""
    if min(ks) < 1:
        raise ValueError("k must be at least 1")
    hits = hits.where(F.col("rk") <= max(ks))
    seen = Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    primary = (F.col("grade") == PRIMARY).cast("int")
    hits = hits.withColumn("primary", primary).withColumn("so_far", F.sum("primary").over(seen))
    each = F.explode(F.array(*map(F.lit, ks)))
    per = hits.withColumn("k", each).where("rk <= k").groupBy("query_id", "k").agg(
        F.sum("primary").alias("found"),
        F.min(F.when(F.col("primary") == 1, F.col("rk"))).alias("first"),
        F.sum(F.when(F.col("primary") == 1, F.col("so_far") / F.col("rk")).otherwise(0.0)).alias("precisions"),
        F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rk") + 1.0)).alias("dcg"),
        F.sum((F.col("grade") > 0).cast("int")).alias("relevant"),
    )
    labels = counts.groupBy("query_id").agg(F.sum(F.when(F.col("grade") == PRIMARY, F.col("n")).otherwise(0)).alias("n_primary"))
    rows = queries.select("query_id", each.alias("k")).join(per, ["query_id", "k"], "left").join(labels, "query_id", "left").join(ideal_dcg(counts, ks), ["query_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    has = F.coalesce("n_primary", F.lit(0)) > 0
    return rows.select(
        "query_id",
        "k",
        F.when(has & (F.coalesce("found", F.lit(0)) > 0), 1.0).otherwise(0.0).alias("hit_rate"),
        zero(F.try_divide("found", "n_primary")).alias("recall"),
        zero(F.col("found") / F.col("k")).alias("precision"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.try_divide("precisions", "n_primary")).alias("ap"),
        zero(F.col("dcg")).alias("dcg"),
        zero(F.try_divide("dcg", "idcg")).alias("ndcg"),
        zero(F.col("relevant") / F.col("k")).alias("context_precision"),
    )


def metrics_at_k(queries: DataFrame, ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """The same for one k, without its column."""
    return metrics_at(queries, ranked, gold, [k]).drop("k")


METRICS = ["hit_rate", "recall", "precision", "mrr", "ap", "dcg", "ndcg", "context_precision"]


def long_form(wide: DataFrame, *keys: str, metrics: list[str] = METRICS) -> DataFrame:
    """One row for each metric: keys, metric, value."""
    return wide.unpivot(list(keys), metrics, "metric", "value")


def macro_average(long: DataFrame, *keys: str) -> DataFrame:
    """Mean, population deviation, smallest, largest and count of each metric; an empty group has zeros."""
    return long.groupBy(*keys).agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"),
        F.coalesce(F.min("value"), F.lit(0.0)).alias("low"), F.coalesce(F.max("value"), F.lit(0.0)).alias("high"), F.count("value").alias("n"),
    )


def within_budget(ranked: DataFrame, cost: DataFrame, budget: int) -> DataFrame:
    """The ranked rows before the first whose running cost (doc_id, n_words) exceeds the budget; unknown documents cost 0."""
    upto = Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.join(cost.select("doc_id", "n_words"), "doc_id", "left").withColumn("cost", F.coalesce("n_words", F.lit(0)))
    return rows.withColumn("spent", F.sum("cost").over(upto)).where(F.col("spent") <= budget).drop("n_words")


def budget_recalls(queries: DataFrame, ranked: DataFrame, cost: DataFrame, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """query_id, budget and the share of the query's primary labels found within that many words, for every budget from one pass."""
    return budget_recalls_of(queries, graded(ranked, gold.where(F.col("grade") == PRIMARY).dropDuplicates(["query_id", "doc_id"])), cost, grade_counts(gold), budgets)


def budget_recalls_of(queries: DataFrame, hits: DataFrame, cost: DataFrame, counts: DataFrame, budgets: list[int]) -> DataFrame:
    """The same of a ranking with grades (query_id, rk, doc_id, grade) and the counts of all grades."""
    each = F.explode(F.array(*map(F.lit, budgets)))
    spent = within_budget(hits, cost, max(budgets)).where(F.col("grade") == PRIMARY).groupBy("query_id", "doc_id").agg(F.min("spent").alias("spent"))
    found = spent.withColumn("budget", each).where("spent <= budget").groupBy("query_id", "budget").agg(F.count("*").alias("found"))
    labels = counts.where(F.col("grade") == PRIMARY).select("query_id", F.col("n").alias("labels"))
    rows = queries.select("query_id", each.alias("budget")).join(labels, "query_id", "left").join(found, ["query_id", "budget"], "left")
    return rows.select("query_id", "budget", F.coalesce(F.try_divide("found", "labels"), F.lit(0.0)).alias("recall"))


def budget_recall(queries: DataFrame, ranked: DataFrame, cost: DataFrame, gold: DataFrame, budget: int) -> DataFrame:
    """The same for one budget, without its column."""
    return budget_recalls(queries, ranked, cost, gold, [budget]).drop("budget")


def context_words(ranked: DataFrame, cost: DataFrame, k: int) -> DataFrame:
    """query_id, documents and their words among the first k places."""
    rows = ranked.where(F.col("rk") <= k).select("query_id", "doc_id").distinct().join(cost.select("doc_id", "n_words"), "doc_id", "left")
    return rows.groupBy("query_id").agg(F.count("*").alias("returned"), F.coalesce(F.sum("n_words"), F.lit(0)).cast("long").alias("context_words"))


def delta_percent(after, before):
    """Change against a base in percent; null where the base is missing or 0."""
    return F.when(F.coalesce(before, F.lit(0.0)) != 0, 100 * (after - before) / before)
