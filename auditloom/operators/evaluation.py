"""Bookkeeping of evaluations: chunk hits as clauses, replays of stored results, repeats, latencies and corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clause_hits(hits: DataFrame, coverage: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, rk, clause_id): the clauses that each hit chunk covers, in the order of chunk rank and position.

    hits: (query_id, rk, chunk); coverage: (chunk, clause_id, start). With k, a clause counts once and only the first k stay;
    without, repeats stay, as chunks overlap: see clause_counts() where only their number is asked for.
    """
    covered = coverage.select("chunk", "clause_id", "start")
    if k is not None:
        # The first k of a list are among the first k of each chunk: what goes before a chunk's clause there goes before it in any list.
        first = F.row_number().over(Window.partitionBy("chunk").orderBy("start", "clause_id"))
        covered = covered.groupBy("chunk", "clause_id").agg(F.min("start").alias("start")).withColumn("_n", first).where(F.col("_n") <= k).drop("_n")
    rows = hits.withColumnRenamed("rk", "chunk_rk").join(covered, "chunk")
    order = Window.partitionBy("query_id").orderBy("chunk_rk", "start", "clause_id")
    if k is None:
        return rows.withColumn("rk", F.row_number().over(order)).select("query_id", "rk", "clause_id")
    first = F.row_number().over(Window.partitionBy("query_id", "clause_id").orderBy("chunk_rk", "start"))
    rows = rows.withColumn("_n", first).where("_n = 1").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
    return rows.select("query_id", "rk", "clause_id")


def clause_counts(hits: DataFrame, coverage: DataFrame) -> DataFrame:
    """(query_id, n, own): how many clauses the hit chunks of each query cover, with repeats and without; queries without any have no row.

    The clauses themselves meet no query: those that stand in the same chunks are counted together first.
    """
    chunks = coverage.groupBy("chunk").agg(F.count("*").alias("n"))
    sets = coverage.where("clause_id IS NOT NULL AND chunk IS NOT NULL").groupBy("clause_id").agg(F.array_sort(F.collect_set("chunk")).alias("_set"))
    sets = sets.groupBy("_set").agg(F.count("*").alias("_n")).select("_set", "_n", F.explode("_set").alias("chunk"))
    listed = hits.select("query_id", "chunk").join(chunks, "chunk").groupBy(F.col("query_id").alias("_q")).agg(F.sum("n").alias("n"))
    own = hits.select("query_id", "chunk").distinct().join(sets, "chunk").select("query_id", "_set", "_n").distinct().groupBy("query_id").agg(F.sum("_n").alias("own"))
    return listed.join(own, F.col("_q").eqNullSafe(F.col("query_id")), "left").select(F.col("_q").alias("query_id"), "n", F.coalesce("own", F.lit(0)).alias("own"))


def context_so_far(hits: DataFrame, total: int | Column, size: int = 800, stride: int = 700) -> DataFrame:
    """The hits (query_id, rk, chunk) with the words shown up to each; the last chunk ends with the document."""
    width = F.greatest(F.lit(0), F.least(F.col("chunk") * stride + size, F.lit(total) if isinstance(total, int) else total) - F.col("chunk") * stride)
    upto = Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("words_so_far", F.sum(width).over(upto))


def arm_union(*arms: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each key of several arms with the same columns, that of the latest arm."""
    rows = arms[0].withColumn("_arm", F.lit(0))
    for n, arm in enumerate(arms[1:], 1):
        rows = rows.unionByName(arm.withColumn("_arm", F.lit(n)))
    last = Window.partitionBy(key).orderBy(F.desc("_arm"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_arm")


def replayed(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """The stored ranking (query_id, rk, doc_id) of each query, first k; a query that is not stored has none."""
    return queries.select("query_id").join(stored.where(F.col("rk") <= k), "query_id")


def repeat_summary(runs: DataFrame, *metrics: str) -> DataFrame:
    """(config, metric, mean, low, high) over repeated runs, the mean to 4 places."""
    long = runs.unpivot(["config", "run"], list(metrics), "metric", "value")
    return long.groupBy("config", "metric").agg(F.bround(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def contaminated(runs: DataFrame) -> DataFrame:
    """(config, runs, contaminated): runs in which a judge failed open or a passage failed."""
    bad = (F.coalesce("judge_errors", F.lit(0)) > 0) | (F.coalesce("errors", F.lit(0)) > 0)
    return runs.groupBy("config").agg(F.count("*").alias("runs"), F.sum(bad.cast("long")).alias("contaminated"))


def with_detail(runs: DataFrame, *detail: str) -> DataFrame:
    """Runs of which only each configuration's first keeps its detail."""
    first = F.row_number().over(Window.partitionBy("config").orderBy("run")) == 1
    return runs.withColumn("_first", first).withColumns({c: F.when(F.col("_first"), F.col(c)) for c in detail}).drop("_first")


def latency(rows: DataFrame, key: str, ms: str = "ms") -> DataFrame:
    """Mean, median and 95th percentile in milliseconds."""
    return rows.groupBy(key).agg(F.round(F.avg(ms), 6).alias("mean_ms"), F.round(F.percentile(ms, F.lit(0.5)), 6).alias("p50_ms"), F.round(F.percentile(ms, F.lit(0.95)), 6).alias("p95_ms"), F.count("*").alias("n"))


def corpus_stats(corpus: DataFrame, kind: str, words: str = "n_words") -> DataFrame:
    """(kind, n, total_words, mean_words): mean rounded down."""
    return corpus.groupBy(kind).agg(F.count("*").alias("n"), F.sum(words).cast("long").alias("total_words"), F.floor(F.sum(words) / F.count("*")).alias("mean_words"))


def chosen_clauses(choices: DataFrame, clauses: DataFrame, most: int = 45, instruments: int = 3) -> DataFrame:
    """(passage_id, place, clause_id): the clauses of a passage's first few chosen instruments, by choice and then corpus order, at most `most`.

    choices: (passage_id, choice_no, instrument); clauses: (instrument, ord, clause_id). The limits are what a prompt can show.
    """
    picked = choices.withColumn("_n", F.row_number().over(Window.partitionBy("passage_id").orderBy("choice_no"))).where(F.col("_n") <= instruments).drop("_n")
    # An instrument shows at most its first clauses, whatever else is chosen.
    shown = clauses.withColumn("_n", F.row_number().over(Window.partitionBy("instrument").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")
    rows = picked.join(shown, "instrument")
    place = F.row_number().over(Window.partitionBy("passage_id").orderBy("choice_no", "ord"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("passage_id", "place", "clause_id")


def offered_only(proposals: DataFrame, offered: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` proposals (passage_id, proposal_no, key) of each passage that were offered to it, or to all where there is no passage_id; a repeat counts once."""
    rows = proposals.join(offered, [c for c in ("passage_id", key) if c in offered.columns], "left_semi")
    rows = rows.groupBy("passage_id", key).agg(F.min("proposal_no").alias("proposal_no"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("passage_id").orderBy("proposal_no"))).where(F.col("place") <= most)


def two_stages(passages: DataFrame, catalogue: DataFrame, clauses: DataFrame, ask_instruments, ask_clauses) -> DataFrame:
    """(passage_id, place, clause_id): clauses proposed in two stages over the whole enumeration.

    The first model call chooses at most 3 instruments of the catalogue, the second at most 5 clauses of theirs. Both are
    functions from a table of offers (passage_id, text, ...) to proposals; ids that were not offered are dropped.
    """
    offers = passages.select("passage_id", "text").join(catalogue.agg(F.array_sort(F.collect_list(F.struct("place", "instrument", "title"))).alias("catalogue")))
    proposed = ask_instruments(offers).join(passages.select("passage_id"), "passage_id", "left_semi")
    chosen = offered_only(proposed, catalogue.select("instrument"), "instrument", 3)
    shown = chosen_clauses(chosen.withColumnRenamed("place", "choice_no"), clauses)
    blocks = shown.join(clauses.select("clause_id", F.col("text").alias("clause_text")), "clause_id").groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("place", "clause_id", "clause_text"))).alias("blocks"))
    return offered_only(ask_clauses(passages.select("passage_id", "text").join(blocks, "passage_id")), shown, "clause_id", 5).select("passage_id", "place", "clause_id")
