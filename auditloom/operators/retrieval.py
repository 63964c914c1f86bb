"""Ranking operators: dense and sparse top-k, fusion and reranking. All are set at a time: (query_id, doc_id, score, rk)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import tokens

#: Query vectors, queries of terms, and documents in a block.
QUERY_BLOCK, TERM_BLOCK, DOC_BLOCK = 1024, 256, 2048


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with rk from 1; ranks by score and doc_id unless told otherwise."""
    if k < 1:
        raise ValueError("k must be at least 1")
    ranked = Window.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.col("doc_id"))))
    return scored.withColumn("rk", F.row_number().over(ranked)).where(F.col("rk") <= k)


def normalised_vector(v: Column) -> Column:
    """Unit norm; a zero vector stays."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def packed(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """The rows (key, value) in blocks of at most `size`: ids and values as arrays. Blocks are made within tasks, without a shuffle, and no row becomes a Python object."""
    kinds = f"ids array<{rows.schema[key].dataType.simpleString()}>, vals array<{rows.schema[value].dataType.simpleString()}>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, size) for at in range(0, batch.num_rows, size)):
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in part.columns], names=["ids", "vals"])

    return rows.where(F.col(key).isNotNull()).select(key, value).mapInArrow(pack, kinds)


def best_of_block(docs: np.ndarray, score: np.ndarray, k: int, edges: np.ndarray, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the k best documents of each row of a score matrix, rounded to 9 places: largest first, then the smaller id.

    Scores up to `least` don't count. edges: scores that k documents of each row reached before; those below don't count
    either, and what k documents reach here raises them.
    """
    if np.isnan(score.sum()):
        score = np.where(np.isnan(score), -np.inf, score)
    if score.shape[1] > k and np.isneginf(edges).any():
        np.maximum(edges, np.round(np.partition(score, score.shape[1] - k, axis=1)[:, -k], 9), out=edges)
    floor = edges - 1e-9 - 1e-12 * np.abs(edges)  # what rounding may lift to the edge
    flat = np.flatnonzero((score >= floor[:, None]) & (score > least))
    q, d = np.divmod(flat, score.shape[1])
    value = np.round(score.ravel()[flat], 9)
    keep = (value >= edges[q]) & (value > least)
    q, d, value = q[keep], d[keep], value[keep]
    order = np.lexsort((docs[d], -value, q))
    q, d, value = q[order], d[order], value[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    edges[q[place == k - 1]] = value[place == k - 1]
    return q[place < k], d[place < k], value[place < k]


#: From a pair of blocks (q_ids, q_vals, ids, vals) to a name for the query block, or none, and its parts: first row and scores.
BlockScore = Callable[[dict[str, pa.Array]], tuple[bytes | None, Iterator[tuple[int, np.ndarray]]]]


def block_topk(queries: DataFrame, corpus: DataFrame, score: BlockScore, k: int, kinds: str, least: float = -np.inf) -> DataFrame:
    """The k best of each query over all pairs of a query block and a corpus block; only what may be best becomes rows.

    Both are tables of blocks, so that nothing passes through the driver: Spark sends the query blocks to all tasks where
    they are few, and deals out the pairs where they are not. A worker holds one Arrow batch of pairs and one part's scores;
    of a query block that it meets again it knows the scores that k documents have reached.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[tuple[bytes, int], np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in ("q_ids", "q_vals", "ids", "vals")}
                docs = np.asarray(row["ids"].to_pylist())
                name, parts = score(row)
                for at, scores in parts:
                    edges = np.full(len(scores), -np.inf)
                    if name is not None:
                        edges = reached.setdefault((name, at), edges)
                    q, d, value = best_of_block(docs, scores, k, edges, least)
                    yield pa.RecordBatch.from_arrays([row["q_ids"].take(pa.array(q + at)), row["ids"].take(pa.array(d)), pa.array(value)], names=["query_id", "doc_id", "score"])

    # Query blocks stand in a shuffle, as each corpus partition reads them anew.
    own = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns)).hint("rebalance")
    return corpus.crossJoin(own).mapInArrow(best, kinds)


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of equal length as rows."""
    sizes = set(vectors.value_lengths().to_pylist())
    if len(sizes) != 1 or None in sizes:
        raise ValueError(f"vectors must have the same length: {sorted(map(str, sizes))}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), sizes.pop())


def dot_scores(row: dict[str, pa.Array], size: int = 128) -> tuple[bytes, Iterator[tuple[int, np.ndarray]]]:
    """Dot products of a pair of blocks of vectors, of `size` queries at a time."""
    own, other = matrix(row["q_vals"]), matrix(row["vals"]).T
    name = hashlib.md5(own.tobytes() + str(row["q_ids"].to_pylist()).encode(), usedforsecurity=False).digest()
    return name, ((at, own[at : at + size] @ other) for at in range(0, len(own), size))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, where: Column | None = None) -> DataFrame:
    """Exact nearest neighbours by dot product of (query_id, vector) in (doc_id, vector), rounded to 9 places. Ties go to the smaller doc_id."""
    if where is not None:
        corpus = corpus.where(where)
    if exclude_self:
        k += 1
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, score double"
    own = queries.select("query_id", "vector").hint("rebalance")  # so that blocks are full
    out = block_topk(packed(own, "query_id", "vector", QUERY_BLOCK), packed(corpus, "doc_id", "vector", DOC_BLOCK), dot_scores, k, kinds)
    return top_k(out.where("query_id <> doc_id"), k - 1) if exclude_self else top_k(out, k)


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, idf: bool = True, weighted: bool = False) -> DataFrame:
    """Sparse search of (query_id, text) in (doc_id, text); scores rounded to 9 places, ties to the smaller doc_id.

    Document frequencies are counted for the queries' terms alone. Blocks of queries are then held against blocks of
    documents as matrices of term weights, so that a common term costs no row for each query and document. A query
    without terms gives no rows. With `weighted`, a term counts as often as the query has it. Without `idf` all terms
    weigh the same.
    """
    terms = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    docs = corpus.select("doc_id", tokens(F.col("text")).alias("terms"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg_len"))
    known = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    df = known.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) if idf else F.lit(1.0)
    weight = (F.col("qtf") * weight if weighted else weight).cast("double")
    own = terms.join(df, "term").crossJoin(F.broadcast(stats)).groupBy("query_id").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("t"), F.first("avg_len").alias("avg_len"))
    own = packed(own.select("query_id", F.struct("t", "avg_len").alias("v")), "query_id", "v", TERM_BLOCK)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, score double"

    def score(row: dict[str, pa.Array]) -> tuple[None, Iterator[tuple[int, np.ndarray]]]:
        own = row["q_vals"].to_pylist()
        index: dict[str, int] = {}
        cells = [(i, index.setdefault(t["term"], len(index)), t["w"]) for i, q in enumerate(own) for t in q["t"]]
        weights = np.zeros((len(own), len(index)))
        for i, t, w in cells:
            weights[i, t] = w
        average, found = float(own[0]["avg_len"]), np.zeros((len(index), len(row["ids"])))
        for j, value in enumerate(row["vals"]):
            words = text.split(" ") if (text := value.as_py()) else []
            at, tf = np.unique([index[w] for w in words if w in index], return_counts=True)
            if len(at):
                found[at.astype(np.int64), j] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / average))
        return None, iter([(0, weights @ found)])

    texts = packed(docs.select("doc_id", F.array_join("terms", " ").alias("v")), "doc_id", "v", DOC_BLOCK)
    return top_k(block_topk(own, texts, score, k, kinds, least=0.0), k)


def rrf(ranked: DataFrame, k: int = 60, weights: dict | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_id, pos, doc_id): score is the sum of weight / (k + rank).

    Of a document that stands twice in a list only its best place counts, and its other places keep their ranks. A
    list without a weight has weight 1. Order is by score, then doc_id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    best = ranked.groupBy("query_id", "list_id", "doc_id").agg(F.min("pos").alias("rank"))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("list_id") == name, F.lit(float(value))).otherwise(weight)
    fused = best.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rk", F.row_number().over(order))


def dedupe_ranked(ranked: DataFrame) -> DataFrame:
    """First occurrence of each document in (query_id, pos, doc_id), ranked anew from 1."""
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"))
    return best.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))


def rerank(pool: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best of a pool (query_id, doc_id, rk, ...) by a new score; ties keep the pool's order."""
    return top_k(pool.withColumn("first_rk", F.col("rk")).withColumn("score", score), k, F.desc("score"), F.col("first_rk"))


def two_stage(first: Callable[[int], DataFrame], score: Column, k: int, pool: int = 25) -> DataFrame:
    """A cheap search for max(k, pool) candidates, then the dear scorer on those alone."""
    return rerank(first(max(k, pool)), score, k)
