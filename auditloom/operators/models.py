"""Encoders and pair scorers as operators. A model is a function that each Python worker makes once; none is bundled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.retrieval import rerank

#: Makes an encoder: a function from texts to a matrix with a row for each.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]
#: Makes a pair scorer: a function from queries and texts to a score for each pair.
PairScorer = Callable[[], Callable[[list[str], list[str]], np.ndarray]]


def embedding(encoder: Encoder, prefix: str = "", batch: int = 64):
    """A function of a text column: its vector with unit norm (a zero vector stays). Queries may have an instruction as prefix, documents none."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            own, parts = [prefix + (t or "") for t in texts], []
            for at in range(0, len(own), batch):
                v = np.asarray(encode(own[at : at + batch]), dtype=np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                parts.append(v / np.where(norm == 0, 1, norm))
            yield pd.Series([row for p in parts for row in p], dtype=object)

    return embed


def pair_score(scorer: PairScorer, batch: int = 64):
    """A function of query and text columns: the pair scorer's score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rate = scorer()
        for queries, texts in batches:
            q, t = [x or "" for x in queries], [x or "" for x in texts]
            yield pd.Series(np.concatenate([np.asarray(rate(q[a : a + batch], t[a : a + batch]), dtype=np.float64) for a in range(0, len(q), batch)] or [np.empty(0)]))

    return score


def reranked(pool: DataFrame, scorer: PairScorer, query: str, text: str, k: int) -> DataFrame:
    """The k best of a pool (query_id, doc_id, rk, query, text) by a pair scorer; ties keep the pool's order."""
    scored = pool.withColumn("pair", F.round(pair_score(scorer)(F.col(query), F.col(text)), 9))
    return rerank(scored, F.col("pair"), k)


def input_window(encode: Callable[[list[str]], np.ndarray], sample: str, most: int = 2048, same: float = 0.99999) -> int:
    """The fewest words of a sample whose vector is that of the whole: what an encoder reads. A binary search over prefixes."""
    words = sample.split()[:most]
    if not words:
        return 0
    vector = lambda n: np.asarray(encode([" ".join(words[:n])]), dtype=np.float64)[0]
    whole = vector(len(words))

    def alike(n: int) -> bool:
        v = vector(n)
        norm = np.linalg.norm(v) * np.linalg.norm(whole)
        return bool(norm) and float(v @ whole) / norm > same

    low, high = 1, len(words)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if alike(mid) else (mid + 1, high)
    return low


def window_words(encoder: Encoder, most: int = 2048):
    """The input window as a function of a column of samples."""

    @F.pandas_udf("long")
    def window(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for samples in batches:
            yield pd.Series([input_window(encode, s or "", most) for s in samples])

    return window


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
