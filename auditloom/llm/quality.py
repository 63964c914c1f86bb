"""A byte-level convolutional network in numpy that tells documents worth keeping from junk."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, small_batches, text_of


@dataclass
class ByteConvNet:
    """Filters over `width` bytes, every `stride` bytes; per document the largest and the mean response; one probability.

    A byte has a learned vector for each place in the filter, so that a response is the sum of `width` table rows: table
    has the shape (width, 256, filters). The mean response is over chunks of the whole document, each chunk max-pooled.
    Chunks overlap by width - stride bytes. The output layer sees, for each filter, the largest response of the
    document and the mean of the chunks' largest.
    """

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    stride: int = 4
    chunk: int = 64

    def pooled(self, text: bytes) -> np.ndarray:
        """Largest response of each chunk of the text: (chunks, filters)."""
        width, step = len(self.table), self.stride * self.chunk
        n = max(1, -(-len(text) // step))
        data = np.frombuffer(text.ljust(n * step, b"\0") + bytes(width), dtype=np.uint8)
        out = np.empty((n, self.table.shape[2]), dtype=np.float32)
        for at in range(0, n, 64):  # 64 chunks at a time, however long the text is
            k = min(64, n - at)
            part = data[at * step : (at + k) * step + width]
            response = self.table[0][part[0 : k * step : self.stride]]
            for j in range(1, width):
                response += self.table[j][part[j : j + k * step : self.stride]]
            out[at : at + k] = response.reshape(k, self.chunk, -1).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def features(self, pooled: np.ndarray) -> np.ndarray:
        return np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)])

    def score(self, text: bytes) -> float:
        z = float(self.features(self.pooled(text)) @ self.out + self.out_bias)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(
    texts: list[bytes],
    labels: np.ndarray,
    filters: int = 12,
    width: int = 8,
    stride: int = 4,
    chunk: int = 64,
    epochs: int = 14,
    rate: float = 0.01,
    most_chunks: int = 24,
    seed: int = 7,
) -> ByteConvNet:
    """Fit the network by Adam on the balanced logistic loss; the same input gives the same network.

    In each epoch a document of more than most_chunks chunks shows another random choice of them. Gradients go through
    the largest response of each chunk and document.
    """
    rng = np.random.default_rng(seed)
    net = ByteConvNet(
        rng.normal(0, 0.3, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters).astype(np.float32), 0.0, stride, chunk
    )
    step = stride * chunk
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.table, net.bias, net.out, np.zeros(1, np.float32))]
    tick, batch = 0, 32
    places = np.arange(chunk) * stride
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        now = rate * (1 - epoch / epochs) + rate * 0.05
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            rows, owner = [], []
            for k, i in enumerate(docs):
                text = texts[i]
                n = max(1, -(-len(text) // step))
                chosen = range(n) if n <= most_chunks else rng.choice(n, most_chunks, replace=False)
                padded = text.ljust(n * step, b"\0") + bytes(width)
                rows += [np.frombuffer(padded, np.uint8, step + width, c * step) for c in chosen]
                owner += [k] * len(chosen)
            data, owner = np.stack(rows), np.asarray(owner)
            response = sum(net.table[j][data[:, places + j]] for j in range(width))
            best = response.argmax(axis=1)
            top = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0, :] + net.bias
            pooled = np.maximum(top, 0)
            first = np.searchsorted(owner, np.arange(len(docs)))
            size = np.bincount(owner, minlength=len(docs))[:, None]
            largest, mean = np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / size
            feature = np.concatenate([largest, mean], axis=1)
            p = 1 / (1 + np.exp(-np.clip(feature @ net.out + net.out_bias, -30, 30)))
            dz = ((p - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            d_out, d_bias_out = feature.T @ dz + 1e-4 * net.out, np.array([dz.sum()], np.float32)
            d_feature = dz[:, None] * net.out
            d_pooled = (d_feature[:, filters:] / size)[owner] + np.where(pooled == largest[owner], d_feature[owner, :filters], 0)
            d_top = np.where(top > 0, d_pooled, 0).astype(np.float32)
            d_table, f = np.zeros_like(net.table), np.arange(filters)[None, :]
            for j in range(width):
                byte = np.take_along_axis(data, best * stride + j, axis=1)
                np.add.at(d_table[j], (byte, np.broadcast_to(f, byte.shape)), d_top)
            tick += 1
            net.out_bias = np.array([net.out_bias], np.float32)
            for param, grad, (m, v) in zip((net.table, net.bias, net.out, net.out_bias), (d_table, d_top.sum(axis=0), d_out, d_bias_out), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= now * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-6)
            net.out_bias = float(net.out_bias[0])
    return net


def training_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[list[bytes], np.ndarray]:
    """At most `most` labelled rows, half of either label where there are as many, chosen by a hash of the id.

    Rows whose crc32(id as text) mod 3 is 1 are held out: never in the sample. The choice is made on the labels alone;
    only the chosen rows' texts are read together.
    """
    key = F.col("_id")
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & key.isNotNull())
    known = known.where(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) != 1)
    docs = df.select(F.col(id_col).alias("_doc"), text_of(text_col).alias("_text"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(most // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.join(F.broadcast(chosen), F.col("_doc") == key).select("_doc", "_text", "_label").toPandas().sort_values(["_doc", "_text", "_label"], kind="stable")
    return [t.encode() for t in rows["_text"]], rows["_label"].to_numpy(dtype=np.int64)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 3000) -> ByteConvNet:
    """A network fitted on a bounded sample of labelled rows (`most` of them)."""
    texts, known = training_sample(df, labels, id_col, text_col, label_col, most)
    if len(set(known.tolist())) < 2:  # nothing to tell apart: all documents score the same
        net = train([b""], np.array([1]), epochs=0)
        net.out[:], net.out_bias = 0, 4.0 if not len(known) or known[0] == 1 else -4.0
        return net
    return train(texts, known)


def scorer(spark: SparkSession, net: ByteConvNet):
    """A function of text columns that gives the network's score; null counts as the empty text."""
    small_batches(spark.range(0))
    model = spark.sparkContext.broadcast(pickle.dumps(net))

    @F.pandas_udf("double")
    @frugal
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(model.value)
        for texts in batches:
            yield pd.Series([own.score((t or "").encode()) for t in texts], dtype="float64")

    return score


def quality_scores(df: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1) and predicted.

    The score depends on the text alone. Null text is empty; an empty text is scored as one chunk of padding. A null id
    is not held out. Repeated rows have equal scores. Other columns are ignored. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("_id"), scorer(df.sparkSession, net)(text_of(text_col)).alias("score"))
    held = F.coalesce(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return rows.select(F.col("_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
