"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

Documents are dealt to blocks of bounded text. A block's distinct n-grams, as sorted hashes with their counts, are the
exploded n-grams; they go to the count table, partitioned by hash, and come back with the corpus counts, joined by hash
within each partition. A document's score is the sum over its words. An n-gram that is in a third of all documents is one
entry in each block, so that no key is hot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import mixed

#: Characters of a block, about.
BLOCK_CHARS = 12_000_000
#: Characters that are hashed and scored at once, about: their arrays stay in a core's caches.
CHUNK_CHARS = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The first 0 to 8 bytes of a 64-bit value.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chunks(texts: list[str]) -> list[list[str]]:
    """The texts in order, as lists of about CHUNK_CHARS characters."""
    ends = np.cumsum([len(t) for t in texts])
    cut = np.flatnonzero(np.diff(ends // CHUNK_CHARS)) + 1
    return [texts[i:j] for i, j in zip([0, *cut], [*cut, len(texts)], strict=True)] if texts else []


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one text after the other, and each text's number of words.

    All words are hashed together, eight bytes at a time after their lengths; the few of over 64 bytes one by one. Two
    words have one hash with a chance of 2**-64.
    """
    data = [t.encode() for t in texts]
    text = b" " + b" ".join(data).lower() + b" " * 8
    space = _SPACE[np.frombuffer(text, np.uint8)]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, size = turns[::2], turns[1::2] - turns[::2]
    at_byte = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    h, some, k = mixed(size.astype(np.uint64) * _M), np.flatnonzero(size <= 64), 0
    while len(some):
        h[some] = mixed(h[some] * _M + (at_byte[begin[some] + k] & _BYTES[np.minimum(size[some] - k, 8)]))
        k += 8
        some = some[size[some] > k]
    for i in np.flatnonzero(size > 64):
        h[i] = xxhash.xxh3_64_intdigest(text[begin[i] : begin[i] + size[i]])
    ends = np.cumsum([len(d) + 1 for d in data])
    return h, np.diff(np.searchsorted(begin, ends), prepend=0)


def ngrams(texts: list[str], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each text's number of words and, for each order, the words that an n-gram of one text begins at and its hash."""
    w, sizes = word_hashes(texts)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(w))
    out, h = [], mixed(w * _M + np.uint64(1))
    for n in range(1, order + 1):
        if n > 1:
            h = mixed(h[:-1] * _M + w[n - 1 :])
        at = np.flatnonzero(left[: len(h)] >= n)
        out.append((at, h[at]))
    return sizes, out


def distinct_counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    at = starts(h)
    return h[at], np.diff(at, append=len(h))


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def block_counts(texts: list[str], order: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of some texts, sorted distinct hashes of all orders, and their counts."""
    words, parts = 0, [np.empty(0, np.uint64)]
    for some in chunks(texts):
        sizes, grams = ngrams(some, order)
        words += int(sizes.sum())
        parts += [h for _, h in grams]
    return words, *distinct_counts(np.concatenate(parts))


def places(h: np.ndarray) -> np.ndarray:
    """The order that sorts the hashes, equal ones by their place.

    The place is written over a hash's low bits, as values sort faster than places do; where hashes that differ only
    there come out of order, places are sorted.
    """
    low = np.uint64((1 << len(h).bit_length()) - 1)
    by = (np.sort(h & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    s = h[by]
    return np.argsort(h, kind="stable") if (s[1:] < s[:-1]).any() else by


def corpus_counts(h: np.ndarray, text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, leave_out: bool) -> np.ndarray:
    """The count of each n-gram, given its hash and the number of its text; with leave_out without its text's own."""
    by = places(h)
    s = h[by]
    at = starts(s)
    found = np.repeat(counts[np.searchsorted(hashes, s[at])].astype(np.float64), np.diff(at, append=len(s)))
    if leave_out:
        own = np.diff(starts(s, text[by]), append=len(s))
        found -= np.repeat(own, own)
    out = np.empty(len(h))
    out[by] = found
    return out


def backoff(texts: list[str], order: int, total: int, hashes: np.ndarray, counts: np.ndarray, factor: float, leave_out: bool) -> list[tuple[int, float]]:
    """Words of each text and the sum of the logarithms of their scores.

    The score of a word after its n - 1 words is count(n-gram) / count(those words) if the n-gram is counted, else factor
    times the score after one word less; a word that is not counted has factor / total. With leave_out the text's own
    n-grams don't count.
    """
    sizes, grams = ngrams(texts, order)
    text = np.repeat(np.arange(len(texts)), sizes)
    size = np.maximum(1, total - sizes[text] if leave_out else total)
    score = before = None
    for k, (at, h) in enumerate(grams):
        c = corpus_counts(h, text[at], hashes, counts, leave_out)
        if k:
            # What stands before a word: the n-gram of one order less that ends at the word before. In its count the text's
            # last place, which nothing follows, stays.
            b, shorter = before[at], factor * score[at + k]
            score[at + k] = np.where((c > 0) & (b > 0), np.minimum(1.0, c / np.maximum(b, 1)), shorter)
        else:
            score = np.where(c > 0, c, factor) / size
        before = np.zeros(len(text))
        before[at] = c
    return [(len(x), float(x.sum())) for x in np.split(np.log(score), np.cumsum(sizes)[:-1])]


def backoff_scores(df: DataFrame, order: int = 2, factor: float = 0.4, leave_out: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, score (sum of logarithms) and mean_score; 0 words have score 0 and no mean.

    Words are what ASCII white space parts, with A-Z lower-cased. Counts are over all rows, repeated ones as often as they
    stand. Null text is empty. Two n-grams have one hash with a chance of 2**-64. Rows without an id, or that repeat one, are scored like all others. Other columns are ignored; an empty
    table gives an empty result.
    """
    # The id goes as text, as pandas would round integers beside a null.
    docs = df.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("_text"))
    chars = docs.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    # Very long texts don't crowd one block: each row goes to a block by its id and text.
    dealt = docs.select(F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(blocks)).cast("int").alias("block"), "_id", "_text")
    edges = np.linspace(0, 2.0**64, blocks + 1)[1:-1].astype(np.uint64) if blocks > 1 else np.empty(0, np.uint64)

    def exploded(batch: pd.DataFrame) -> pd.DataFrame:
        words, hashes, counts = block_counts(batch["_text"].tolist(), order)
        cut, block = np.searchsorted(hashes, edges), int(batch["block"].iloc[0])
        # Empty slices aren't sent: there are never more arrays than n-grams, however many blocks there are.
        slices = enumerate(zip(np.split(hashes, cut), np.split(counts, cut), strict=True))
        rows = [(block, p, a.tobytes(), c.astype(np.uint32).tobytes()) for p, (a, c) in slices if len(a)]
        # Part -1 has the words of all blocks and gives each their sum.
        return pd.DataFrame([(block, -1, b"", np.uint64(words).tobytes()), *rows], columns=["block", "part", "hashes", "counts"])

    def joined(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["part"].iloc[0] < 0:
            total = sum(int(np.frombuffer(x, np.uint64)[0]) for x in batch["counts"])
            return batch[["block", "part"]].assign(width=8, counts=np.uint64(total).tobytes())
        hashes = [np.frombuffer(x, np.uint64) for x in batch["hashes"]]
        own = np.concatenate([np.frombuffer(x, np.uint32) for x in batch["counts"]]).astype(np.int64)
        table, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=own, minlength=len(table)).astype(np.int64)
        sizes = np.cumsum([len(h) for h in hashes])[:-1]
        back = [x.astype(np.uint32 if not len(total) or total.max() < 1 << 32 else np.uint64) for x in np.split(total[inverse], sizes)]
        return pd.DataFrame({"block": batch["block"], "part": batch["part"], "width": [x.itemsize for x in back], "counts": [x.tobytes() for x in back]})

    found = dealt.groupBy("block").applyInPandas(exploded, "block int, part int, hashes binary, counts binary")
    tables = found.groupBy("part").applyInPandas(joined, "block int, part int, width int, counts binary")

    def scored(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        mine = texts["_text"].tolist()
        _, hashes, _ = block_counts(mine, order)
        counts = counts.sort_values("part")
        arrays = [np.frombuffer(c, np.uint32 if w == 4 else np.uint64).astype(np.int64) for c, w in zip(counts["counts"], counts["width"], strict=True)]
        total, known = int(arrays[0][0]), np.concatenate([np.empty(0, np.int64), *arrays[1:]])
        rows = [r for some in chunks(mine) for r in backoff(some, order, total, hashes, known, factor, leave_out)]
        return pd.DataFrame({"_id": texts["_id"], "n_words": [r[0] for r in rows], "score": [r[1] for r in rows]})

    out = dealt.groupBy("block").cogroup(tables.groupBy("block")).applyInPandas(scored, "_id string, n_words long, score double")
    return out.select(F.col("_id").cast(df.schema[id_col].dataType).alias(id_col), "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score"))
