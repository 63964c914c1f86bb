"""Sum-of-squares packing of token sequences."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, text_of


# Fixed value: the pattern by which byte-level BPE of this family splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file with its tokens as bytes.

    Such files write a byte that prints as its own character, and the others, in order, as the characters from 256 on.
    """
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printing)]
    byte = {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


class Encoder(dict):
    """Token ids of texts as the tokenizer file gives them, as little-endian unsigned 32-bit bytes.

    The tokenizer splits before each space or line end that follows a word, so that the ids of a text whose words are
    parted by single spaces and line ends are those of its words, each with what precedes it. This dict keeps them by
    word, in two generations of up to `most`; a word with other white space, or none, has None. Texts with such words or with a
    special token go to the tokenizer whole. New words of Latin letters are merged from the same vocabulary's ranks,
    which is several times faster than a call of the tokenizer for each; others go to the tokenizer.
    """

    def __init__(self, path: str, most: int = 200_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.tokenizer = Tokenizer.from_str(f.read())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        self.ranked = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=byte_ranks(vocabulary), special_tokens={})
        self.most, self.old = most, {}
        self.marks = {m: self.whole(m) for m in ",."}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word, b"")
        if ids == b"":
            body = word.removeprefix("\n")
            if body.split() != [body]:
                ids = None
            elif word[-1] in ",." and len(body) > 1 and body[-2].isalpha() and max(body) < "\u0250":
                # Letters and a mark after them are never in one token.
                ids = self[word[:-1]] + self.marks[word[-1]]
            elif max(body) < "\u0250":
                ids = array("I", self.ranked.encode_ordinary(word if body != word else f" {word}")).tobytes()
            else:
                ids = self.whole(word if body != word else f" {word}")
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        first, *words = text.replace("\n", " \n").split(" ")
        if first and first.split() == [first] and not any(s in text for s in self.special):
            try:
                return self.whole(first) + b"".join(map(self.__getitem__, words))
            except TypeError:  # a None
                pass
        return self.whole(text)


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, digest: bool = False) -> DataFrame:
    """The token sequences to pack: id, piece, start, length and ids (little-endian unsigned 32-bit), or with `digest` their CRC-32 in place of ids.

    A document's ids are those of its text, then end_id. One with more than `capacity` ids is cut into pieces of
    `capacity` from its end, so that only the first may be shorter. Null and empty texts give end_id alone. tokenizer is
    the path of a tokenizer file that all executors have.
    """

    @frugal
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, size = Encoder(tokenizer), 4 * capacity
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, at = [], 0
            for doc, text in zip(batch["_id"], batch["_text"], strict=True):
                ids = encoder.encode(text) + end
                first = len(ids) % size or size
                rows += [(doc, k, max(0, first - size + k * size) // 4, ids[max(0, first - size + k * size) : first + k * size]) for k in range((len(ids) - first) // size + 1)]
                at += len(ids)
                if at > 8_000_000:
                    yield frame(rows)
                    rows, at = [], 0
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["_id", "piece", "start", "ids"])
        out["length"] = [len(x) // 4 for x in out["ids"]]
        if digest:
            out["ids_crc32"] = [zlib.crc32(x) for x in out["ids"]]
        return out[["_id", "piece", "start", "length", "ids_crc32" if digest else "ids"]]

    small_batches(df)
    # The id goes as text, as pandas would round integers beside a null.
    docs = df.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("_text"))
    out = docs.mapInPandas(cut, f"_id string, piece int, start long, length long, {'ids_crc32 long' if digest else 'ids binary'}")
    return out.withColumn("_id", F.col("_id").cast(df.schema[id_col].dataType))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first, each in the bin that keeps the sum of squares smallest.

    The sum runs over the gaps 1..capacity-1 of open bins, of the squared number of bins with that gap. Only the gap
    counts matter: an item of size s that goes into a bin of gap g takes one from count[g] and adds one to
    count[g - s]; a new bin counts as a bin of gap `capacity`, of which there are none to take from. Ties go to the
    smallest gap.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # The change of the sum for each gap g >= s, halved and without what all choices share; a full bin has gap 0 and
        # counts nothing, which saves the one that counting it would add.
        change = counts[: capacity + 1 - s] - counts[s:]
        change[0] -= 1
        change = np.where(counts[s:] > 0, change, np.iinfo(np.int64).max)
        g = int(change.argmin()) + s
        if change[g - s] == np.iinfo(np.int64).max:
            g = capacity
            bins[g].append(opened)
            counts[g] += 1
            opened += 1
        b = bins[g].pop()
        counts[g] -= 1
        place[i], offset[i] = b, capacity - g
        if g > s:
            bins[g - s].append(b)
            counts[g - s] += 1
    return place, offset


def pack(pieces: DataFrame, capacity: int = 2048, per_shard: int = 16_384, n_items: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset: each in one sequence of at most `capacity`, offsets gapless from 0.

    Pieces need the columns _id, piece and length and may have more. They are dealt by a hash of id and piece to shards of
    about per_shard pieces, and each shard is packed by sum_of_squares(), so that tasks stay of one size however large
    the table or one document is. A shard's last sequences may stay partly empty: a loss of a few sequences in
    thousands. n_items, about the number of pieces, saves counting them. Rows that repeat an id and piece are packed
    as rows of their own.
    """
    shards = max(1, -(-(pieces.count() if n_items is None else n_items) // per_shard))

    def packed(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_id", "piece"], kind="stable", ignore_index=True)
        place, offset = sum_of_squares(batch["length"].to_numpy(), capacity)
        return batch.assign(sequence_id=(batch["_shard"].to_numpy(dtype="int64") << 32) + place, offset=offset)

    kind, pieces = pieces.schema["_id"].dataType, pieces.withColumn("_id", F.col("_id").cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("_id", "piece"), F.lit(shards)).cast("int"))
    out = dealt.groupBy("_shard").applyInPandas(packed, f"{kinds}, _shard int, sequence_id long, offset long").drop("_shard")
    return out.withColumn("_id", F.col("_id").cast(kind))


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Where each piece of each document goes: id, piece, start, length, ids_crc32, sequence_id and offset.

    ids_crc32 is the CRC-32 of the piece's ids; the ids themselves are in token_pieces(), whose rows it identifies. An
    empty table gives an empty result. Rows without an id, or that repeat one, are packed like all others. Other columns
    are ignored.
    """
    pieces = token_pieces(df, tokenizer, id_col, text_col, capacity, end_id, digest=True)
    return pack(pieces, capacity, n_items=df.count()).withColumnRenamed("_id", id_col)
