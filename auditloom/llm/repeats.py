"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if some string of `length` bytes that covers it also starts earlier: in a row of a smaller id, or earlier in
the same row. All rows count, and strings are judged on the input.

Texts are cut at anchors: of the hashes of all `gram`-byte strings within each window of `length` bytes, the smallest
(leftmost of equals) is the window's anchor. Equal windows have equal anchors at the same place, so that they meet under
the anchor's hash. Under each hash the suffixes that start at the anchors, and the reversed prefixes that end there, are
sorted; two windows are equal if both parts are.

The anchors of a very common hash are sorted in parts first: what repeats within a part goes, and of equal windows one
stays. If many stay, they are told apart by the bytes around the anchor and sorted in parts again, and so on.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, drop_written, frugal, numbered, slot, slots_of, small_batches, text_of, without, written
from .exact_dedup import copies
from .shingles import mixed

#: Anchors of one hash beyond which they are judged in parts first; anchors sorted together, about; bytes hashed at a time.
HOT, TOGETHER, SEGMENT = 2000, 8_000, 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Powers:
    """Powers of the odd base of the polynomial hash, and of its inverse modulo 2**64, up to a segment's length."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.concatenate([np.ones(1, np.uint64), np.full(m, _BASE)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([np.ones(1, np.uint64), np.full(m, inverse)]).cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, from block-wise minima from either side."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - w + 1], behind[w - 1 : n])


def anchors(data: np.ndarray, length: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor of a text, and the first and last start of the windows whose anchor it is."""
    parts, w = [], length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        up, down = powers.of(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        h = mixed((total[gram:] - total[:-gram]) * down[: len(part) - gram + 1])
        place = sliding_min((h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64), w) & np.uint64((1 << 24) - 1)
        place = place.astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        end = np.concatenate([begin[1:], [len(place)]]) - 1
        parts.append((h[place[begin]].view(np.int64), place[begin] + at, begin + at, end + at))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def bounded_suffix_sort(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows within their groups, and the common prefix of each with the row before (0 at a group's first).

    Rows of one width; groups are runs of equal numbers. A bottom-up mergesort: each element finds its place in the run
    beside its own by binary search, and each comparison finds the common prefix of two rows by binary search over the
    hashes of their prefixes, all elements at once. The prefixes that the hashes call common are compared byte by byte
    afterwards; should a hash have erred, the rows are sorted by their bytes.
    """
    n, width = rows.shape
    hashes = np.zeros((n, width + 1), dtype=np.uint64)
    powers = np.concatenate([np.ones(1, np.uint64), np.full(width, _BASE)]).cumprod(dtype=np.uint64)
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers[None, :width], axis=1, out=hashes[:, 1:])

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.full(len(x), width, np.int64)
        while (busy := low < high).any():
            mid = (low + high + 1) // 2
            same = hashes[x, mid] == hashes[y, mid]
            low, high = np.where(busy & same, mid, low), np.where(busy & ~same, mid - 1, high)
        return low

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        k = common(x, y)
        at = np.minimum(k, width - 1)
        return np.where(k == width, ties, rows[x, at] < rows[y, at])

    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(begin, n))
    first, many = np.repeat(begin, size), np.repeat(size, size)
    order, run = np.arange(n), 1
    while run < (size.max() if n else 0):
        p = np.flatnonzero(many > run)
        local = (p - first[p]) // (2 * run) * (2 * run)
        left = p - first[p] < local + run
        low = first[p] + np.where(left, local + run, local)
        high = np.minimum(low + run, first[p] + many[p])
        live = low < high
        p, left, low, high, local = p[live], left[live], low[live], high[live], local[live]
        base, own = low.copy(), p - first[p] - local - np.where(left, 0, run)
        while (busy := low < high).any():
            mid = (low + high) // 2
            other = order[np.minimum(mid, n - 1)]
            # Of equal rows those of the left run come first.
            goes = before(other, order[p], ~left)
            low, high = np.where(busy & goes, mid + 1, low), np.where(busy & ~goes, mid, high)
        merged = order.copy()
        merged[first[p] + local + own + (low - base)] = order[p]
        order, run = merged, 2 * run
    prefix = np.zeros(n, np.int64)
    if n > 1:
        prefix[1:] = np.where(group[1:] == group[:-1], common(order[1:], order[:-1]), 0)
        a, b = rows[order[1:]], rows[order[:-1]]
        equal = np.cumprod(a == b, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
        equal = np.where(group[1:] == group[:-1], equal, 0)
        k = np.minimum(equal, width - 1)[:, None]
        sorted_ = (np.take_along_axis(a, k, 1) >= np.take_along_axis(b, k, 1))[:, 0] | (group[1:] != group[:-1])
        if (equal != prefix[1:]).any() or not sorted_.all():
            order = np.lexsort((*rows.T[::-1], group))
            a, b = rows[order[1:]], rows[order[:-1]]
            prefix[1:] = np.where(group[1:] == group[:-1], np.cumprod(a == b, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64), 0)
    return order, prefix


def judged(batch: pd.DataFrame, length: int, survivors: bool = False) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """Of rows with key, _id, place, first, last and bytes: the bytes to remove, merged for each _id, and what stays.

    A row is an anchor with the windows that start from first to last; bytes are those of all of them. All windows of an
    anchor overlap, so that the repeated ones cover one stretch of bytes. A window goes if an earlier row of the same
    key has an equal one. What stays are the rows with the windows that don't go: of equal windows the first is among
    them, so that later rows can be held against what stays alone.
    """
    batch = batch.sort_values(["key", "_id", "place", "first"], ignore_index=True)
    key, place = batch["key"].to_numpy(), batch["place"].to_numpy()
    near, far = place - batch["last"].to_numpy(), place - batch["first"].to_numpy()  # smallest and largest distance of a window's start
    n = len(batch)
    span = int(far.max()) if n else 0
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, max(1, span)), np.uint8)
    for i, (data, back) in enumerate(zip(batch["bytes"], far.tolist(), strict=True)):
        x = np.frombuffer(data, np.uint8)
        right[i, : len(x) - back] = x[back : back + length]
        left[i, :back] = x[:back][::-1]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if n else np.empty(0, np.int64)
    classes = []
    for rows in (right, left):
        order, prefix = bounded_suffix_sort(rows, group)
        classes.append((order, prefix, np.concatenate([[True], group[1:] != group[:-1]])))
    most, least = np.full(n, -1, np.int64), np.full(n, span + 1, np.int64)
    high, low = most.copy(), least.copy()
    number = np.empty((2, n), np.int64)
    for d in range(span + 1):
        valid = np.flatnonzero((near <= d) & (d <= far))
        if not len(valid):
            continue
        for side, need in ((0, length - d), (1, d)):
            order, prefix, starts = classes[side]
            number[side, order] = np.cumsum(starts | (prefix < need))
        same = number[0, valid] * (n + 2) + number[1, valid]
        # Rows are in the order of id and place, so that of equal windows the first row stays.
        at = np.argsort(same, kind="stable")
        first = np.concatenate([[True], same[at[1:]] != same[at[:-1]]])
        again, stay = valid[at[~first]], valid[at[first]]
        most[again], least[again] = np.maximum(most[again], d), np.minimum(least[again], d)
        high[stay], low[stay] = np.maximum(high[stay], d), np.minimum(low[stay], d)
    hit = np.flatnonzero(most >= 0)
    found: dict = {}
    for doc, start, end in zip(batch["_id"].to_numpy()[hit].tolist(), (place[hit] - most[hit]).tolist(), (place[hit] - least[hit] + length).tolist(), strict=True):
        found.setdefault(doc, ([], []))[0].append(start)
        found[doc][1].append(end)
    merged = {doc: merged_spans(*x) for doc, x in found.items()}
    lists = lambda k: pd.Series([[x[k] for x in own] for own in merged.values()], dtype=object)
    spans = pd.DataFrame({"_id": pd.Series(list(merged), dtype=batch["_id"].dtype), "starts": lists(0), "ends": lists(1)})
    if not survivors:
        return spans, None
    live = np.flatnonzero(high >= 0)
    left_over = batch.iloc[live].copy()
    first, last = place[live] - high[live], place[live] - low[live]
    offset = first - left_over["first"].to_numpy()
    left_over["bytes"] = [x[o : o + m] for x, o, m in zip(left_over["bytes"], offset.tolist(), (last - first + length).tolist(), strict=True)]
    left_over["first"], left_over["last"] = first, last
    return spans, left_over


def narrowed(batch: pd.DataFrame, length: int) -> pd.DataFrame:
    """Rows of a hot key under longer keys, each with some of their windows.

    All rows of a key have the `before` bytes ahead of the anchor's start and the `behind` bytes from there on in common. A
    window that reaches far ahead of the anchor holds the next bytes there, and one that doesn't holds the next bytes
    behind: equal windows agree in them, so that these bytes go into the key. Each step halves what a key leaves open,
    until a key stands for one window.
    """
    import xxhash

    out = []
    for row in batch.itertuples(index=False):
        middle = (row.before + length - row.behind) // 2
        if length - row.behind <= row.before:
            out.append(tuple(row))
            continue
        back = row.place - row.first
        if back > middle:
            last = min(row.last, row.place - middle - 1)
            more = row.bytes[back - middle - 1 : back - row.before]
            key = xxhash.xxh3_64_intdigest(b"<%d " % row.key + more) - (1 << 63)
            out.append((key, row[1], row.place, row.first, last, row.bytes[: last - row.first + length], middle + 1, row.behind, *row[8:]))
        if row.place - row.last <= middle:
            first = max(row.first, row.place - middle)
            more = row.bytes[back + row.behind : back + length - middle]
            key = xxhash.xxh3_64_intdigest(b">%d " % row.key + more) - (1 << 63)
            out.append((key, row[1], row.place, first, row.last, row.bytes[first - row.first :], row.before, length - middle, *row[8:]))
    return pd.DataFrame(out, columns=batch.columns)


def merged_spans(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal stretches of the union of intervals."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeat_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """_id and the stretches to remove (starts, ends; an end may lie beyond the text), of the rows (_id, _text) that have any.

    Rows with one _id have one text. Rows whose whole text an earlier row has (bytes compared) go as a whole and are not
    compared any further.
    """
    small_batches(docs)
    gram = max(1, length * 32 // 100)
    kind = docs.schema["_id"].dataType.simpleString()
    docs = docs.where(F.col("_id").isNotNull() & (F.octet_length("_text") >= length)).select("_id", "_text")
    whole = copies(docs)
    docs = without(docs, whole)
    found = f"key long, _id {kind}, place long, first long, last long, bytes binary"

    @frugal
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            texts = batch.pop("_text")
            yield batch.assign(keys=[anchors(np.frombuffer(t.encode(), np.uint8), length, gram, powers)[0] for t in texts])

    base = written(docs.mapInPandas(keys, f"_id {kind}, keys array<long>"))

    # Anchors that stand more than once; the counts are a table, so that the join may split a hot key's rows.
    rows = base.select("_id", F.explode("keys").alias("key"))
    several = written(rows.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k", "_n", (F.col("_n") > HOT).alias("_hot")))
    total = several.agg(F.sum("_n")).first()[0] or 0
    wanted = rows.join(several, F.col("key") == F.col("_k")).groupBy(F.col("_id").alias("_want")).agg(
        F.collect_list(F.when(~F.col("_hot"), F.col("key"))).alias("some"), F.collect_list(F.when(F.col("_hot"), F.col("key"))).alias("hot")
    )
    wanted = written(wanted)

    # Their bytes; slots keep most other texts out before the shuffle.
    near = docs.join(slots_of(wanted, "_want"), slot("_id") == F.col("_slot"), "left_semi").join(wanted, F.col("_id") == F.col("_want")).dropDuplicates(["_id"])

    def opened(which: str):
        """Rows of judged(); those of hot keys as the rows that stay within some of a task's texts, and the stretches found there."""

        @frugal
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            powers, out = Powers(), []
            ready = lambda: pd.DataFrame(out, columns=["key", "_id", "place", "first", "last", "bytes"])
            for batch in batches:
                for doc, text, own in zip(batch["_id"], batch["_text"], batch[which], strict=True):
                    data = text.encode()
                    hash_, place, first, last = anchors(np.frombuffer(data, np.uint8), length, gram, powers)
                    at = np.flatnonzero(np.isin(hash_, np.asarray(own, dtype=np.int64)))
                    for k, p, f, x in zip(hash_[at].tolist(), place[at].tolist(), first[at].tolist(), last[at].tolist(), strict=True):
                        out.append((k, doc, p, f, x, data[f : x + length]))
                        if len(out) >= TOGETHER:
                            yield from two_kinds(ready()) if which == "hot" else [ready()]
                            out = []
                if which == "some":
                    yield ready()
                    out = []
            if out:
                yield from two_kinds(ready())

        return rows

    def two_kinds(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        spans, stay = judged(batch, length, survivors=True)
        none = pd.Series([[]] * len(stay), index=stay.index, dtype=object)
        stay = stay.assign(before=0, behind=gram) if "before" not in stay else stay
        yield stay.assign(starts=none, ends=none)[["key", "_id", "place", "first", "last", "bytes", "before", "behind", "starts", "ends"]]
        yield spans.assign(key=0, place=0, first=0, last=0, bytes=None, before=0, behind=0)[["key", "_id", "place", "first", "last", "bytes", "before", "behind", "starts", "ends"]]

    mixed_kind = f"{found}, before int, behind int, starts array<long>, ends array<long>"
    some = near.where(F.size("some") > 0).select("_id", "_text", "some").mapInPandas(opened("some"), found)
    hot = written(near.where(F.size("hot") > 0).select("_id", "_text", "hot").mapInPandas(opened("hot"), mixed_kind))
    parts, tables = [hot.where("bytes IS NULL").select("_id", "starts", "ends")], [hot]
    pending = hot.where("bytes IS NOT NULL").drop("starts", "ends")
    while True:
        # What stays of hot keys: the few go on to the others, the still hot ones get longer keys and are judged in salted parts.
        counts = written(pending.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT))
        left = counts.agg(F.sum("_n")).first()[0] or 0
        tables.append(counts)
        if not left:
            some = some.unionByName(pending.drop("before", "behind"))
            break
        joined = pending.join(counts, F.col("key") == F.col("_k"), "left")
        some = some.unionByName(joined.where("_n IS NULL").select(*(c.split()[0] for c in found.split(", "))))
        longer = joined.where("_n IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("_id", "place"), F.ceil(F.col("_n") / TOGETHER)).cast("int"))
        columns = ["key", "_id", "place", "first", "last", "bytes", "before", "behind", "_salt"]
        longer = longer.select(*columns).mapInPandas(
            lambda batches: (narrowed(b, length) for b in batches), f"{found}, before int, behind int, _salt int"
        )
        bucket = F.pmod(F.xxhash64("key", "_salt"), F.lit(max(1, 2 * left // TOGETHER))).alias("_bucket")
        hot = written(longer.groupBy(bucket).applyInPandas(lambda batch: pd.concat([x for x in two_kinds(batch) if len(x)]), mixed_kind))
        tables.append(hot)
        parts.append(hot.where("bytes IS NULL").select("_id", "starts", "ends"))
        pending = hot.where("bytes IS NOT NULL").drop("starts", "ends")

    buckets = max(1, total // TOGETHER)
    parts.append(some.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("_bucket")).applyInPandas(
        lambda batch: judged(batch, length)[0], f"_id {kind}, starts array<long>, ends array<long>"
    ))
    parts.append(whole.select("_id", F.array(F.lit(0).cast("long")).alias("starts"), F.array(F.lit(1 << 62)).alias("ends")))
    spans = functools.reduce(DataFrame.unionByName, parts)
    out = written(spans.groupBy("_id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")))
    drop_written(base, several, wanted, whole, *tables)
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (_id, ...) that may have spans, with starts and ends, and those whose slot no row with spans has."""
    slots, own = slots_of(spans, "_id"), spans.select(F.col("_id").alias("_for"), "starts", "ends")
    near = docs.join(slots, slot("_id") == F.col("_slot"), "left_semi").join(own, F.col("_id") == F.col("_for"), "left").drop("_for")
    return near, docs.join(slots, slot("_id") == F.col("_slot"), "left_anti")


def repeat_report(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay.

    Null text is empty; texts shorter than `length` bytes keep all bytes. Rows that repeat an id with its text are one
    document and get equal results; with another text they are documents of their own, in the order of a hash. A row
    with a null id is no other row's earlier one and keeps all bytes. Other columns are ignored. An empty table gives an
    empty result. Texts of any length are hashed in segments.
    """
    docs, _ = numbered(df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")))
    spans = repeat_spans(docs, length)
    # Ids pass by as text: pandas would round integers beside a null.
    kind = df.schema[id_col].dataType

    @frugal
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, starts, ends in zip(batch["_of"], batch["_text"], batch["starts"], batch["ends"], strict=True):
                data, parts = text.encode(), []
                if starts is not None:
                    parts = merged_spans(list(starts), [min(e, len(data)) for e in ends]) if (data := text.encode()) else []
                digest, at = hashlib.sha256(), 0
                for a, b in [*parts, (len(data), len(data))]:
                    digest.update(data[at:a])
                    at = b
                out.append((doc, len(data), sum(b - a for a, b in parts), len(parts), digest.hexdigest()))
            yield pd.DataFrame(out, columns=["_of", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    near, same = with_spans(docs, spans)
    near = near.select(F.col("_of").cast("string").alias("_of"), "_text", "starts", "ends")
    near = near.mapInPandas(cut, "_of string, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("_of", F.col("_of").cast(kind))
    zero = F.lit(0).cast("long")
    same = same.select("_of", F.octet_length("_text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("_text", 256).alias("kept_sha256"))
    return near.unionByName(same).withColumnRenamed("_of", id_col)


def drop_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_emptied: bool = True) -> DataFrame:
    """The table with each text's repeated strings removed, in whole characters: a character only partly repeated stays.

    All columns stay as they are, whatever their names, and so do null texts and rows without repeats or without an id.
    Rows of which nothing is left go where keep_emptied is false; texts that were empty stay.
    """
    docs, _ = numbered(as_row(df, id_col, text_col))
    spans = repeat_spans(docs, length)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(texts, starts, ends, strict=True):
            data, kept, at = text.encode(), [], 0
            for start, end in merged_spans(list(a), [min(e, len(data)) for e in b]):
                while start < end and data[start] & 0xC0 == 0x80:
                    start += 1
                while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
                    end -= 1
                kept.append(data[at:start])
                at = end
            out.append((b"".join(kept) + data[at:]).decode())
        return pd.Series(out, dtype=object)

    near, same = with_spans(docs, spans)
    whole = near.where("starts IS NULL").select("_row")
    cuts = near.where("starts IS NOT NULL").select("_row", cut("_text", "starts", "ends").alias("_cut"))
    if not keep_emptied:
        cuts = cuts.where(F.length("_cut") > 0)
    cuts = cuts.select(F.col("_row").withField(f"`{text_col}`", F.col("_cut")).alias("_row"))
    return same.select("_row").unionByName(whole).unionByName(cuts).select("_row.*")
