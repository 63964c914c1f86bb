"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one node, that of the smallest id. Nodes are put into groups of similar ones; a
group keeps the union of its tokens (the matrix of tokens and groups): the rarest of them one by one, all of them as
slots. A query opens a group only if its overlap with that union is large enough for any member to qualify; only then are
the members' tokens read.

Which queries and groups meet at all follows from the same bound: a query of n tokens that has at least o of them in a
group's union has one of any n - o + 1 there. Only those tokens, the rarest first, are looked up. Rarity is the count of
the token's hash bucket over all documents, in a table of fixed size; it orders tokens and never decides a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, drop_written, frugal, numbered, slot, slots_of, small_batches, text_of, without, written
from .components import components
from .shingles import Shingler

#: Buckets of the count table (as a power of 2), and parts it is summed in.
SKETCH_BITS, SKETCH_PARTS = 18, 64
#: Nodes of a group, on average, and pairs of groups that are judged in one call.
GROUP_SIZE, PAIRS = 48, 1000


def rarity_levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each hash bucket how often its tokens occur, in half powers of two over the mean: 2**18 bytes, whatever the input."""

    @frugal
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, counts = Shingler(words), np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch["_text"]:
                np.add.at(counts, (shingler.all_hashes(text) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        yield pd.DataFrame({"part": range(SKETCH_PARTS), "counts": [x.tobytes() for x in np.split(counts, SKETCH_PARTS)]})

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": batch["part"][:1], "counts": [sum(np.frombuffer(x, dtype=np.int64) for x in batch["counts"]).tobytes()]})

    # Task results are added in two steps, so that no task gets those of all others.
    some = docs.select("_text").mapInPandas(count, "part int, counts binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.groupBy("part", "salt").applyInPandas(lambda b: add(b), "part int, counts binary")
    rows = some.groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    total = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), dtype=np.int64)
    for r in rows:
        total[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    total = total.ravel()
    return np.clip(np.floor(2 * np.log2(np.maximum(total, 1) / max(1.0, total.mean()))), 0, 120).astype(np.uint8)


def token_rows(docs: DataFrame, words: int, levels: np.ndarray, ratio: tuple[int, int]) -> DataFrame:
    """_id, n (set size), h1, h2 (128-bit hash of the set) and prefix: the rarest n - o + 1 tokens, or none where n tokens must all agree."""
    ranks = docs.sparkSession.sparkContext.broadcast(levels)
    low, high = ratio

    @frugal
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingler, level = Shingler(words), ranks.value.astype(np.uint64)
        for batch in batches:
            out = []
            for text in batch.pop("_text"):
                h = shingler.hashes(text)
                n = len(h)
                p = n - -(-low * n // high) + 1
                # A different set of n tokens that links has an overlap of at most n - 1 with it or with its own n + 1 tokens.
                if (n + 1) * low > n * high:
                    prefix = h[:0]
                else:
                    rank = level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(56) | h >> np.uint64(8)
                    prefix = h[rank <= np.partition(rank, p - 1)[p - 1]]
                d = xxhash.xxh3_128_intdigest(h.tobytes())
                out.append((n, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), prefix.view(np.int64), bits_of(h) if len(prefix) else b""))
            yield batch.assign(**{c: [x[i] for x in out] for i, c in enumerate(("n", "h1", "h2", "prefix", "bits"))})

    # Ids go as text, as pandas would round integers beside a null.
    out = docs.select(F.col("_id").cast("string").alias("_id"), F.col("_of").cast("string").alias("_of"), "_text")
    out = out.mapInPandas(rows, "_id string, _of string, n long, h1 long, h2 long, prefix array<long>, bits binary")
    return out.withColumns({"_id": F.col("_id").cast("long"), "_of": F.col("_of").cast("long")})


def bits_of(h: np.ndarray) -> bytes:
    """Which of 2n to 4n slots the tokens of a set fall in: a 30th of the tokens' own bytes."""
    slots = np.zeros(max(64, 1 << (2 * len(h) - 1).bit_length()), dtype=bool)
    slots[(h & np.uint64(len(slots) - 1)).astype(np.int64)] = True
    return np.packbits(slots).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Slots of a set over `width` bytes: wider ones fall together, narrower ones stand for all they may be."""
    if bits.shape[-1] < width:
        return np.tile(bits, width // bits.shape[-1])
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, width), axis=-2)


def opened(one: bool, side: np.ndarray, labels: np.ndarray, n: np.ndarray, bits: list[np.ndarray], ratio: tuple[int, int]) -> np.ndarray:
    """Which members of two groups (of one, if `one`) may link with one of the other side.

    A slot that only one of two sets has holds a token that only this one has: its overlap is at most n less such slots.
    Each member is a query of the other group first: its overlap with the slots of that group's union bounds that with any
    member there, and the group is opened only for the queries that reach what a link asks for. These are held against
    the members' own slots.
    """
    low, high = ratio
    sides = [np.flatnonzero(side == 0)] * 2 if one else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    keep = np.zeros(len(side), dtype=bool)
    if not all(map(len, sides)):
        return keep
    # Slots of one width: those of the widest set, so that narrower ones stand for all they may be.
    width = np.array([len(x) for x in bits])
    stack = np.stack([folded(x, int(width.max())) for x in bits])
    live = []
    for own, others in zip(sides, reversed(sides), strict=True):
        union = np.bitwise_or.reduce(stack[others], axis=0)
        alone = [np.bitwise_count(bits[i] & ~folded(union, int(width[i]))).sum(dtype=np.int64) for i in own]
        live.append(own[high * (n[own] - np.array(alone)) >= low * n[own]])
    if not all(map(len, live)):
        return keep
    by_width = [(int(w), own := live[1][width[live[1]] == w], stack[own][:, :w]) for w in np.unique(width[live[1]])]
    for q in live[0]:
        for w, own, theirs in by_width:
            least = min(w, int(width[q]))
            a, b = folded(bits[q], least), folded(theirs, least)
            overlap = np.minimum(n[q] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), n[own] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
            hit = (labels[own] != labels[q]) & ((low + high) * overlap >= low * (n[q] + n[own]))
            if hit.any():
                keep[q] = True
                keep[own[hit]] = True
    return keep


def opened_pairs(batch: pd.DataFrame, ratio: tuple[int, int]) -> pd.DataFrame:
    """The rows g1, g2, side, _id and label of a batch of whole pairs of groups that may link."""
    batch = batch.sort_values(["g1", "g2"], kind="stable", ignore_index=True)
    g1, g2 = batch["g1"].to_numpy(), batch["g2"].to_numpy()
    side, labels, n = batch["side"].to_numpy(), batch["label"].to_numpy(), batch["n"].to_numpy()
    bits = [np.frombuffer(x, np.uint8) for x in batch["bits"]]
    starts = np.flatnonzero(np.concatenate([[True], (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]))
    keep = np.zeros(len(batch), dtype=bool)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
        keep[a:b] = opened(g1[a] == g2[a], side[a:b], labels[a:b], n[a:b], bits[a:b], ratio)
    return batch.loc[keep, ["g1", "g2", "side", "_id", "label"]]


def tokens_of(docs: DataFrame, words: int) -> DataFrame:
    """_id, n and tokens: the sorted hashes as bytes."""

    @frugal
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.hashes(t) for t in batch.pop("_text")]
            yield batch.assign(n=[len(x) for x in sets], tokens=[x.tobytes() for x in sets])

    return docs.mapInPandas(rows, f"_id {docs.schema['_id'].dataType.simpleString()}, n long, tokens binary")


def least_shared(large: Column, small: Column, ratio: tuple[int, int]) -> Column:
    """How many prefix tokens two linked sets share at least, if their sizes lie between these two.

    Of the overlap o that a link asks for, all but the last o - k tokens in the common order lie within the first
    n - o + k of a set of n. The prefix has n - ceil(r * n) + 1 tokens, so that k = o - ceil(r * n) + 1 of them are shared. The
    value falls as the larger size grows and rises with the smaller one; one less makes up for rounding in between.
    """
    low, high = ratio
    small = F.greatest(small, F.ceil(large * low / high))
    overlap = F.ceil((large + small) * low / (low + high))
    return F.greatest(F.lit(1), overlap - F.ceil(large * low / high) - 1)


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row (_id, _text) for each of the ids; slots keep most other texts out before the shuffle."""
    ids = ids.select(F.col("_id").alias("_want")).distinct()
    near = docs.select("_id", "_text").join(slots_of(ids, "_want"), slot("_id") == F.col("_slot"), "left_semi")
    return near.join(ids, F.col("_id") == F.col("_want"), "left_semi").dropDuplicates(["_id"])


def linked(x: np.ndarray, y: np.ndarray, ratio: tuple[int, int]) -> bool:
    """Whether two sorted sets of hashes link."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    same = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
    return same > 0 and ratio[1] * same >= ratio[0] * (len(x) + len(y) - same)


def compare_groups(batch: pd.DataFrame, ratio: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between two groups (or within one): rows with g1, g2, side, _id, label and tokens.

    The matrix of the documents and the tokens of both groups' unions gives all overlaps as products, a block of tokens at a
    time. Members with one label are linked already. Of the links found here those are returned that join what isn't
    joined yet, by earlier ones of the same two groups.
    """
    low, high = ratio
    sets = [np.frombuffer(t, dtype=np.uint64) for t in batch["tokens"]]
    side, ids, labels = batch["side"].to_numpy(), batch["_id"].to_numpy(), batch["label"].to_numpy()
    queries, members = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if batch["g1"].iloc[0] == batch["g2"].iloc[0]:
        members = queries
    if not len(queries) or not len(members):
        return []
    union = np.intersect1d(np.concatenate([sets[i] for i in queries]), np.concatenate([sets[i] for i in members]))
    sizes = np.array([len(x) for x in sets])
    if not len(union):
        return []

    def matrix(rows: np.ndarray, a: int, b: int) -> np.ndarray:
        out = np.zeros((len(rows), b - a), np.float32)
        for k, i in enumerate(rows):
            at = np.searchsorted(union[a:b], sets[i])
            at = at[union[a:b][np.minimum(at, b - a - 1)] == sets[i]]
            out[k, at] = 1
        return out

    same, step = np.zeros((len(queries), len(members)), np.float64), max(1, 8_000_000 // (len(queries) + len(members)))
    for a in range(0, len(union), step):
        b = min(a + step, len(union))
        left = matrix(queries, a, b)
        same += left @ (left if members is queries else matrix(members, a, b)).T
    root = {x: x for x in labels.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for q, m in zip(*np.nonzero(high * same >= low * (sizes[queries][:, None] + sizes[members][None, :] - same)), strict=True):
        a, b = find(int(labels[queries[q]])), find(int(labels[members[m]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            found.append((int(ids[queries[q]]), int(ids[members[m]])))
    return found


def jaccard_classes(df: DataFrame, words: int = 5, ratio: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles and component_id, the smallest id that links reach.

    Two documents link when ratio[1] * intersection >= ratio[0] * union of their sets of `words`-word shingles. Null text
    is empty; a text without words has n_shingles 0 and is linked with nothing. Rows that repeat an id are in one component,
    even if their texts differ. Ids must be integers; a row without one is no node, and its component is the smallest id
    with an equal set, or null. Other columns are ignored. An empty table gives an empty result.
    """
    low, high = ratio
    small_batches(df)
    docs, names = numbered(df.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")))
    base = written(token_rows(docs, words, rarity_levels(docs, words), ratio))

    # Nodes: the smallest id of each set.
    sets = base.where("n > 0").groupBy("h1", "h2").agg(F.min("_id").alias("rep"))
    of = base.alias("b").join(sets.alias("s"), (F.col("b.h1") == F.col("s.h1")) & (F.col("b.h2") == F.col("s.h2")), "left").select("b._id", "b._of", "b.n", "s.rep")
    copies = of.where("rep <> _id").select(F.col("_id").alias("_copy"))

    # Postings of prefix tokens that more than one node has, with the smallest node of about the same size as leader.
    class_of = F.floor(F.log(F.col("n").cast("double")) / float(np.log(high / low))) if low < high else F.lit(0)
    posts = base.select("_id", "n", F.explode("prefix").alias("token"))
    several = lambda df, c="_id": df.groupBy(F.col("token").alias("_t")).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi")).where("_lo < _hi").select("_t")
    posts = posts.join(several(posts), F.col("token") == F.col("_t")).drop("_t").join(copies, F.col("_id") == F.col("_copy"), "left_anti").distinct()
    posts = posts.join(several(posts), F.col("token") == F.col("_t"), "left_semi")
    posts = written(posts.select("token", "_id", "n", class_of.cast("int").alias("size")))

    # First round: each node against leaders with which it shares at least half of the tokens that a link asks for.
    leaders = posts.groupBy(F.col("token").alias("_t"), F.col("size").alias("_s")).agg(F.min(F.struct("_id", "n")).alias("lead"))
    pairs = posts.join(leaders, (F.col("token") == F.col("_t")) & (F.col("size") == F.col("_s"))).where("lead._id <> _id")
    pairs = pairs.groupBy("_id", "n", F.col("lead._id").alias("lead"), F.col("lead.n").alias("ln")).agg(F.count("*").alias("m"))
    pairs = written(pairs.where(2 * F.col("m") >= least_shared(F.greatest("n", "ln"), F.least("n", "ln"), ratio)).select("_id", "lead"))
    tokens = written(tokens_of(chosen(docs, pairs.select("_id").unionByName(pairs.select(F.col("lead").alias("_id")))), words))

    @frugal
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), ratio) for x, y in zip(batch["tokens"], batch["lead_tokens"], strict=True)]
            yield batch.loc[ok, ["_id", "lead"]]

    lead_tokens = tokens.select(F.col("_id").alias("_l"), F.col("tokens").alias("lead_tokens"))
    both = pairs.join(tokens.select("_id", "tokens"), "_id").join(lead_tokens, F.col("lead") == F.col("_l"))
    first = written(both.select("_id", "lead", "tokens", "lead_tokens").mapInPandas(check, "_id long, lead long"))

    # Groups: nodes with one leader, those already linked by themselves, in chunks of GROUP_SIZE.
    label = first.groupBy("_id").agg(F.min("lead").alias("label"))
    family = pairs.groupBy(F.col("_id").alias("_f")).agg(F.min("lead").alias("family"))
    nodes = posts.select(F.col("_id").alias("_want")).distinct().join(label, F.col("_want") == F.col("_id"), "left").drop("_id").join(family, F.col("_want") == F.col("_f"), "left")
    nodes = nodes.select(F.col("_want").alias("_id"), F.least("_want", "label").alias("label"), F.least("_want", "family").alias("family"))
    many = nodes.groupBy(F.col("family").alias("_f"), F.col("label").alias("_l")).agg(F.count("*").alias("_m"))
    nodes = nodes.join(many, (F.col("family") == F.col("_f")) & (F.col("label") == F.col("_l")))
    nodes = nodes.select("_id", "label", "family", F.when(F.col("_m") >= GROUP_SIZE, F.col("label")).otherwise(-1).alias("own"))
    size = nodes.groupBy(F.col("family").alias("_f"), F.col("own").alias("_o")).agg(F.ceil(F.count("*") / GROUP_SIZE).alias("_m"))
    nodes = nodes.join(size, (F.col("family") == F.col("_f")) & (F.col("own") == F.col("_o")))
    nodes = written(nodes.select("_id", "label", F.xxhash64("family", "own", F.pmod(F.xxhash64("_id"), F.col("_m"))).alias("gid")))

    # The matrix, and the groups that meet in as many tokens as a link of documents of their sizes asks for.
    matrix = posts.join(nodes, "_id").groupBy("token", "gid").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    mixed = matrix.groupBy(F.col("token").alias("_t")).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).where("_lo < _hi").select("_t")
    matrix = written(matrix.join(mixed, F.col("token") == F.col("_t"), "left_semi"))
    x, y = matrix.alias("x"), matrix.alias("y")
    open_ = (F.col("x.gid") <= F.col("y.gid")) & (F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi"))
    fits = (F.col("x.most") * high >= F.col("y.least") * low) & (F.col("y.most") * high >= F.col("x.least") * low)
    meet = x.join(y, (F.col("x.token") == F.col("y.token")) & open_ & fits).groupBy(F.col("x.gid").alias("g1"), F.col("y.gid").alias("g2")).agg(
        F.count("*").alias("m"), F.max(F.greatest("x.most", "y.most")).alias("most"), F.min(F.least("x.least", "y.least")).alias("least")
    )
    meet = written(meet.where(F.col("m") >= least_shared(F.col("most"), F.col("least"), ratio)).select("g1", "g2"))

    # Second round: the groups that meet.
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("g1").alias("gid")), F.struct(F.lit(1).alias("side"), F.col("g2").alias("gid")))).alias("e")
    sides = meet.select("g1", "g2", side).select("g1", "g2", "e.side", "e.gid").where((F.col("side") == 0) | (F.col("g1") != F.col("g2")))
    marked = nodes.join(sides.select("gid").distinct(), "gid", "left_semi").join(base.select("_id", "n", "bits"), "_id")
    # Many pairs of groups a call; a pair is whole in one.
    bucket = F.pmod(F.xxhash64("g1", "g2"), F.lit(max(1, meet.count() // PAIRS))).alias("_bucket")
    close = sides.join(marked, "gid").groupBy(bucket).applyInPandas(lambda batch: opened_pairs(batch, ratio), "g1 long, g2 long, side int, _id long, label long")
    close = written(close)
    members = written(tokens_of(chosen(docs, close.select("_id")), words).select("_id", "tokens"))
    second = close.join(members, "_id").groupBy("g1", "g2").applyInPandas(
        lambda batch: pd.DataFrame(compare_groups(batch, ratio), columns=["_id", "lead"]), "_id long, lead long"
    )
    links = first.unionByName(second)
    if names is not None:  # keys of one id belong together
        least = names.groupBy("_o").agg(F.min("_key").alias("_first"))
        own = names.join(least, "_o").where("_key <> _first").select(F.col("_key").alias("_id"), F.col("_first").alias("lead"))
        same = own.join(of.select("_id", "rep"), "_id").select("rep", "lead").join(of.select(F.col("_id").alias("lead"), F.col("rep").alias("lead_rep")), "lead")
        links = links.unionByName(same.where("rep IS NOT NULL AND lead_rep IS NOT NULL").select(F.col("rep").alias("_id"), F.col("lead_rep").alias("lead")))
    links = written(links)
    graph = components(links, "_id", "lead")
    out = of.join(graph, F.col("rep") == F.col("node"), "left").select("_of", "n", F.coalesce("component", "rep", "_id").alias("_component"))
    if names is not None:
        out = out.join(names, F.col("_component") == F.col("_key"), "left").withColumn("_component", F.col("_o"))
    kind = df.schema[id_col].dataType
    out = out.select(F.col("_of").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("_component").cast(kind).alias("component_id"))
    out = written(out)
    drop_written(base, posts, pairs, tokens, first, nodes, matrix, meet, close, members, links, graph)
    return out


def one_of_each(df: DataFrame, words: int = 5, ratio: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, with all their columns, whatever their names; rows without an id stay."""
    classes = jaccard_classes(df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), words, ratio, "_id", "_text")
    others = written(classes.where("component_id <> _id").select("_id").distinct())
    return without(as_row(df, id_col, text_col).select("_id", "_row"), others).select("_row.*")
