"""Sampled segmentations of texts into pieces of a SentencePiece vocabulary, without replacement, and their decoding.

A text's lattice is that of its words in a row: pieces begin with the word mark or stand within a word. Top-down, each
choice (the next piece of a word) has a probability, and the probability of a segmentation is the product of its choices.
A* search over subsets of segmentations: the whole has a Gumbel value of location 0; when the best subset is taken from
the queue, one segmentation is drawn from it and gets its value, and the rest of it is split by the first choice that
differs, each part with a Gumbel value truncated at the one above. What comes out in order are the k best of all
segmentations by perturbed log-probability: a sample without replacement.

The lattices of the distinct words of some texts are one set of numpy arrays, and the choices of all these texts are drawn
together, place by place. Random numbers are hashes of the row's key, the draw, the word's place in the text and the place
in the word, so that what is drawn together makes no difference.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches, text_of
from .shingles import mixed

MARK = "▁"
#: Characters of texts that are drawn together, about; choices of a segmentation that become parts of their own at once.
TOGETHER, AHEAD = 2_000_000, 4
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Pieces:
    """The pieces of a model file as a trie, with the logarithms of their weights.

    A piece of id i has weight (i - bytes + 10) ** -alpha, as the file's pieces are in the order of their merges: a rank in
    place of a count. A character that no piece has is written as its bytes, with the weight of the last piece for each.
    The trie's edges (node and character to node) are kept in a hash table of numpy arrays.
    """

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        with open(model, "rb") as f:
            own = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        self.byte = {int(x[3:5], 16): i for i, x in enumerate(names) if re.fullmatch(r"<0x[0-9A-F]{2}>", x)}
        first = max(self.byte.values()) + 1
        self.rare = -alpha * math.log(len(names) + 10)
        edges: dict[tuple[int, int], int] = {}
        piece, weight = [-1], [0.0]
        for i, x in enumerate(names):
            if i >= first and MARK not in x[1:]:
                node = 0
                for c in map(ord, x):
                    node = edges.setdefault((node, c), len(piece))
                    if node == len(piece):
                        piece.append(-1)
                        weight.append(0.0)
                piece[node], weight[node] = i, -alpha * math.log(i - first + 10)
        self.piece, self.weight = np.array(piece, np.int32), np.array(weight)
        keys, to = np.array([n << 21 | c for n, c in edges], np.uint64), np.array(list(edges.values()), np.int32)
        self.bits = int(4 * len(keys)).bit_length()
        self.keys, self.to, self.probes = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << self.bits, -1, np.int32), 1
        for key, at, node in zip(keys.tolist(), self.home(keys).tolist(), to.tolist(), strict=True):
            tries = 1
            while self.to[at] >= 0:
                at, tries = (at + 1) & ((1 << self.bits) - 1), tries + 1
            self.keys[at], self.to[at], self.probes = key, node, max(self.probes, tries)
        self.text, self.raw = dict(enumerate(names)), {i: b for b, i in self.byte.items()}

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _STEP) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node after each node and character, or -1."""
        keys = nodes.astype(np.uint64) << np.uint64(21) | chars
        at = self.home(keys)
        found = np.where(self.keys[at] == keys, self.to[at], -1)
        open_ = np.flatnonzero((found < 0) & (self.to[at] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[open_]] == keys[open_]
            found[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (self.to[at[open_]] >= 0)]
        return found

    def decode(self, ids: bytes) -> str:
        """The text of ids."""
        out, raw = bytearray(), self.raw
        for i in np.frombuffer(ids, dtype="<u4").tolist():
            out += bytes([raw[i]]) if i in raw else self.text[i].replace(MARK, " ").encode()
        return out.decode("utf-8", "surrogatepass")[1:]


class Lattice:
    """The choices at each place of some words.

    Places are numbered by their distance from the word's end, so that the mass of a place (the weight of all
    segmentations from there on) follows from lower ones; the end of any word is the last number. Of place n the choices
    are those from start[n] up to start[n + 1]: after, the place each leads to, its log-probability log, within the place
    the running sum cum of probabilities, and its ids. first has the place where each word begins.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        text = MARK + MARK.join(words) if words else ""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, length = len(chars), np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(length) - length
        left = np.repeat(begin + length, length) - np.arange(n)  # characters from a place to its word's end
        order = np.argsort(left, kind="stable")
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        self.first, self.end = number[begin], n
        inner = np.ones(n, bool)
        inner[begin] = False
        at = np.flatnonzero(~(inner & (chars == ord(MARK))))
        nodes, depth, found = np.zeros(len(at), np.int32), 0, []
        single = np.zeros(n, bool)
        while len(at):
            nodes = pieces.step(nodes, chars[at + depth])
            depth += 1
            live = nodes >= 0
            at, nodes = at[live], nodes[live]
            whole = pieces.piece[nodes] >= 0
            if depth == 1:
                single[at[whole]] = True
            found.append((at[whole], np.full(int(whole.sum()), depth), pieces.weight[nodes[whole]], pieces.piece[nodes[whole]]))
            more = left[at] > depth
            at, nodes = at[more], nodes[more]
        # Characters that are no piece, as bytes: id -1 - x for the x-th of them, whose bytes are from byte_start[x] on.
        bare = np.flatnonzero(~single)
        odd, which = np.unique(chars[bare], return_inverse=True)
        data = [chr(c).encode("utf-8", "surrogatepass") for c in odd.tolist()]
        self.byte_count = np.array([len(x) for x in data], np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count
        self.byte_ids = np.array([pieces.byte[b] for x in data for b in x], np.int32)
        found.append((bare, np.ones(len(bare), np.int64), self.byte_count[which] * pieces.rare, -1 - which.astype(np.int32)))
        source = number[np.concatenate([x[0] for x in found])]
        counts = np.bincount(source, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        filled, m = self.start[:-1].copy(), int(self.start[-1])
        after, log, self.ids = np.empty(m, np.int64), np.empty(m), np.empty(m, np.int32)
        for places, steps, weights, ids in found:
            mine = number[places]
            to = filled[mine]
            filled[mine] += 1
            after[to] = np.where(left[places] == steps, n, number[np.minimum(places + steps, n - 1)])
            log[to], self.ids[to] = weights, ids
        self.after = after
        # Masses, from the ends of words on.
        mass, edge = np.zeros(n + 1), np.searchsorted(left[order], np.arange(1, (int(left.max()) if n else 0) + 2))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            low, high = self.start[a], self.start[b]
            x = log[low:high] + mass[after[low:high]]
            starts, many = self.start[a:b] - low, counts[a:b]
            top = np.maximum.reduceat(x, starts)
            mass[a:b] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many)), starts))
            log[low:high] = x - np.repeat(mass[a:b], many)
        self.log = np.minimum(log, 0.0)
        run = np.concatenate([[0.0], np.cumsum(np.exp(self.log))])
        self.cum = run[1:] - np.repeat(run[self.start[:-1]], counts)
        self.cum[self.start[1:] - 1] = 2.0

    def drawn(self, places: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each place to its word's end: the choices of all, one place's after the other's, and how many each has."""
        of, at, state, steps = np.arange(len(places)), places, seeds, []
        live = at < self.end
        while True:
            of, at, state = of[live], at[live], state[live] + _STEP
            if not len(of):
                break
            x = (state ^ (state >> np.uint64(30))) * _SPREAD
            u = ((x ^ (x >> np.uint64(27))) * _STEP >> np.uint64(11)).astype(np.float64) * 2.0**-53
            choice = self.start[at]
            open_ = np.flatnonzero(u >= self.cum[choice])
            while len(open_):
                choice[open_] += 1
                open_ = open_[u[open_] >= self.cum[choice[open_]]]
            steps.append((of, choice))
            at = self.after[choice]
            live = at < self.end
        counts = np.zeros(len(places), np.int64)
        for of, _ in steps:
            counts[of] += 1
        to = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for k, (of, choice) in enumerate(steps):
            out[to[of] + k] = choice
        return out, counts

    def ids_of(self, choices: np.ndarray) -> bytes:
        """The ids of some choices, little-endian unsigned 32-bit."""
        ids = self.ids[choices]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            which, counts = -1 - ids[odd], np.ones(len(ids), np.int64)
            counts[odd] = self.byte_count[which]
            to = np.cumsum(counts) - counts
            ids = np.repeat(ids, counts)
            inner = np.arange(int(counts[odd].sum())) - np.repeat(np.cumsum(counts[odd]) - counts[odd], counts[odd])
            ids[np.repeat(to[odd], counts[odd]) + inner] = self.byte_ids[np.repeat(self.byte_start[which], counts[odd]) + inner]
        return ids.astype("<u4").tobytes()


class Index(dict):
    """Numbers of distinct words."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Search:
    """The search in one text: what has come out (choices, number of choices of each word, log-probability, value) and the queue of parts.

    A part is (value, serial, sample, low, high, barred): the segmentations that first differ from that sample at a choice
    from low up to high; where that is one choice, barred has those that are taken there.
    """

    def __init__(self, key: int):
        self.rng = np.random.Generator(np.random.PCG64(key))
        self.out: list[tuple[np.ndarray, np.ndarray, float, float]] = []
        self.queue: list[tuple] = []
        self.serial = 0

    def push(self, location: float, above: float, part: tuple) -> None:
        if location > -math.inf:
            value = -float(np.logaddexp(-above, -(location + self.rng.gumbel())))
            self.serial += 1
            heapq.heappush(self.queue, (-value, self.serial, *part))

    def split(self, lattice: Lattice, low: int, taken: frozenset[int]) -> None:
        """Parts of what first differs from the last sample at `low` or later; at `low`, the choices in `taken` are out."""
        choices, _, _, value = self.out[-1]
        own, k = lattice.log[choices], len(self.out) - 1
        before = float(own[:low].sum())
        for c in range(low, min(low + AHEAD, len(own))):
            place = int(np.searchsorted(lattice.start, choices[c], side="right")) - 1
            barred = taken if c == low else frozenset({int(choices[c])})
            rest = [x for e, x in enumerate(lattice.log[lattice.start[place] : lattice.start[place + 1]].tolist(), int(lattice.start[place])) if e not in barred]
            if rest and (top := max(rest)) > -math.inf:
                self.push(before + top + math.log(sum(math.exp(x - top) for x in rest)), value, (k, c, c + 1, barred))
            before += float(own[c])
        if low + AHEAD < len(own):
            self.push_range(lattice, k, low + AHEAD, len(own), value)

    def push_range(self, lattice: Lattice, sample: int, low: int, high: int, above: float) -> None:
        """One part for all that first differ at a choice from low up to high."""
        own = lattice.log[self.out[sample][0][:high]]
        inside = float(own[low:].sum())
        if low < high and inside < 0:
            self.push(float(own[:low].sum()) + math.log(-math.expm1(inside)), above, (sample, low, high, frozenset()))

    def popped(self, lattice: Lattice) -> tuple[float, int, int, int, frozenset[int]] | None:
        """Value, sample, choice at which the next segmentation differs, what stands there instead, and what is barred there."""
        if not self.queue:
            return None
        value, _, k, low, high, barred = heapq.heappop(self.queue)
        value, choices = -value, self.out[k][0]
        if high - low > 1:
            # Which choice differs first; the parts on either side stay in the queue.
            own = lattice.log[choices[low:high]]
            mass = np.exp(np.concatenate([[0.0], own.cumsum()[:-1]])) * -np.expm1(own)
            c = low + min(high - low - 1, int(np.searchsorted(mass.cumsum(), self.rng.random() * mass.sum(), side="right")))
            self.push_range(lattice, k, low, c, value)
            self.push_range(lattice, k, c + 1, high, value)
            low, barred = c, frozenset({int(choices[c])})
        place = int(np.searchsorted(lattice.start, choices[low], side="right")) - 1
        free = [e for e in range(int(lattice.start[place]), int(lattice.start[place + 1])) if e not in barred]
        weights = np.exp(lattice.log[free])
        instead = free[min(len(free) - 1, int(np.searchsorted(weights.cumsum(), self.rng.random() * weights.sum(), side="right")))]
        return value, k, low, instead, barred


def sampled(pieces: Pieces, texts: list[str], keys: list[int], k: int) -> list[list[tuple[bytes, float, float, float]]]:
    """For each text up to k distinct segmentations, best first: ids, log-probability, perturbed value and logarithm of the inclusion score.

    The inclusion score is the probability that a segmentation's perturbed value exceeds the best value of what is left.
    """
    index = Index()
    words = [np.array(list(map(index.__getitem__, t.split(" "))), np.int64) for t in texts]
    lattice = Lattice(pieces, list(index))
    searches, seeds = [Search(key) for key in keys], np.array(keys, np.uint64)

    def seeds_of(at: np.ndarray, doc: np.ndarray, turn: int) -> np.ndarray:
        return mixed(seeds[doc] + mixed(at.astype(np.uint64) * _STEP + np.uint64(turn)))

    for turn in range(k):
        # Where each text's next segmentation leaves an earlier one, and the words that are drawn from there on.
        left, starts, first, kept = [], [], [], []
        for i, search in enumerate(searches):
            if turn == 0:
                left.append((i, float(search.rng.gumbel()), 0, frozenset()))
                starts.append(lattice.first[words[i]])
                first.append(0)
                kept.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            elif (found := search.popped(lattice)) is not None:
                value, of, c, instead, barred = found
                choices, counts = search.out[of][:2]
                word = int(np.searchsorted(np.cumsum(counts), c, side="right"))
                left.append((i, value, c, barred | {instead}))
                starts.append(np.concatenate([lattice.after[[instead]], lattice.first[words[i][word + 1 :]]]))
                first.append(word)
                own = counts[: word + 1].copy()
                own[word] = c + 1 - int(counts[:word].sum())
                kept.append((np.append(choices[:c], instead), own))
        if not left:
            break
        sizes = np.array([len(x) for x in starts])
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - np.array(first), sizes)
        doc = np.repeat(np.array([x[0] for x in left]), sizes)
        drawn, many = lattice.drawn(np.concatenate(starts), seeds_of(at, doc, turn))
        ends = np.cumsum(sizes)
        cuts = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], ends])]
        for j, (i, value, c, taken) in enumerate(left):
            before, own = kept[j]
            counts = many[ends[j] - sizes[j] : ends[j]]
            if len(own):  # the word in which it differs is partly kept
                counts = np.concatenate([own[:-1], [own[-1] + counts[0]], counts[1:]])
            choices = np.concatenate([before, drawn[cuts[j] : cuts[j + 1]]])
            search = searches[i]
            search.out.append((choices, counts, float(lattice.log[choices].sum()), value))
            search.split(lattice, c, taken if len(taken) else frozenset({int(choices[0])}) if len(choices) else taken)
    scored = []
    for search in searches:
        edge = -search.queue[0][0] if search.queue else -math.inf
        rows = []
        for choices, _, log, value in search.out:
            x = log - edge
            rows.append((lattice.ids_of(choices), log, value, 0.0 if x > 30 or edge == -math.inf else x if x < -30 else math.log(-math.expm1(-math.exp(x)))))
        scored.append(rows)
    return scored


def sampled_segmentations(df: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each input row its first k sampled segmentations: id, rank (from 0), ids (binary), n_pieces, log_prob, perturbed, log_inclusion.

    The random numbers of a row follow from its id and the seed alone, so that a row has the same segmentations in any
    partition, and repeated rows have equal ones; so have all rows with a null id and the same text. Null text is empty; an
    empty text has the segmentations of the leading mark. Texts with fewer than k segmentations give all they have.
    Decoding the ids gives the text. model is the path of a piece file that all executors have. Other columns are ignored.
    """
    kind = df.schema[id_col].dataType

    @frugal
    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(model, alpha)

        def rows(docs: list[str | None], texts: list[str]) -> pd.DataFrame:
            found = sampled(pieces, texts, [xxhash.xxh3_64_intdigest(f"{seed} {d}") for d in docs], k)
            out = [(d, r, ids, len(ids) // 4, *more) for d, own in zip(docs, found, strict=True) for r, (ids, *more) in enumerate(own)]
            return pd.DataFrame(out, columns=["_id", "rank", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion"])

        for batch in batches:
            docs, texts, size = [], [], 0
            for doc, text in zip(batch["_id"], batch["_text"], strict=True):
                docs.append(doc)
                texts.append(text)
                size += len(text)
                if size >= TOGETHER:
                    yield rows(docs, texts)
                    docs, texts, size = [], [], 0
            if docs:
                yield rows(docs, texts)

    small_batches(df)
    # The id goes as text, as pandas would round integers beside a null.
    rows = df.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("_text"))
    out = rows.mapInPandas(sample, "_id string, rank int, ids binary, n_pieces long, log_prob double, perturbed double, log_inclusion double")
    return out.withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", id_col)


def decoded(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The table with the text of each row's ids; null ids give null."""

    @F.pandas_udf("string")
    @frugal
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model, 1.0)
        for ids in batches:
            yield pd.Series([None if x is None else pieces.decode(x) for x in ids], dtype=object)

    return df.drop(text_col).withColumn(text_col, decode(F.col(ids_col)))
