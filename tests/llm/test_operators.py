"""Training-data operators on small tables, against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from auditloom.llm import exact_dedup, fingerprint, html_extract, jaccard_join, license_scan, ngram_lm, packing, quality, repeats, sampled_pieces
from auditloom.llm.components import components
from pyspark.sql import functions as F

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, _id string, _text int"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages, odd white space, accents, and one long document."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 40)
    out = [None, "", " ", "a", "b\tc", "é̂ 日本 x", base, base, base.replace(" ", "  "), base.replace(" ", "\n")]
    for _ in range(12):
        w = base.split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)
        out.append(" ".join(w))
    out += [f"{words(rng, 30)}\n{passage}\n{words(rng, 25)}" for _ in range(8)] + [words(rng, rng.randrange(1, 60)) for _ in range(10)]
    out += ["zz " * 100, "zz " * 100 + "end", words(rng, 4000), "Licensed under CC BY-NC 4.0.\nAll rights reserved. CC BY cc by", "The GNU General Public License; general public license"]
    return [(i, t, "clash", 7) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("bits", [128, 1])
def test_exact_groups(docs, empty, bits, monkeypatch):
    if bits == 1:  # nearly all texts collide
        monkeypatch.setattr(exact_dedup, "content_key", lambda t: F.unhex(F.concat(F.lit("0"), F.pmod(F.length(t), F.lit(2)).cast("string"))))
    got, norm = rows(exact_dedup.exact_groups(docs)), {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in corpus()}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), i == min(same))
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in norm if got[i]["kept"])
    same = exact_dedup.copies(docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")))
    first = {}
    assert sorted(r._id for r in same.collect()) == [i for i, t, *_ in corpus() if first.setdefault(t or "", i) != i]


def shingle_sets(k):
    out = {}
    for i, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize(("k", "ratio"), [(4, (85, 100)), (5, (80, 100)), (2, (1, 2))])
@pytest.mark.parametrize("group", [48, 2])
def test_jaccard_classes(docs, k, ratio, group, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SIZE", group)
    sets = shingle_sets(k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (both := len(sets[i] & sets[j])) and ratio[1] * both >= ratio[0] * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = rows(jaccard_join.jaccard_classes(docs, k, ratio))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_of_empty_table(empty):
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(30)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and all(x in got or root[x] == x for x in root)


@pytest.mark.parametrize(("hot", "together", "segment"), [(2000, 16_000, 1 << 22), (2, 50, 1 << 10)])
def test_repeats(docs, empty, hot, together, segment, monkeypatch):
    for name, value in (("HOT", hot), ("TOGETHER", together), ("SEGMENT", segment)):
        monkeypatch.setattr(repeats, name, value)
    got, seen = rows(repeats.repeat_report(docs)), set()
    cut = {}
    for i, t, *_ in corpus():
        data, marks = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                marks[s : s + 100] = True
            seen.add(data[s : s + 100])
        kept = bytes(b for b, m in zip(data, marks, strict=True) if not m)
        spans = int((marks & ~np.concatenate([[False], marks[:-1]])).sum()) if len(marks) else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(data), int(marks.sum()), spans, hashlib.sha256(kept).hexdigest()), i
        cut[i] = t if not marks.any() else kept.decode()
    assert {i: r["text"] for i, r in rows(repeats.drop_repeats(docs)).items()} == cut
    assert repeats.repeat_report(empty).count() == 0


def test_suffix_sort_is_lexicographic_and_survives_bad_hashes(monkeypatch):
    rng = np.random.default_rng(3)
    data, group = rng.integers(0, 3, (300, 20)).astype(np.uint8), np.sort(rng.integers(0, 9, 300))
    for base in (repeats._BASE, np.uint64(0)):  # with base 0 all prefixes collide
        monkeypatch.setattr(repeats, "_BASE", base)
        order, prefix = repeats.bounded_suffix_sort(data, group)
        keys = [(group[i], data[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for k in range(1, 300):
            a, b = data[order[k - 1]], data[order[k]]
            same = next((j for j in range(20) if a[j] != b[j]), 20) if group[order[k]] == group[order[k - 1]] else 0
            assert prefix[k] == same


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = packing.pack_documents(docs, BPE).collect()
    for i, t, *_ in corpus():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        for r in own:
            part = np.asarray(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= math.ceil(sum(filled.values()) / 2048) + 1
    assert packing.pack_documents(empty, BPE).count() == 0


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(BPE)
    rng = random.Random(2)
    odd = ["", " ", "\n", "a\n", "a\n\n", "a\n\nb", "a\n\n\nb", "a \nb", "a\n b", "a  b", " a", "a ", "a\tb c", "don't we'll", "x1y2 3,4", "日本 語", "é è", "a<|endoftext|>b", "a <|endoftext|> b", "a b c", "​x y"]
    odd += ["".join(rng.choice("ab'é1.,  \n\t-日") for _ in range(30)) for _ in range(300)]
    assert all(encoder.encode(t) == encoder.whole(t) for t in odd)


def test_sum_of_squares_chooses_the_smallest_sum():
    lengths, capacity = np.array([3, 5, 2, 7, 4, 6, 1, 8, 3, 5]), 8
    place, offset = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        total = lambda g: sum(n * n for x, n in Counter(g.values()).items() if 0 < x < capacity)
        sums = {b: total(gaps | {b: g - s}) for b, g in gaps.items() if g >= s} | {-1: total(gaps | {-1: capacity - s})}
        b = int(place[i])
        assert sums[b if b in gaps else -1] == min(sums.values())
        assert offset[i] == capacity - gaps.get(b, capacity)
        gaps[b] = gaps.get(b, capacity) - s


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    good = [(i, words(rng, rng.randrange(5, 200))) for i in range(0, 400, 2)]
    bad = [(i, "".join(f"{w}{rng.choice(['$$$', '%%%', '!!'])} " for w in words(rng, rng.randrange(5, 200)).split())) for i in range(1, 400, 2)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    net = quality.fit(table, labels, most=200)
    got = rows(quality.quality_scores(table, net))
    held = {i: r for i, r in got.items() if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(r["held_out"] == (i in held) for i, r in got.items())
    assert np.mean([r["predicted"] == (i % 2 == 0) for i, r in held.items()]) > 0.95
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in got.values())
    assert len(rows(quality.quality_scores(docs, net))) == len(corpus()) and quality.quality_scores(empty, net).count() == 0
    assert quality.quality_scores(docs, quality.fit(docs, labels.where("false"))).where("predicted = 1").count() == len(corpus())
    again = quality.fit(table, labels, most=200)
    assert np.array_equal(net.table, again.table)


def test_fingerprints(docs, empty):
    got, ordered = rows(fingerprint.edited_fingerprints(docs)), corpus()
    for k, (i, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if edited == t:
            assert got[i]["fingerprint"] == got[i]["edited_fingerprint"] and got[i]["near_edited"] == 1.0
    assert got[6]["fingerprint"] == got[7]["fingerprint"] == got[8]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for i, r in got.items() if i > 22])
    assert fingerprint.edited_fingerprints(empty).count() == 0


def test_fingerprints_of_hot_texts(spark):
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice((f"w{rng.randrange(6000)}", f"common{rng.randrange(60)}")) for _ in range(n))
    copies, near, other = some(300), some(300).split(), [some(200) for _ in range(120)]
    texts = []
    for i, t in enumerate(other):  # a third of the rows are copies, a third near copies
        near[7 * i % 300] = f"changed{i}"
        texts += [copies, t, " ".join(near).upper() if i % 2 else " ".join(near)]
    got = rows(fingerprint.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert all(re.search("[0-9a-f]", r["fingerprint"]) for r in got.values())
    assert len({got[i]["fingerprint"] for i in range(0, len(texts), 3)}) == 1
    assert max(r["near_next"] for r in got.values()) < 0.8
    for start in (0, 2):
        assert np.mean([got[i]["near_edited"] for i in range(start, len(texts), 3)]) > 0.3


def test_fingerprints_of_small_tables_tell_texts_apart(spark):
    texts = [f"w{i}" for i in range(9)] + [" ".join(f"t{j}x{i}" for j in range(60)) for i in range(9)]
    got = rows(fingerprint.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert len({r["fingerprint"] for r in got.values()}) == len(texts) and all(r["near_next"] < 1 for r in got.values())


def test_next_rows_over_ranges(spark):
    ids = [x * x for x in range(500)] + [1 << 62]
    got = {r._id: r._next for r in fingerprint.next_rows(spark.createDataFrame([(i,) for i in ids], "_id long")).collect()}
    assert got == dict(zip(ids, [*ids[1:], ids[0]], strict=True))


def own_fingerprint(text, lexicon):
    """The fingerprint and its parts by plain Python: xxHash64 as Spark chains it."""
    x64 = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed=seed)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    terms = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
    band = terms & lexicon
    counted = band if len(band) >= 0.25 * len(terms) else terms
    upper = {t: x64(t.encode()) & ~0xFFFF & (1 << 64) - 1 for t in terms}
    draw = lambda v, at: x64(at.to_bytes(4, "little"), x64(v.to_bytes(8, "little")))

    def member(v, k, at):
        return draw(v, 0) >> 4 * k & 15 == 0 and all(draw(v, x) >> 2 * k & 3 == 0 for x in range(1, at + 1))

    return terms, counted, upper, member


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    pool = [f"t{i}" for i in range(400)]
    texts = [" ".join(pool[min(399, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.randrange(0, 120))) for _ in range(80)] + ["same words here"] * 5 + ["", "one"]
    n_words = [" ".join(re.findall(r"[a-z0-9]+", t)) for t in texts]
    df_of = Counter(t for x in set(n_words) for t in set(x.split()))
    n = len(set(n_words))
    lexicon = {t for t, c in df_of.items() if 0.001 * n <= c <= 0.05 * n}
    got = rows(fingerprint.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    prints = {}
    for i, t in enumerate(texts):
        terms, counted, upper, member = own_fingerprint(t, lexicon)
        first = [[upper[x] for x in counted if member(upper[x], k, 0)] for k in range(16)]
        if terms and not any(first):  # the hash of all terms in each lexicon of the smallest scale
            assert len(got[i]["fingerprint"]) == 256 and re.fullmatch("([0-9a-f]{4}){16}.*", got[i]["fingerprint"])
            prints[i] = None
            continue
        parts = []
        for at in range(4):
            parts += [frozenset(v for v in own if member(v, k, at)) for k, own in enumerate(first)]
        cells = re.findall(".{4}", got[i]["fingerprint"])
        assert [c == "...." for c in cells] == [not p for p in parts]
        prints[i] = parts, cells
    seen = {}
    for own in prints.values():  # equal lexicon sets have equal hashes, others (but for chance) different ones
        for part, cell in zip(*own, strict=True) if own else ():
            assert seen.setdefault(part, cell) == cell
    assert len(set(seen.values())) > 0.98 * len(seen)
    for i, r in got.items():
        a, b = r["fingerprint"], got[(i + 1) % len(texts)]["fingerprint"]
        x, y, best = re.findall(".{4}", a), re.findall(".{4}", b), 0.0
        for s in range(4):
            pairs = [(p, q) for p, q in zip(x[16 * s : 16 * s + 16], y[16 * s : 16 * s + 16], strict=True) if (p, q) != ("....", "....")]
            best = max(best, sum(p == q for p, q in pairs) / len(pairs)) if len(pairs) >= 4 else best
        assert abs(r["near_next"] - (1.0 if a == b else best)) < 1e-9


def test_license_scan(docs, empty):
    got = rows(license_scan.license_scan(docs))
    for i, t, *_ in corpus():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for k in range(len(w)) for phrase, label in license_scan.PHRASES.items() if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        more = {label for line in (t or "").split("\n") for label, own in license_scan.template_tokens(license_scan.TEMPLATES).items()
                if len(set(own) & set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()))) >= math.ceil(0.9 * len(own))}
        assert r["labels"] == ",".join(sorted({p[1] for p in places} | more))
    assert license_scan.license_scan(empty).count() == 0


def test_license_notices_over_lines(spark):
    mit = license_scan.TEMPLATES["mit"].split()
    wrapped = ["\n".join(" ".join(mit[k : k + 6]) for k in range(0, len(mit), 6)), "x y\n" * 40 + "# " + "\n# ".join(license_scan.TEMPLATES["gpl-notice"].split())]
    far = " ".join(f"{w} " + "filler " * 60 for w in license_scan.TEMPLATES["copyright"].split())
    texts = [*wrapped, far, "Copyright (c) 2020 J. Smith\nand others. All\nrights reserved.", *(f"{'pad ' * n}{wrapped[0]} {'pad ' * 300}" for n in range(0, 160, 9))]
    got = rows(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["labels"] for i in range(4)] == ["mit", "gpl,gpl-notice", "", "copyright,reserved"]
    assert all(got[i]["labels"] == "mit" and got[i]["score"] == 1.0 for i in range(4, len(texts)))


def test_native_operators_run_no_python(docs):
    for df in (exact_dedup.exact_groups(docs), license_scan.license_scan(docs), fingerprint.edited_fingerprints(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_backoff(docs, empty):
    got, own = rows(ngram_lm.backoff_scores(docs)), {i: (t or "").encode().lower().split() for i, t, *_ in corpus()}
    one, two = Counter(w for x in own.values() for w in x), Counter(p for x in own.values() for p in zip(x, x[1:], strict=False))
    for i, w in own.items():
        mine, pairs, total = Counter(w), Counter(zip(w, w[1:], strict=False)), 0.0
        for k, x in enumerate(w):
            c = one[x] - mine[x]
            score = (c if c > 0 else 0.4) / max(1, sum(one.values()) - len(w))
            if k:
                a, b = two[w[k - 1], x] - pairs[w[k - 1], x], one[w[k - 1]] - mine[w[k - 1]]
                score = min(1, a / b) if a > 0 and b > 0 else 0.4 * score
            total += math.log(score)
        assert got[i]["n_words"] == len(w) and abs(got[i]["score"] - total) < 1e-6 * max(1, abs(total))
    assert ngram_lm.backoff_scores(empty).count() == 0


def test_backoff_over_many_blocks(docs, monkeypatch):
    whole = rows(ngram_lm.backoff_scores(docs))
    monkeypatch.setattr(ngram_lm, "BLOCK_CHARS", 5000)
    parts = rows(ngram_lm.backoff_scores(docs))
    assert all(abs(whole[i]["score"] - parts[i]["score"]) < 1e-6 for i in whole)


def test_backoff_over_blocks_without_words_and_empty_slices(spark, monkeypatch):
    texts = ["a b a c", "", None, "  ", "b a b", "c " * 40]
    some = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = rows(ngram_lm.backoff_scores(some))
    monkeypatch.setattr(ngram_lm, "BLOCK_CHARS", 2)
    parts = rows(ngram_lm.backoff_scores(some))
    assert set(parts) == set(range(len(texts))) and [parts[i]["n_words"] for i in parts] == [whole[i]["n_words"] for i in parts]
    assert all(abs(whole[i]["score"] - parts[i]["score"]) < 1e-9 for i in whole)
    assert all(parts[i]["mean_score"] is None and parts[i]["score"] == 0 for i in (1, 2, 3))


def test_backoff_reads_the_texts_once_before_it_starts(spark, docs):
    def jobs(group, f):
        spark.sparkContext.setJobGroup(group, group)
        f()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    # Only the characters are summed beforehand; words are counted where their hashes are made.
    assert jobs("backoff", lambda: ngram_lm.backoff_scores(docs)) <= jobs("one sum", lambda: docs.agg(F.sum(F.length("text"))).first())


def test_backoff_hashes_a_block_for_little_more_than_splitting_it():
    def least(f):
        def once():
            begin = time.process_time()
            f()
            return time.process_time() - begin

        return min(once() for _ in range(7))

    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 12))) for _ in range(60000)]
    texts = [" ".join(r.choices(words, k=500)) for _ in range(800)]
    assert least(lambda: ngram_lm.block_counts(texts, 2)) < 4 * least(lambda: [t.encode().lower().split() for t in texts])


def test_backoff_tells_odd_words_apart(spark):
    odd = ["a", "A", "a\x00", "\x00", "é", "É", "exactly8", "exactly8\x00", "exactly88", "exactly89", "sixteen_sixteen_", "sixteen_sixteen_a", *("x" * n for n in (63, 64, 65, 300)), "x" * 64 + "y", "\x1c", "\u2003", "日本語" * 9]
    r = random.Random(3)
    texts = ["".join(r.choice(odd) + r.choice([" ", "\t", "\n ", "\x0b", "\x0c\r"]) for _ in range(r.randrange(30))) for _ in range(60)]
    got = rows(ngram_lm.backoff_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order=1))
    own = [t.encode().lower().split() for t in texts]
    one = Counter(w for x in own for w in x)
    for i, w in enumerate(own):
        mine, size = Counter(w), max(1, sum(one.values()) - len(w))
        assert got[i]["n_words"] == len(w) and abs(got[i]["score"] - sum(math.log((one[x] - mine[x] or 0.4) / size) for x in w)) < 1e-9


def test_places_are_exact_where_hashes_differ_in_low_bits():
    h = np.array([7, 6, 7, 6, 5, 1 << 60, 7, 1 << 63], np.uint64)
    assert ngram_lm.places(h).tolist() == [4, 1, 3, 0, 2, 6, 5, 7]


def test_segmentations_round_trip_and_are_distinct(docs, empty):
    found = sampled_pieces.sampled_segmentations(docs, PIECES, k=3)
    got = sampled_pieces.decoded(found, PIECES).collect()
    text = {i: t or "" for i, t, *_ in corpus()}
    assert all(r.text == text[r.doc_id] for r in got)
    assert len({(r.doc_id, bytes(r.ids)) for r in got}) == len(got) and {r.doc_id for r in got} == set(text)
    again = {(r.doc_id, r["rank"]): bytes(r.ids) for r in sampled_pieces.sampled_segmentations(docs.repartition(5), PIECES, k=3).collect()}
    assert again == {(r.doc_id, r["rank"]): bytes(r.ids) for r in got}
    assert sampled_pieces.sampled_segmentations(empty, PIECES).count() == 0


def all_segmentations(text):
    """Probability of each segmentation, as ids."""
    model = sampled_pieces.Pieces(PIECES, 1.0)
    names, first = {v: k for k, v in model.text.items()}, max(model.byte.values()) + 1
    marked, out = "▁" + text.replace(" ", "▁"), {}

    def walk(at, ids, weight):
        if at == len(marked):
            out[np.array(ids, "<u4").tobytes()] = weight
        for end in range(at + 1, len(marked) + 1):
            x = names.get(marked[at:end])
            if x is not None and x >= first and "▁" not in marked[at + 1 : end]:
                walk(end, [*ids, x], weight / (x - first + 10))

    walk(0, [], 1.0)
    return {k: w / sum(out.values()) for k, w in out.items()}


@pytest.mark.parametrize("ahead", [4, 1])
def test_samples_follow_the_probabilities(ahead, monkeypatch):
    monkeypatch.setattr(sampled_pieces, "AHEAD", ahead)
    pieces, n, p = sampled_pieces.Pieces(PIECES, 1.0), 6000, all_segmentations("hello at")
    first, second, included = Counter(), Counter(), Counter()
    found = sampled_pieces.sampled(pieces, ["hello at"] * n, [xxhash.xxh3_64_intdigest(str(i)) for i in range(n)], 2)
    for a, b in found:
        first[a[0]] += 1
        second[b[0]] += 1
        assert a[2] >= b[2] and a[0] != b[0]
        for ids, log, _, inclusion in (a, b):
            assert abs(math.exp(log) - p[ids]) < 1e-9
            included[ids] += math.exp(log - inclusion)
    for x, q in p.items():
        assert abs(first[x] / n - q) < 0.03
        assert abs(second[x] / n - sum(r * q / (1 - r) for y, r in p.items() if y != x)) < 0.03
        # Weighted by its inclusion score each sample stands for its probability: the estimate has no bias.
        assert abs(included[x] / n - q) < 0.05
    alone = [sampled_pieces.sampled(pieces, ["hello at"], [xxhash.xxh3_64_intdigest(str(i))], 2)[0] for i in range(20)]
    assert alone == found[:20]


def test_all_segmentations_come_out_once():
    pieces, p = sampled_pieces.Pieces(PIECES, 1.0), all_segmentations("at a")
    for key in range(30):
        ids = [x[0] for x in sampled_pieces.sampled(pieces, ["at a"], [key], 1000)[0]]
        assert len(ids) == len(set(ids)) == len(p) and set(ids) == set(p)


def test_long_words_keep_their_lattice():
    pieces = sampled_pieces.Pieces(PIECES, 1.0)
    for text in ("ab" * 3000, "é" * 500, "x▁y ▁", "\x00퟿", "日本語 𓀀𓀁 x", ""):
        for ids, log, *_ in sampled_pieces.sampled(pieces, [text], [7], 2)[0]:
            assert pieces.decode(ids) == text and math.isfinite(log)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="ad">Buy {0}</div><article><h1>Title {0}</h1><p><b>One &amp; {0}<br><p>Two   {0}
x</p><form><p>Sign up</p></form><aside>Also</aside><div class="comments"><p>Nice</p></div><p>Three&nbsp;{0} &lt;i&gt;</article><div class="cookie-notice">We use cookies</div><footer>&copy; F {0}</footer>"""


def test_main_texts(spark):
    pages = [(i, f"https://h{i % 2}.example.com/{i}", PAGE.format(f"n{i}"), "x") for i in range(12)] + [(20, None, None, "x"), (21, "x", "", "x"), (22, "http://one.example.org/", "<p>only</p> tail", "x"), (23, "http://one.example.org/a", "<article>cut <b", "x")]
    got = rows(html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string, _host string")), "page_id")
    for i in range(12):
        assert got[i]["text"] == f"Title n{i}\n\nOne & n{i}\n\nTwo n{i} x\n\nThree n{i} <i>"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert (got[20]["text"], got[21]["text"], got[22]["text"]) == ("", "", "only\n\ntail") and got[23]["text"].startswith("cut")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_texts(none).count() == 0


def test_hidden_elements_end_where_they_end():
    shown = lambda page: [x.text for x in html_extract.blocks_of(page)]
    assert shown('<p>one<svg-icon name="x"></svg-icon> two</p><p>three</p>') == ["one two", "three"]
    assert shown('<p>one<svg width="1"/> two</p><p>three</p>') == ["one two", "three"]
    assert shown("<p>one <svg><title>t</title><g><svg><path/></svg>u</g></svg>two</p><p>three</p>") == ["one two", "three"]
    assert shown("<div><p>one<select><option>x</div><p>three</p>") == ["one", "three"]
    assert shown("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert shown("<p>one<script-box>in</script-box></p><script>a</p></script><template><p>t</p></template><p>two") == ["onein", "two"]


def test_all_open_slots_are_kept(spark):
    post = '<body><div class="post"><h1>Title {0}</h1><p class="lead">Lead {0}</p><div class="body"><p>{1}</p></div></div><div class="more"><p>Rest {0} {2}</p></div><footer>F</footer></body>'
    pages = [(i, f"https://a.example.com/{i}", post.format(f"n{i}", f"text {i} " * 40, "tail " * (200 * (i == 3)))) for i in range(10)]
    pages += [(100 + i, f"https://b.example.com/{i}", f"<h1>Head {i}</h1><article><p>Story {i}</p></article>") for i in range(10)]
    got = rows(html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    for i in range(10):
        whole = [f"Title n{i}", f"Lead n{i}", (f"text {i} " * 40).strip(), f"Rest n{i} {'tail ' * (200 * (i == 3))}".strip()]
        assert got[i]["text"] == "\n\n".join(whole)
        assert got[100 + i]["text"] == f"Head {i}\n\nStory {i}"


def test_templates_decide(spark):
    """What names don't tell: constant notices, menus without a name, an article named like an aside."""
    rng = random.Random(3)
    prose = lambda n: words(rng, n)
    page = '<body><div class="x1"><a href="/a">Go {0}</a> <a href="/b">There {0}</a></div><div class="x2"><p>Read this first</p></div><div class="{2}"><p>{1}</p><div class="ad">Buy {0}</div></div><div class="x3"><p>By {0}</p></div></body>'
    bodies = {(h, i): prose(40) for h in ("a", "b") for i in range(5)}
    pages = [(10 * (h == "b") + i, f"https://{h}.example.com/{i}", page.format(f"n{i}", t, "x4" if h == "a" else "widget")) for (h, i), t in bodies.items()]
    pages += [(30 + k, f"https://a.example.com/{k}", pages[0][2]) for k in range(2)]  # repeated pages change nothing
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = rows(html_extract.main_texts(df), "page_id")
    for (h, i), t in bodies.items():
        assert got[10 * (h == "b") + i]["text"] == f"{t}\n\nBy n{i}"
    assert got[30]["text"] == got[31]["text"] == got[0]["text"]
    # Without classes the names alone would keep the notice and the menu, and lose the article of the second host.
    bare = html_extract.extract(pages[0][2], html_extract.Template())
    assert bare.startswith("Go n0 There n0\n\nRead this first") and bodies["b", 0] not in html_extract.extract(pages[5][2], html_extract.Template())


def test_few_pages_and_equal_pages_have_no_template(spark):
    pages = [(i, "https://h.example.com/", f"<p>same</p><p>same too</p><p>{i % 2}</p>") for i in range(8)]
    got = rows(html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")), "page_id")
    assert all(got[i]["text"] == f"same\n\nsame too\n\n{i % 2}" for i in got)


def test_null_ids_leave_others_alone(spark):
    base = 1 << 60
    some = spark.createDataFrame([(base + 1, "one two"), (None, "three"), (base + 3, "four five six"), (base + 3, "four five six"), (None, None)], SCHEMA.split(", _id")[0])
    pages = some.select(F.col("doc_id").alias("page_id"), F.lit("http://x.org/").alias("url"), F.col("text").alias("html"))
    want = sorted(str(x) for x in (base + 1, None, base + 3, base + 3, None))
    made = {
        "op1": packing.pack_documents(some, BPE), "op2": jaccard_join.jaccard_classes(some), "op3": repeats.repeat_report(some), "op4": fingerprint.edited_fingerprints(some),
        "op5": sampled_pieces.sampled_segmentations(some, PIECES, k=1), "op6": exact_dedup.exact_groups(some), "op7": ngram_lm.backoff_scores(some),
        "op8": quality.quality_scores(some, quality.fit(some, some.selectExpr("doc_id", "1 AS quality").where("false"))), "op9": html_extract.main_texts(pages).withColumnRenamed("page_id", "doc_id"),
        "op10": license_scan.license_scan(some),
    }
    assert {k: sorted(str(r.doc_id) for r in df.collect()) for k, df in made.items()} == dict.fromkeys(made, want)


def test_stages_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "_id", "_text", "_row", "_key", "_keep", "_n", "starts", "ends", "_other", "_slot", "component_id", "Kept", "a.b"]
    df = spark.createDataFrame([(i, f"{'w ' * 80} {i % 3} " * (1 + i % 2), *range(len(names) - 2)) for i in range(9)], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    for out in (exact_dedup.drop_exact(df), repeats.drop_repeats(df), jaccard_join.one_of_each(df)):
        got = out.collect()
        assert out.columns == names and got and all(list(r[2:]) == list(range(len(names) - 2)) for r in got)
