"""I-Match fingerprints: hashes of sorted distinct terms within randomised lexicons."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, text_of, written
from .license_scan import spaced_words

#: Randomised lexicons of each scale; a lexicon of scale s keeps one term in s.
SUBSETS = 16
SCALES = (16, 64, 256, 1024)
#: Stands for the hash where a lexicon keeps no term.
EMPTY = "...."


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: lower-case words."""
    return F.array_remove(F.array_distinct(F.split(spaced_words(text), " ")), "")


def representatives(docs: DataFrame) -> DataFrame:
    """The smallest _id of each group of texts that have the same words in the same order, as _rep, written."""
    return written(docs.groupBy(F.md5(spaced_words(F.col("_text"))).alias("_words")).agg(F.min("_id").alias("_rep")).select("_rep"))


def lexicon(df: DataFrame, text_col: str, band: tuple[float, float], n_docs: int) -> DataFrame:
    """The terms whose share of documents lies in the band.

    A document has few terms, so at most (mean distinct terms a document) / band[0] terms can reach the lower edge,
    however large the table is: this bounds what a broadcast join sends.
    """
    counts = df.select(F.explode(terms_of(text_of(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    return counts.where((F.col("_df") >= band[0] * n_docs) & (F.col("_df") <= band[1] * n_docs)).select("term")


def next_rows(ids: DataFrame) -> DataFrame:
    """The rows of `ids` with _next: the next larger _id, and for the largest the smallest. Ids are unique.

    Ids are dealt to ranges of about equal numbers of rows, as many as the session has shuffle partitions; only the first id
    of each range goes on to one window over all ranges.
    """
    spark = ids.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(ids.repartitionByRange(ranges, "_id").withColumn("_range", F.spark_partition_id()))
    firsts = dealt.groupBy("_range").agg(F.min("_id").alias("_first"))
    one = Window.orderBy("_range")
    after = F.coalesce(F.lead("_first").over(one), F.min("_first").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = F.broadcast(firsts.select(F.col("_range").alias("_of_range"), after.alias("_after")))
    following = F.coalesce(F.lead("_id").over(Window.partitionBy("_range").orderBy("_id")), F.col("_after"))
    return dealt.join(firsts, F.col("_range") == F.col("_of_range")).withColumn("_next", following).drop("_range", "_of_range", "_after")


def upper(hash_: Column) -> Column:
    """A hash without the bits that say which lexicons hold the term."""
    return hash_.bitwiseAND(F.lit(-(1 << SUBSETS)))


def with_subsets(h: Column) -> Column:
    """An upper() hash with bit k set where lexicon k of the smallest scale holds the term: where the k-th four bits of a second hash are zero."""
    draw = F.xxhash64(h, F.lit(0))
    bits = (F.when(F.shiftright(draw, 4 * k).bitwiseAND(F.lit(SCALES[0] - 1)) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(SUBSETS))
    return h.bitwiseOR(functools.reduce(lambda x, y: x.bitwiseOR(y), bits).cast("long"))


def in_smaller(h: Column, k: Column, at: int) -> Column:
    """Whether lexicon k of SCALES[at] holds a term that the one of the scale before holds: one in four, by two bits of a further hash."""
    return F.getbit(F.xxhash64(h, F.lit(at)), 2 * k) + F.getbit(F.xxhash64(h, F.lit(at)), 2 * k + 1) == 0


def lexicon_codes(lexicon_terms: DataFrame) -> DataFrame:
    """The lexicon's terms as _lex and their with_subsets() hashes as _code, for a broadcast join: its size is bounded by lexicon()."""
    codes = lexicon_terms.select(F.col("term").alias("_lex"), upper(F.xxhash64("term")).alias("_h"))
    return F.broadcast(codes.select("_lex", with_subsets(F.col("_h")).alias("_code")))


def with_fingerprints(df: DataFrame, names: dict[str, tuple[str, str]], least: float = 0.25) -> DataFrame:
    """The table with fingerprints: for each scale and lexicon the hash of the sorted distinct terms that the lexicon keeps.

    names maps each new column to two others: the codes of a document's terms within the band, and the upper() hashes of its
    others. Terms within the band count; in a document of whose terms less than the share `least` lies within the band,
    all count: what most texts of a table share would else leave no hash, or those of the few other terms alone. A
    lexicon that keeps no term of the document gives dots in place of a hash; where all do, the hash of all counted terms
    stands in those of the smallest scale, so that only documents without terms have dots alone. Lexicons of a larger
    scale lie within those of a smaller one.
    """
    # One step after the other, so that no array is made twice.
    kept = df.columns
    for k, (inner, outer) in enumerate(names.values()):
        whole = F.size(inner) < least * (F.size(inner) + F.size(outer))
        df = df.withColumn(f"_c{k}", F.when(whole, F.concat(inner, F.transform(outer, with_subsets))).otherwise(F.col(inner)))
    df = df.withColumns({f"_c{k}": F.array_sort(f"_c{k}") for k in range(len(names))})
    ks = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    df = df.withColumns({f"_m{k}": F.filter(f"_c{k}", lambda t: t.bitwiseAND(F.lit((1 << SUBSETS) - 1)) != 0) for k in range(len(names))})
    own = lambda c: F.transform(ks, lambda k: F.transform(F.filter(c, lambda t: F.getbit(t, k) == 1), upper))
    df = df.withColumns({f"_s{k}_0": own(f"_m{k}") for k in range(len(names))})
    none = lambda k: (F.size(f"_c{k}") > 0) & F.forall(f"_s{k}_0", lambda x: F.size(x) == 0)
    df = df.withColumns({f"_s{k}_0": F.when(none(k), F.transform(ks, lambda _: F.array(F.xxhash64(f"_c{k}")))).otherwise(F.col(f"_s{k}_0")) for k in range(len(names))})
    for at in range(1, len(SCALES)):
        narrower = (lambda at: lambda x, k: F.filter(x, lambda t: in_smaller(t, k, at)))(at)
        df = df.withColumns({f"_s{k}_{at}": F.transform(f"_s{k}_{at - 1}", narrower) for k in range(len(names))})
    shown = lambda x: F.when(F.size(x) == 0, F.lit(EMPTY)).otherwise(F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(x), F.lit(1 << 16)))), 4, "0"))
    parts = lambda k: F.concat(*(F.transform(f"_s{k}_{at}", shown) for at in range(len(SCALES))))
    return df.select(*kept, *(F.array_join(parts(k), "").alias(name) for k, name in enumerate(names)))


def likeness(one: Column, other: Column) -> Column:
    """The largest share, over the scales, of lexicons whose hashes agree, of those that keep a term of either text.

    A scale counts if at least a quarter of its lexicons keep a term; equal fingerprints have likeness 1: they stand for
    the same counted terms, or both for none.
    """
    parts = lambda c, at: F.slice(F.regexp_extract_all(c, F.lit("(.{4})")), at * SUBSETS + 1, SUBSETS)
    count = lambda a: F.size(F.filter(a, lambda x: x))
    shares = []
    for at in range(len(SCALES)):
        same = count(F.zip_with(parts(one, at), parts(other, at), lambda x, y: (x == y) & (x != EMPTY)))
        some = count(F.zip_with(parts(one, at), parts(other, at), lambda x, y: (x != EMPTY) | (y != EMPTY)))
        shares.append(F.when(some >= SUBSETS // 4, same / some).otherwise(F.lit(0.0)))
    return F.when(one == other, F.lit(1.0)).otherwise(F.greatest(*shares).cast("double"))


@contextmanager
def object_aggregates(spark: SparkSession, groups: int = 20_000) -> Iterator[None]:
    """Let a task hold so many collected sets before it sorts its rows instead; a document's rows come together."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(groups))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = (0.001, 0.05)) -> DataFrame:
    """One row per input row: the fingerprints of its text and of its edited text, and how near they are.

    The edited text is the text with its last quarter (code points, rounded down) replaced by the first as many code
    points, or all, of the row with the next larger id; the row with the largest id is followed by that with the
    smallest. The band holds for distinct texts: copies (the same words in the same order) count once. near_edited and
    near_next are the likeness of the row's fingerprint to the edited text's and to the next row's. Null text is empty; an
    empty text has a fingerprint without hashes, like other texts without terms. Rows that repeat an id with its text are
    one row for this order and get equal results; texts under one id follow each other in the order of their MD5. Rows
    without an id come after all others, in that order too. Other columns are ignored.
    """
    rows, names = numbered(df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")), nulls=True)
    docs = rows if names is None else rows.dropDuplicates(["_id"])
    # Keys are never null here; said for all, so that every join reads the same shuffle.
    docs = docs.select("_id", "_text").where(F.col("_id").isNotNull())
    dealt = docs.repartition("_id")  # one shuffle of the texts serves both joins
    reps = representatives(docs)
    # An inner join: a semi join would be pushed below the shuffle of the texts, which the other joins use again.
    lex = lexicon(dealt.join(reps, F.col("_id") == F.col("_rep")), "_text", band, reps.count())
    following = next_rows(docs.select("_id", F.floor(F.length("_text") / 4).cast("int").alias("_k")))
    heads = dealt.select(F.col("_id").alias("_n"), F.col("_text").alias("_next_text")).join(following, F.col("_n") == F.col("_next"), "right")
    heads = heads.select(F.col("_id").alias("_for"), "_next", "_k", F.expr("substring(_next_text, 1, _k)").alias("_head"))
    both = dealt.join(heads, F.col("_id") == F.col("_for"), "left")
    n = F.length("_text")
    edited = F.concat(F.expr("substring(_text, 1, length(_text) - coalesce(_k, floor(length(_text) / 4)))"), F.coalesce("_head", F.lit("")))
    both = both.select("_id", "_next", n.cast("long").alias("n_chars"), "_text", edited.alias("_edited"))
    # One row for each term of either text. Places tell which: terms of both come first, then those of the text alone, then
    # those of the edited text alone, and last what else the row has to carry, so that exploded rows are narrow.
    both = both.select("_id", terms_of(F.col("_text")).alias("_t0"), terms_of(F.col("_edited")).alias("_t1"), F.concat_ws(" ", F.sha2("_edited", 256), "n_chars", "_next").alias("_carry"))
    both = both.select("_id", "_carry", F.array_intersect("_t0", "_t1").alias("_b"), F.array_except("_t0", "_t1").alias("_l"), F.array_except("_t1", "_t0").alias("_r"))
    at = [F.size("_b"), F.size("_b") + F.size("_l"), F.size("_b") + F.size("_l") + F.size("_r")]
    flat = both.select("_id", *(x.alias(f"_n{k}") for k, x in enumerate(at)), F.posexplode(F.concat("_b", "_l", "_r", F.array("_carry"))).alias("_p", "_term"))
    flat = flat.join(lexicon_codes(lex), F.col("_term") == F.col("_lex"), "left")
    is_term, one, two = F.col("_p") < F.col("_n2"), F.col("_p") < F.col("_n1"), (F.col("_p") < F.col("_n0")) | (F.col("_p") >= F.col("_n1"))
    flat = flat.select("_id", "_code", F.when(is_term & F.col("_code").isNull(), upper(F.xxhash64("_term"))).alias("_h"), one.alias("_one"), (two & is_term).alias("_two"), F.when(~is_term, F.col("_term")).alias("_carry"))
    picked = lambda side, c: F.collect_list(F.when(F.col(side), F.col(c)))
    sets = flat.groupBy("_id").agg(picked("_one", "_code").alias("_i0"), picked("_one", "_h").alias("_o0"), picked("_two", "_code").alias("_i1"), picked("_two", "_h").alias("_o1"), F.max("_carry").alias("_c"))
    carried = F.split("_c", " ")
    pair = with_fingerprints(sets, {"fingerprint": ("_i0", "_o0"), "edited_fingerprint": ("_i1", "_o1")})
    pair = pair.select("_id", carried[2].cast("long").alias("_next"), carried[1].cast("long").alias("n_chars"), carried[0].alias("edited_sha256"), "fingerprint", "edited_fingerprint")
    with object_aggregates(df.sparkSession):
        pair = written(pair)
    others = pair.select(F.col("_id").alias("_other"), F.col("fingerprint").alias("_next_fingerprint"))
    out = pair.join(others, F.col("_next") == F.col("_other"), "left").select(
        "_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("_next_fingerprint")), F.lit(0.0)).alias("near_next"),
    )
    if names is not None:
        out = rows.select("_of", F.col("_id").alias("_row_key")).join(out, F.col("_row_key") == F.col("_id")).withColumn("_id", F.col("_of")).drop("_of", "_row_key")
    return out.withColumnRenamed("_id", id_col)
