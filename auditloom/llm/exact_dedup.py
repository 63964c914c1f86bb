"""Exact deduplication by a 128-bit content hash, with the bytes of each group compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, drop_written, slot, slots_of, text_of, written

def normalised(column: str | Column) -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", " ")


def content_key(text: Column) -> Column:
    """The 128-bit MD5 of a text, as 16 bytes."""
    return F.unhex(F.md5(text))


def hash_groups(keys: DataFrame) -> DataFrame:
    """Of the rows (_id, _key), the hashes that several rows have: _k, _keep (the smallest id) and _n, written.

    Only fixed-width columns go into the aggregate, and tasks combine the rows of a hot hash before the shuffle.
    """
    groups = keys.groupBy(F.col("_key").alias("_k")).agg(F.min("_id").alias("_keep"), F.count("*").alias("_n"))
    return written(groups.where("_n > 1"))


def parted(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that surely share no hash, and the others with _keep, _n and _same (whether the text is that of the row which their group keeps).

    rows has _id, _key, _text and what else the caller wants back. Rows whose slot no group has stay where they are. The
    texts of the others are compared byte by byte with their group's kept text, which a join brings; a group that holds
    much of the table is a skewed key of that join, which adaptive execution splits, as only one row is on its other side.
    """
    slots = slots_of(groups, "_k")
    near = rows.join(slots, slot("_key") == F.col("_slot"), "left_semi")
    # The kept texts are found by id, so that other texts are not hashed once more.
    kept = rows.select("_id", "_key", "_text").join(slots_of(groups, "_keep"), slot("_id") == F.col("_slot"), "left_semi")
    kept = kept.join(groups, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_k", "_keep", "_n").agg(F.min("_text").alias("_first"))
    near = near.join(kept, F.col("_key") == F.col("_k"), "left").withColumn("_same", F.coalesce(F.col("_text") == F.col("_first"), F.lit(True)))
    return rows.join(slots, slot("_key") == F.col("_slot"), "left_anti"), near


def told_apart(near: DataFrame) -> DataFrame:
    """The rows of a written table with _key, _keep, _n, _same and _odd (the text where it is not its group's) with _keep and _n of equal texts."""
    odd = near.where(~F.col("_same"))
    if odd.isEmpty():
        return near
    # Two texts under one MD5: those that are not the kept one are grouped by the whole text.
    groups = odd.groupBy(F.col("_key").alias("_ko"), F.col("_odd").alias("_to")).agg(F.min("_id").alias("_keep_o"), F.count("*").alias("_n_o"))
    fewer = odd.groupBy(F.col("_key").alias("_kf")).agg(F.count("*").alias("_less"))
    own = near.where("_same").join(fewer, F.col("_key") == F.col("_kf"), "left").withColumn("_n", F.col("_n") - F.coalesce("_less", F.lit(0))).select(*near.columns)
    rest = odd.join(groups, (F.col("_key") == F.col("_ko")) & (F.col("_odd") == F.col("_to")))
    return own.unionByName(rest.withColumns({"_keep": F.col("_keep_o"), "_n": F.col("_n_o")}).select(*near.columns))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the SHA-256 of the normalised text.

    Rows are grouped by the 128-bit MD5 of the normalised text. Within a group each text is compared with that of the
    smallest id; texts that differ from it, though their hash is the same, are grouped by themselves.

    Null text is the empty text. Of repeated rows with one id all carry kept = true if that id is the smallest. Null ids
    never win against another id. Other columns are ignored, so that clashing names do not matter. An empty table
    gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_text")).select("_id", content_key(F.col("_text")).alias("_key"), "_text")
    groups = hash_groups(rows)
    alone, near = parted(rows, groups)
    sha = F.sha2("_text", 256).alias("text_sha256")
    odd = F.when(~F.col("_same"), F.col("_text")).alias("_odd")
    near = told_apart(written(near.select("_id", "_key", F.coalesce("_keep", F.when(F.col("_n").isNull(), F.col("_id"))).alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"), "_same", odd, sha)))
    out = near.select("_id", "_keep", "_n", "text_sha256").unionByName(alone.select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), sha))
    return out.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), "text_sha256"
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the table whose normalised text no smaller id has, with all their columns, whatever their names.

    Rows that repeat a kept id with its text are all returned. A row without an id stays only if all its equals have none.
    """
    rows = as_row(df, id_col, text_col).select("_id", normalised("_text").alias("_text"), "_row").select("_id", content_key(F.col("_text")).alias("_key"), "_text", "_row")
    groups = hash_groups(rows)
    alone, near = parted(rows, groups)
    # Dropped rows need no payload; whatever differs from its group's text is judged once more.
    stays = F.col("_n").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))
    near = near.where(stays | ~F.col("_same")).select(
        "_id", "_key", F.coalesce("_keep", F.when(F.col("_n").isNull(), F.col("_id"))).alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"), "_same", F.when(~F.col("_same"), F.col("_text")).alias("_odd"), "_row"
    )
    near = told_apart(written(near)).where(F.col("_id").eqNullSafe(F.col("_keep")))
    return alone.select("_row").unionByName(near.select("_row")).select("_row.*")


def copies(docs: DataFrame) -> DataFrame:
    """_id of the rows (_id, _text) whose text, byte for byte, a row of a smaller id has; null ids are left out. Written."""
    rows = docs.where(F.col("_id").isNotNull()).select("_id", content_key(F.col("_text")).alias("_key"), "_text")
    groups = hash_groups(rows)
    _, near = parted(rows, groups)
    near = near.where(F.col("_n").isNotNull()).select("_id", "_key", "_keep", "_n", "_same", F.when(~F.col("_same"), F.col("_text")).alias("_odd"))
    near = written(near)
    out = written(told_apart(near).where("_id <> _keep").select("_id").distinct())
    drop_written(groups, near)
    return out
