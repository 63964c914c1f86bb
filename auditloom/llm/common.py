"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster has to name it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditloom-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table written in the shared folder: cuts the lineage and survives lost executors.

    drop_written() deletes it; what a lazy result still reads goes when the application ends.
    """
    path = f"{shared_dir(df.sparkSession)}/auditloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    # Shuffle files of finished steps go when the driver collects its garbage; else they would pile up over many steps.
    sc._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


#: Slots of the filters that keep most rows out of a shuffle: at most so many rows are broadcast, however large the tables are.
SLOT_BITS = 20


def slot(*columns: str | Column) -> Column:
    """The slot of a key."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << SLOT_BITS)).cast("int")


def slots_of(keys: DataFrame, *columns: str | Column) -> DataFrame:
    """The slots that some key falls in, as a broadcast table with the column _slot: at most 2**SLOT_BITS rows."""
    return F.broadcast(keys.select(slot(*columns).alias("_slot")).distinct())


def small_batches(df: DataFrame, rows: int = 2000) -> None:
    """Texts are long: let Python workers of the session get so many at a time, where the session doesn't say otherwise."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, str(rows))


def as_row(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text (null as empty) and _row, the whole row as a struct: so no name of the table's own can clash with a helper column."""
    return df.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text_col}`")).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose _id is not in the other table; only those that share a slot with one of its ids are shuffled."""
    slots, own = slots_of(ids, "_id"), ids.select(F.col("_id").alias("_not"))
    near = docs.join(slots, slot("_id") == F.col("_slot"), "left_semi").join(own, F.col("_id") == F.col("_not"), "left_anti")
    return docs.join(slots, slot("_id") == F.col("_slot"), "left_anti").unionByName(near)


def numbered(docs: DataFrame, nulls: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The rows (_id, _text, ...) with _of, the id, and _id, a key that different texts never share.

    Where ids are integers and none is repeated that is the id itself; else the place of (id, text) among all such pairs, in
    order, and a second table has each key (_key) and its id (_o). A null id has a null key or, with `nulls`, one after all others.
    """
    docs, named = docs.withColumn("_of", F.col("_id")), F.col("_id").isNotNull()
    whole = docs.schema["_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    many = docs.groupBy("_id").agg(F.count("*").alias("_n"))
    if whole and many.where((F.col("_n") > 1) & named | F.lit(nulls) & ~named).isEmpty():
        return docs, None
    pair = docs.where(F.lit(nulls) | named).select(F.col("_of").alias("_o"), F.md5("_text").alias("_m")).distinct()
    pair = written(pair.orderBy(F.col("_o").asc_nulls_last(), "_m").withColumn("_key", F.monotonically_increasing_id()))
    docs = docs.join(pair, F.col("_of").eqNullSafe(F.col("_o")) & (F.md5("_text") == F.col("_m")), "left").withColumn("_id", F.col("_key"))
    return docs.drop("_o", "_m", "_key"), pair.select("_key", "_o")


def frugal(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over a task's batches; when they end, the worker gives back what it has freed.

    Workers are used again for later tasks and stages, and allocators keep freed memory; an executor's limit holds for
    the JVM and all its workers together.
    """

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run
