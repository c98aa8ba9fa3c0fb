"""Helpers the operators of this package share: shared scratch tables, sized samples and text access."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast below this many rows only; beyond it the join shuffles. Such sides hold ids, digests and signatures, no texts.
BROADCAST_ROWS = 200_000
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bits of a broadcast filter at most (32 MB), bits for each key below that, and bits of one of its pages.
FILTER_BITS, BITS_EACH, PAGE = 1 << 28, 64, 1 << 15


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Only where it is unset (tests, a single machine)
    a temporary folder is made, once for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            root = kept.get()
        else:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(root)
    if "://" not in root and root.startswith("/"):
        root = "file://" + root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OPEN = threading.local()


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """The tables that `stored` writes within are deleted at the end, but for those it was told to keep."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe when executors go.

    Within `steps` the table goes with that scope, or, with `keep`, with the scope around it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    scopes = getattr(_OPEN, "scopes", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def result(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, stored; the tables that it stored on the way are deleted."""
    with steps(spark):
        return stored(make(), name, keep=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to hold BATCH_ROWS rows and BATCH_BYTES at most.

    A Python worker and its executor hold a batch of whole texts several times over; at Spark's
    own 10,000 rows that is the larger part of a worker's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; they go to Python in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_crc(column: str = "doc_id"):
    """Unsigned crc32 of the id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hashed_sample(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """At most `most` rows of df, those of the smallest hash of `key`; total is df's row count.

    A hash threshold near most/total goes first, so that the sort sees about twice `most` rows
    whatever the size of df.
    """
    order = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000_007))
    if total > 2 * most:
        df = df.where(order <= int(2.0 * most / total * 1_000_000_007))
    return df.orderBy(order, F.col(key)).limit(most)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if rows <= most else df


def gathered(df: DataFrame, rows: int, each: int = 25_000) -> DataFrame:
    """df in no more tasks than its rows need, eight at least."""
    return df.coalesce(max(8, rows // each))


def parted(df: DataFrame, key: str, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose `key` is surely none of the keys, and the rest: they have one, or a few of them seem to.

    keys has the column `key` and n rows. What is broadcast is a bitmap of their hashes, in pages; it
    never passes FILTER_BITS. Where it fills up, more rows fall to the rest, and none is lost.
    """
    bits = min(FILTER_BITS, max(PAGE, 1 << (BITS_EACH * n - 1).bit_length()))
    place = lambda: F.pmod(F.xxhash64(key), F.lit(bits))
    page, marks, flag = fresh(df, "filter_page"), fresh(df, "filter_marks"), fresh(df, "filter_flag")
    pages = keys.groupBy(F.floor(place() / PAGE).alias(page)).agg(F.bitmap_construct_agg(place() % PAGE).alias(marks))
    byte = F.conv(F.hex(F.substring(F.col(marks), F.floor(place() % PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = df.withColumn(page, F.floor(place() / PAGE)).join(F.broadcast(pages), page, "left")
    told = told.withColumn(flag, F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(xxhash64(`{key}`), {bits}) % 8 as int))")) != 0, F.lit(False)))
    return told.where(~F.col(flag)).select(*df.columns), told.where(F.col(flag)).select(*df.columns)


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes of the column numbered `text`, unless one text alone is longer."""
    for batch in batches:
        ends, lo = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = min(max(int(np.searchsorted(ends, before + size, "right")), lo + 1), lo + rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
