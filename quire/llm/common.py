"""What the training-data operators share: shared folders, joins that survive hot keys, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on. At most 1 / HOT_SHARE keys can be hot, which bounds what is broadcast.
HOT_SHARE = 1 / 500
#: Largest table that is broadcast, after its rows and bytes have been counted.
BROADCAST_BYTES = 48 << 20
#: Bytes of text that a Python worker works on, and gets, at once.
BATCH_BYTES, ARROW_BYTES = 1 << 20, 2 << 20


def session(df: DataFrame) -> SparkSession:
    """The session, with Arrow batches of at most ARROW_BYTES: long texts come in few rows, and short keys still in many."""
    spark = df.sparkSession
    try:
        now = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b"))
        if now > ARROW_BYTES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    except (PySparkException, ValueError):  # no such setting, or one with another unit, which somebody chose
        pass
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that driver and executors share.

    Where spark.checkpoint.dir is unset, a session whose executors are threads of the driver gets a temporary folder; any other raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc._jsc.sc().getCheckpointDir().isDefined():
        root = sc._jsc.sc().getCheckpointDir().get()
    if not root:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quire-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them again: lineage ends here, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` made, once nothing that is still to be computed reads them."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            _hadoop_path(df.sparkSession, path)[1].delete(_hadoop_path(df.sparkSession, path)[0], True)


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, the cluster's default one where it has none, as pyarrow's file systems read it."""
    where, store = _hadoop_path(spark, path)
    return store.makeQualified(where).toString().replace("s3a://", "s3://", 1)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Runs what is inside with other settings (dots written as __), and puts the old ones back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit of which depends on all bits of the given ones; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, counted with the bytes of their strings, fit a broadcast. df should be stored: this runs a job."""
    strings = [c for c, t in df.dtypes if t in ("string", "binary")]
    width = 16 * len(df.columns) + 16
    wide = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in strings], F.lit(0).cast("long"))
    for c, t in df.dtypes:
        if t.startswith("array"):
            wide = wide + 64 * F.coalesce(F.size(c), F.lit(0))
    n = df.agg(F.sum(wide + width).alias("n")).first().n or 0
    return n <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast where the counted size allows it; otherwise Spark shuffles."""
    return F.broadcast(df) if small_enough(df, limit) else df


def lookup_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, salt_by: Column, least: int = 2_000) -> DataFrame:
    """left LEFT JOIN right on one non-null key, where a key may hold a third of left's rows.

    right has one row for each key, with the number of left's rows in ``weight``. Keys over HOT_SHARE of all rows, at most
    1 / HOT_SHARE of them, are broadcast with a number of salts; left's rows of such a key go to as many partitions, by ``salt_by``,
    and right's row is repeated for each. right's ``weight`` is dropped.
    """
    total = right.agg(F.sum(weight).alias("n")).first().n or 0
    limit = max(least, int(total * HOT_SHARE))
    hot = F.broadcast(right.where(F.col(weight) > limit).select(F.col(key).alias("_hot"), F.ceil(F.col(weight) / limit).cast("int").alias("_salts")))
    a = left.join(hot, left[key] == hot["_hot"], "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt_by), F.col("_salts")).cast("int"))).drop("_hot", "_salts")
    n = F.when(F.col(weight) > limit, F.ceil(F.col(weight) / limit).cast("int")).otherwise(1)
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop(weight)
    return a.join(b, [key, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of every node in edges(u, v); a component is named after its smallest node.

    Alternating large-star and small-star steps, each written to the shared folder, so that the number of rounds grows with the
    logarithm of the longest path and no link ever reaches the driver. Only counts and a checksum do.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    if now.isEmpty():
        max_rounds = 0
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small, "edges")
        release(before)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen.n, seen.x) == mark:
            break
        mark = (seen.n, seen.x)
    else:
        if max_rounds:
            raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


_TRIMMED = [0.0]


def trim(after: float = 1.0) -> None:
    """Gives freed memory back to the system, at most once in so many seconds: Python workers live on from stage to stage."""
    now = time.monotonic()
    if now - _TRIMMED[0] >= after:
        _TRIMMED[0] = now
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def utf8(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string column and where each row's start; nulls are empty."""
    trim()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    return data, offsets


def slices(sizes: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, a longer row alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
    trim()
