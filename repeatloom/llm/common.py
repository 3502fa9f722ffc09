"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for Python kernels: if it is read by at most half as many tasks as there are
    cores, its rows are dealt to all of them."""
    df = read(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < 2 * df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, in local mode only: on a
    cluster a folder of one machine would lose data.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        kept = getattr(spark.sparkContext, "_repeatloom_dir", None)
        if kept is None:
            kept = tempfile.mkdtemp(prefix="repeatloom-")
            spark.sparkContext._repeatloom_dir = kept
            atexit.register(shutil.rmtree, kept, True)
        found = f"file://{kept}"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a filter for each of its keys, and in all: a filter of 2**30 bits is 128 MB.
FILTER_BITS, MOST_FILTER_BITS = 32, 2**30


def perhaps_among(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag``: false where ``column`` is surely not among ``keys``.

    ``keys`` has one column of the same type. It is hashed to slots, and all tasks get a bit
    for each slot, so rows of long texts are told apart without being moved. One row in
    ``FILTER_BITS`` or fewer is flagged in error, more if ``MOST_FILTER_BITS`` are too few
    for the keys; none is missed. A null is a key like others.
    """
    slots = min(MOST_FILTER_BITS, FILTER_BITS * max(1, keys.count()))
    slot, names = free_name(df.columns, "_slot"), df.columns
    bucket, bits = free_name(names, "_bucket"), free_name(names, "_bits")
    told = keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(slots)).alias(slot))
    told = told.select(F.bitmap_bucket_number(slot).alias(bucket), F.bitmap_bit_position(slot).alias(slot))
    told = told.repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg(slot).alias(bits))
    rows = df.withColumn(slot, F.pmod(F.xxhash64(column), F.lit(slots)))
    rows = rows.withColumns({bucket: F.bitmap_bucket_number(slot), slot: F.bitmap_bit_position(slot).cast("int")})
    byte = F.expr(f"cast(conv(hex(substring({bits}, {slot} div 8 + 1, 1)), 16, 10) as bigint)")
    found = F.expr(f"shiftleft(1L, {slot} % 8)").bitwiseAND(F.coalesce(byte, F.lit(0))) != 0
    return rows.join(F.broadcast(told), bucket, "left").select(*names, found.alias(flag))


def free_name(columns: list[str], base: str) -> str:
    """``base``, lengthened until no column has that name (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


_HELD: dict = {}


def held(key, make):
    """A worker process's one large object, kept between tasks; asking for another drops it,
    so the caches of operators that share executors do not add up."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


#: Bytes that a task reads before what it freed meanwhile is given back.
GIVE_BACK_BYTES = 16_000_000


def give_back() -> None:
    """Return freed memory to the system: allocators keep it, and that of waiting workers adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def trimmed(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``kernel``, giving back what it frees as it goes and, unless it read little, when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, due = 0, GIVE_BACK_BYTES

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal read, due
            for batch in batches:
                read += batch.nbytes
                yield batch
                del batch
                if read >= due:
                    due = read + GIVE_BACK_BYTES
                    give_back()

        yield from kernel(counted())
        if read >= GIVE_BACK_BYTES // 16:
            give_back()

    return run
