"""What the corpus operators share: table access, the shared folder, stored intermediate tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the query contracts: a word is a run of these characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes the shuffle files of a statement when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session without one gets a temporary folder; on a cluster executors would each write to a disk of their
    own, so there its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="headway-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation of what lies before.  The path is
    unique, so reruns and concurrent jobs do not meet.  The shuffle files of the statement go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # built anew in this setting; the plan of ``df`` itself would keep the one it was made under
        df.select("*").write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes stored tables that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter by which rows are told apart before a shuffle, 2 MB whatever the input.
FILTER_BITS = 1 << 24


def may_be_among(rows: DataFrame, key: str, ids: DataFrame, id_key: str, *, inside: bool = True) -> DataFrame:
    """The rows of ``rows`` whose ``key`` may be one of ``ids``, or with ``inside=False`` those whose key surely is not.

    A filter of fixed size is made of the ids and sent to all tasks, so the other rows need no shuffle.  The more
    ids, the more of the other rows pass; an exact join has to follow.  Null keys are not among ids.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = ids.filter(F.col(id_key).isNotNull()).select(spot(id_key).alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
    placed = rows.withColumn("_s", spot(key)).withColumn("_b", F.bitmap_bucket_number("_s")).withColumn("_p", F.bitmap_bit_position("_s"))
    met = placed.join(F.broadcast(bits), "_b", "left")  # at most FILTER_BITS bits
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, F.pmod("_p", F.lit(8)).cast("int")) == 1, F.lit(False))
    return met.filter(hit if inside else ~hit).select(*[F.col(f"`{c}`") for c in rows.columns])


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of the column ``text``; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    part = (np.cumsum(size) - size) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives back the memory it took from the system when it ends: workers outlive their tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return task


def word_count(text: Column) -> Column:
    """Number of WORD matches; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
