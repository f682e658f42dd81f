"""Helpers shared by the operators: shared-folder tables, even ranking, worker state."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HASH_SPAN = 1 << 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); set to a
    default only where the session has none, as in tests on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current.rstrip("/")
        folder = "/tmp/checkpoints/beliefmesh"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders written by this driver process and not released yet.
SCRATCH: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder, remembered for `release`."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    return path


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the folders that operators have written, but for the first `keep`. Frames that read them can't be computed
    any more, so it is for the time after their results are written."""
    while len(SCRATCH) > keep:
        delete(spark, SCRATCH.pop())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage, survives lost executors,
    and keeps costly Python stages from being computed once per use."""
    path = scratch(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: Column, tie: list[Column], out: str = "rank", splits: int = 1024, per_group: DataFrame | None = None, per_slice: dict[str, str] | None = None) -> DataFrame:
    """Add a gapless 0-based rank of each row within its group, in the order of (hash of tie, tie).

    A group may hold most of all rows, so it is cut into `splits` slices by the leading part of the hash; rows are
    ranked within a slice, and a small table of slice counts gives each slice its first rank. The ranks do not depend
    on `splits`, which only sets how many rows share a task (rows of the largest group / splits). per_group has a
    column `__g` and others to add to each row of the group; they travel with the table of slices, so that the rows
    themselves are never dealt out by group. Groups that it lacks are left out. per_slice: SQL that replaces columns of
    per_group in each slice, from them, __start (rank of the slice's first row) and __n (rows of the slice).
    """
    h = F.pmod(F.xxhash64(*tie), F.lit(HASH_SPAN))
    keyed = df.withColumns({"__g": group, "__h": h}).withColumn("__s", F.floor(F.col("__h") * splits / HASH_SPAN).cast("int"))
    counts = keyed.groupBy("__g", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__g").alias("__g2"), F.col("__s").alias("__s2"), "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    added = [*(c for c in per_group.columns if c != "__g"), *(per_slice or {})] if per_group is not None else []
    if per_group is not None:
        starts = starts.join(per_group.withColumnRenamed("__g", "__g3"), F.col("__g2").eqNullSafe(F.col("__g3"))).drop("__g3")
        starts = starts.withColumns({c: F.expr(e) for c, e in (per_slice or {}).items()})
    inside = Window.partitionBy("__g", "__s").orderBy("__h", *tie)
    local = keyed.withColumn("__r", F.row_number().over(inside) - 1)
    joined = local.join(starts, F.col("__g").eqNullSafe(F.col("__g2")) & (F.col("__s") == F.col("__s2")), "inner")
    assert not set(added) & set(df.columns), "per_group's columns clash"
    return joined.withColumn(out, F.col("__r") + F.col("__start")).drop("__g", "__h", "__s", "__r", "__g2", "__s2", "__start", "__n")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text falls in fold 0; null ids count as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def in_fold_zero(doc_id, folds: int = 5) -> bool:
    return doc_id is None or zlib.crc32(str(int(doc_id)).encode()) % folds == 0


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker process."""
    box = sys.modules.setdefault("beliefmesh_worker_state", types.ModuleType("beliefmesh_worker_state"))
    return box.__dict__.setdefault(name, {})


def forget(but: str | None = None) -> None:
    """Drop the worker's state of other operators and give free memory back to the system."""
    for name, state in sys.modules.get("beliefmesh_worker_state", types.ModuleType("none")).__dict__.items():
        if isinstance(state, dict) and not name.startswith("__") and name != but:
            state.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], state: str | None = None) -> Callable:
    """run for mapInPandas, in a worker that keeps no other operator's state: workers outlive stages, so that else
    the caches of all stages of a pipeline would add up in each of them."""

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget(state)
        try:
            yield from run(batches)
        finally:
            forget(state)

    return inside


#: Rows and bytes of a batch that goes to a Python worker, so that its memory doesn't follow the length of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches; smaller limits of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def bounded_sample(df: DataFrame, key: Column, rows: int, of: DataFrame | None = None) -> DataFrame:
    """The `rows` rows with the smallest hash of key: a sample that does not depend on partitioning.

    Rows whose hash lies far beyond the bound are left out before the sort, so that about 4 * rows rows meet in it,
    not rows of each partition. The bound follows from the number of rows of `of` (default: df), so the sample may be
    smaller where df is under a quarter of `of`."""
    n = (df if of is None else of).count()
    keyed = df.withColumn("__k", F.pmod(F.xxhash64(key), F.lit(HASH_SPAN)))
    if n > 8 * rows:
        keyed = keyed.where(F.col("__k") < int(HASH_SPAN * 4 * rows / n))
    return keyed.orderBy("__k", key).limit(rows).drop("__k")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns, also ones that clash with inner names, do not get further."""
    return df.select(*[F.col(f"`{n}`") for n in names])
