"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import drop_scratch, ensure_checkpoint_dir, scratch_path


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary's file on this machine: in ``folder``, else where the installed package has it."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
             schema) -> DataFrame:
    """``mapInArrow`` with batches small enough for very long texts.

    Python workers live on between tasks, so a task gives back the memory of its batches. A stage keeps a worker per task
    and call: two calls without a shuffle between them double the workers of an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128-bit identity of a text (null is the empty text)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


class Scratch:
    """Tables written under ``spark.checkpoint.dir`` between the steps of one operator.

    A written table cuts the lineage and outlives a lost executor. ``drop`` deletes tables after their last reader; what
    a result still reads goes with ``session.scratch_scope`` or ``clear_scratch``, at the latest when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            drop_scratch(self.spark, path)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]

    def keep_only(self, *tables: DataFrame | None) -> None:
        self.drop(*[t for t, _ in self.tables if not any(t is k for k in tables)])
        self.release()

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished jobs, which stay until the driver collects its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public splitmix64 constants, fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class KeyFilter:
    """A bitmap of fixed size over 64-bit hash keys, built by Spark and sent to the tasks.

    It spares rows whose key is surely absent a shuffle before an exact join. Its size never
    grows with the data: more keys only let more rows through, which the join then drops.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 1 << 25):
        place = F.col(column).bitwiseAND(F.lit(bits - 1))
        words = (keys.select(place.alias("p"))
                 .groupBy(F.shiftright("p", 6).alias("w"))
                 .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("m")).toArrow())
        own = np.zeros(bits // 64, np.int64)
        own[words.column("w").to_numpy()] = words.column("m").to_numpy()
        self.mask = bits - 1
        self.sent = keys.sparkSession.sparkContext.broadcast(own)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = keys.astype(np.int64, copy=False) & self.mask
        return (self.sent.value[place >> 6] >> (place & 63)) & 1 == 1


def holding(batch: pa.RecordBatch, *filters: tuple[KeyFilter, str]) -> pa.Array:
    """Which rows of a batch have keys that may be among those of every filter."""
    return pa.array(np.logical_and.reduce([k.holds(batch.column(c).to_numpy(zero_copy_only=False)) for k, c in filters]))


def only_held(df: DataFrame, keys: KeyFilter, column: str, *others: tuple[KeyFilter, str]) -> DataFrame:
    """The rows whose key may be among ``keys``, and so for the ``others``, all in one pass."""

    def run(batches):
        for batch in batches:
            yield batch.filter(holding(batch, (keys, column), *others))

    return map_rows(df, run, df.schema)
