"""Helpers that the corpus operators share: words, shared storage, Arrow batches and global running totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import components  # noqa: F401
from threadloom.storage import checkpointed, fresh_path, shared_dir, written  # noqa: F401

#: Words are runs of anything but these characters (space, tab, line ends, form feed).
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """Words of a text as a native array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def over_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


def held_out(doc_id: Column, remainder: int, parts: int = 5) -> Column:
    """crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == remainder


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Bytes of an Arrow batch, unless the session says otherwise: so much text is in a worker at once, but for single longer texts.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` in small batches; a worker gives its free memory back after each task."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def with_prefix_sums(df: DataFrame, order: list, value: str, before: str = "before", row: str = "row", made: Callable | None = None) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows and the number of earlier rows, in the global order ``order``.

    ``made`` adds ``value`` to the ordered rows, batch by batch, so that what is costly runs once and not for the sample of the order as well.

    The rows are range-partitioned and sorted, then checkpointed, so that the second pass sees the same partitions.
    Only one total for each partition goes to the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged if made is None else made(ranged)
    kept, schema = list(ranged.columns), ranged.schema
    ranged = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    base, size, rows = {}, 0, 0
    for x in sorted(ranged.groupBy("_part").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n")).collect(), key=lambda x: x["_part"]):
        base[x["_part"]] = (size, rows)
        size, rows = size + (x["s"] or 0), rows + x["n"]
    names = [*kept, before, row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = base[batch.column("_part")[0].as_py()]
            sums = np.cumsum(batch.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = at[0] + np.concatenate(([0], sums[:-1]))
            index = at[1] + np.arange(batch.num_rows)
            at = (at[0] + int(sums[-1]), at[1] + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(first, pa.int64()), pa.array(index, pa.int64())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return ranged.transform(map_arrow, run, f"{fields}, `{before}` bigint, `{row}` bigint")
