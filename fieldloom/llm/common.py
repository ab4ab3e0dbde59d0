"""Helpers that several operators share: written tables, size-checked joins, batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import materialise, prepare

# A table is broadcast only if its written files are at most this large.
BROADCAST_BYTES = 8 << 20
# Texts are worked on in portions of about so many bytes, so that memory does not follow the batch size.
PORTION_BYTES = 2 << 20
# Bytes that separate words: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"

__all__ = ["BROADCAST_BYTES", "SPACES", "documents", "held_out", "materialise", "per_portion", "portions", "read_table", "sized", "text_key"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def sized(written: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files are small; otherwise the join is by shuffle.

    Only for the result of ``materialise``: the planner knows the size of its files.
    """
    size = written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(written) if int(str(size)) <= BROADCAST_BYTES else written


def held_out(doc_id: str, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id counts as the empty text."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(parts)) == remainder


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; equal texts share them."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def portions(batch: pa.RecordBatch, column: str = "text", size: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a portion have about ``size`` bytes together; a longer text is alone."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def per_portion(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", size: int = PORTION_BYTES) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow`` that applies ``work`` to each portion."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in portions(batch, column, size):
                yield work(portion)

    return run
