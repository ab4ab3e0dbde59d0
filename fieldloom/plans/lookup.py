"""Joins of a large table with a catalogue whose size is not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import materialise

# Bytes that the files of a broadcast catalogue may have. In memory it is a few times that.
BROADCAST_BYTES = 16 << 20

# A key that holds more than 1/HOT_SHARE of the rows gets its own join. There
# can be at most HOT_SHARE such keys, so their catalogue rows fit a broadcast.
HOT_SHARE = 500


def size_in_bytes(df: DataFrame) -> int:
    """What the planner takes for the size of ``df``; exact for the files of a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, size: int = BROADCAST_BYTES) -> bool:
    """True if the planner knows ``df`` to have at most ``size`` bytes; exact for a written table."""
    return size_in_bytes(df) <= size


def lookup_join(
    big: DataFrame, catalogue: DataFrame, on: list[str], size: int = BROADCAST_BYTES
) -> DataFrame:
    """Left join. ``catalogue`` has at most one row for each key and should be materialised.

    Small catalogues are broadcast. For larger ones the few hot keys are joined
    by broadcast and all others by a shuffle, so no task gets the rows of a hot
    key. Rows without a key find nothing and are not moved. Every row comes out once.
    """
    if is_small(catalogue, size):
        return big.join(F.broadcast(catalogue), on, "left")
    counts = materialise(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") * HOT_SHARE > total).select(*on, F.lit(True).alias("_hot"))
    marked = big.join(F.broadcast(hot), on, "left")
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    few = catalogue.join(F.broadcast(hot.select(*on)), on, "left_semi")
    joined_hot = marked.filter(is_hot).drop("_hot").join(F.broadcast(few), on, "left")
    keyed = ~is_hot & ~F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    joined_rest = marked.filter(keyed).drop("_hot").join(catalogue.hint("shuffle_hash"), on, "left")
    bare = marked.filter(~is_hot & ~keyed).drop("_hot")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in catalogue.schema.fields if f.name not in on]
    return joined_hot.unionByName(joined_rest).unionByName(bare.select("*", *missing))
