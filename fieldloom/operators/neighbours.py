"""The k most similar corpus vectors of each query vector, exactly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.rows import let
from fieldloom.functions.similarity import cosine
from fieldloom.session import materialise

# A block has at most so many vectors and bytes; a table is cut no finer than blocks of LEAST_ROWS without need.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
LEAST_ROWS = 256
# Blocks that a task holds of either side have at most so many bytes together.
PART_BYTES = 64 << 20
# Rows of a product that are looked at together, and pairs that are scored together.
TILE_ROWS = 512
SCORED = 1 << 14
# Similarities are compared after rounding to so many digits.
DIGITS = 9

BLOCK = "b bigint, dim int, ns binary, units binary"
HITS = "query bigint, corpus bigint, similarity double"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)


def _unit(vector: Column) -> Column:
    """Double vector of length 1; NULL for the zero vector, which is similar to nothing."""
    def scale(v: Column) -> Column:
        return let(F.sqrt(_dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))

    return let(F.transform(vector, lambda x: x.cast("double")), scale)


def _collapse(df: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """Distinct vectors with their k smallest ids. Copies of a vector cost one comparison.

    The rank is taken with a partial limit before the shuffle, so many copies do not meet in one task.
    """
    key = F.xxhash64(vector_col)
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vec"), key.alias("_h"))
    rank = F.row_number().over(Window.partitionBy("_h", "_vec").orderBy(F.asc_nulls_last("_id")))
    few = rows.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_id"))), lambda r: r["_id"])
    return few.groupBy("_h", "_vec").agg(ids.alias("ids"))


def _pack(table: pa.Table) -> pa.Table:
    """The rows of one block as a single row of plain numbers."""
    table = table.combine_chunks()
    units = pa.concat_arrays([c.flatten() for c in table["unit"].chunks])
    ns, units = table["n"].to_numpy(), units.to_numpy(zero_copy_only=False)
    first = [table[c][0].as_py() for c in ("b", "dim")]
    return pa.table({"b": pa.array(first[:1], "int64"), "dim": pa.array(first[1:], "int32"), "ns": [ns.astype("<i8").tobytes()], "units": [units.astype("<f8").tobytes()]})


def _blocks(numbered: DataFrame, cells: int) -> tuple[DataFrame, int]:
    """Vectors (``n``, ``unit``) as blocks of even size, dealt evenly to a number of partitions, and that number."""
    rows, dim = numbered.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("unit")), F.lit(1))).first()
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    count = max(1, min(cells, rows // LEAST_ROWS), math.ceil(rows / most))
    # each task meets one partition of either side: enough of them for all cores, and few enough blocks in one
    cores = numbered.sparkSession.sparkContext.defaultParallelism
    parts = min(count, max(math.ceil(math.sqrt(8 * cores)), math.ceil(8 * dim * rows / PART_BYTES)))
    count = math.ceil(count / parts) * parts
    placed = numbered.select(F.pmod(F.xxhash64("n"), F.lit(count)).alias("b"), F.size("unit").alias("dim"), "n", "unit")
    packed = materialise(placed.groupBy("b", "dim").applyInArrow(_pack, BLOCK))
    return packed.repartitionById(parts, F.pmod("b", F.lit(parts)).cast("int")), parts


def _rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS decimals, halves away from zero by the shortest text of the number, as Spark's round does."""
    scaled = np.abs(x) * 10.0**DIGITS
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**DIGITS, x)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))
    return out


class _Best:
    """The k best of each vector of one query block, over the corpus blocks seen so far."""

    def __init__(self, ns: np.ndarray, units: np.ndarray, k: int, threshold: float):
        self.ns, self.units, self.small = ns, units, units.astype(np.float32)
        self.k, self.threshold = k, threshold
        # not a number comes first, as in Spark's order: it stands here as infinity
        self.similarity = np.full((len(ns), k), -np.inf)
        self.corpus = np.full((len(ns), k), -1, dtype=np.int64)
        # what a product of unit vectors in single precision can be off, with room for the rounding
        self.slack = (units.shape[1] + 8) * 2.0**-23 + 10.0**-DIGITS

    def meet(self, ns: np.ndarray, units: np.ndarray) -> None:
        small = units.astype(np.float32)
        for start in range(0, len(self.ns), TILE_ROWS):
            part = slice(start, start + TILE_ROWS)
            near = self.small[part] @ small.T
            bound = np.maximum(self.similarity[part, -1], self.threshold) - self.slack
            found = ~(near < bound[:, None].astype(np.float32) - np.float32(self.slack))
            many = np.flatnonzero(found.sum(axis=1) > self.k)
            if len(many):
                # only what can be among the k best of this tile
                rows = np.where(np.isnan(near[many]), np.inf, near[many])
                least = np.partition(rows, -self.k, axis=1)[:, -self.k] - 4 * self.slack
                found[many] &= rows >= least[:, None]
            rows, cols = np.nonzero(found)
            for at in range(0, len(rows), SCORED):
                self.score(rows[at : at + SCORED] + start, cols[at : at + SCORED], ns, units)

    def score(self, rows: np.ndarray, cols: np.ndarray, ns: np.ndarray, units: np.ndarray) -> None:
        """Exact similarities, summed in the order of the vector."""
        a, b = self.units[rows], units[cols]
        total = np.zeros(len(rows))
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
        similarity = _rounded(total)
        similarity[np.isnan(total)] = np.inf
        good = (similarity >= self.threshold) & (similarity >= self.similarity[rows, -1])
        rows, similarity, corpus = rows[good], similarity[good], ns[cols[good]]
        known = np.unique(rows)
        old = np.argwhere(self.corpus[known] >= 0)
        held = (known[old[:, 0]], old[:, 1])
        rows = np.concatenate([held[0], rows])
        similarity = np.concatenate([self.similarity[held], similarity])
        corpus = np.concatenate([self.corpus[held], corpus])
        order = np.lexsort((corpus, -similarity, rows))
        rows, similarity, corpus = rows[order], similarity[order], corpus[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.similarity[rows[kept], place[kept]] = similarity[kept]
        self.corpus[rows[kept], place[kept]] = corpus[kept]

    def hits(self) -> pa.RecordBatch:
        rows, places = np.nonzero(self.corpus >= 0)
        similarity = self.similarity[rows, places]
        similarity[np.isinf(similarity)] = np.nan
        columns = [self.ns[rows], self.corpus[rows, places], similarity]
        return pa.RecordBatch.from_arrays([pa.array(c, from_pandas=False) for c in columns], ["query", "corpus", "similarity"])


def _best(k: int, threshold: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow`` over pairs of blocks; those of a query block come one after the other."""

    def vectors(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row[f"{side}_ns"], "<i8"), np.frombuffer(row[f"{side}_units"], "<f8").reshape(-1, row[f"{side}_dim"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                row = {name: v.as_buffer() if name.endswith(("_ns", "_units")) else v.as_py() for name, v in row.items()}
                if key != (row["q_b"], row["q_dim"]):
                    if best is not None:
                        yield best.hits()
                    ns, units = vectors(row, "q")
                    # a copy: the batch goes
                    key, best = (row["q_b"], row["q_dim"]), _Best(ns.copy(), units.copy(), k, threshold)
                if row["q_dim"] == row["c_dim"]:
                    best.meet(*vectors(row, "c"))
        if best is not None:
            yield best.hits()

    return run


def knn_join(
    queries: DataFrame, corpus: DataFrame, query_id: str, query_vector: str, corpus_id: str, corpus_vector: str,
    k: int = 5, threshold: float = 0.85, cells: int = 16,
) -> DataFrame:
    """Top ``k`` by cosine among those at or above ``threshold``; smaller id first among equals.

    Every query meets every corpus vector: both sides are cut into blocks, the
    corpus into ``cells`` at least unless it is small, and each pair of blocks
    is one matrix product. Products in single precision, less what they can be
    off, tell which pairs can be among the best; those are scored exactly. A
    task holds a few blocks of either side and the best of one query block.
    """
    right = materialise(_collapse(corpus, corpus_id, corpus_vector, k).withColumn("unit", _unit(F.col("_vec"))))
    right = right.filter(F.col("unit").isNotNull())
    # numbers in the order of the ids, so that the smaller number wins among equals
    ordered = right.select("ids", "unit", F.col("ids")[0].alias("_first")).orderBy(F.asc_nulls_last("_first"))
    right = materialise(ordered.select(F.monotonically_increasing_id().alias("n"), "ids", "unit"))
    left = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("_vec"))
    distinct = left.select("_vec").distinct().withColumn("unit", _unit(F.col("_vec")))
    distinct = materialise(distinct.filter(F.col("unit").isNotNull()).withColumn("n", F.monotonically_increasing_id()))

    names = ["b", "dim", "ns", "units"]
    (probes, _), (blocks, _) = _blocks(distinct, cells), _blocks(right, cells)
    # neither side is to be broadcast: the planner does not know how large a block is
    pairs = probes.select(*[F.col(c).alias(f"q_{c}") for c in names]).hint("shuffle_replicate_nl").crossJoin(
        blocks.select(*[F.col(c).alias(f"c_{c}") for c in names]))
    hits = materialise(pairs.mapInArrow(_best(k, threshold), HITS))

    # the smallest id of a group of copies orders the group; k groups are enough for k ids
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "corpus"))
    groups = hits.withColumn("_g", place).filter(F.col("_g") <= k)
    items = groups.join(right.select(F.col("n").alias("corpus"), "ids"), "corpus").select("query", "similarity", F.explode("ids").alias("corpus_id"))
    ranked = items.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc_nulls_last("corpus_id")))
    ).filter(F.col("rank") <= k)
    top = ranked.groupBy(F.col("query").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "corpus_id", "similarity"))).alias("top")
    )
    top = top.join(distinct.select("n", "_vec"), "n").select("_vec", "top")
    return left.join(top, "_vec").select("query_id", F.explode("top").alias("t")).select("query_id", "t.*")


__all__ = ["knn_join", "cosine"]
