"""Operator 4: benchmark items inside long documents, by size-partitioned MinHash containment search.

Only shingles that some benchmark item holds can count towards a containment, so
a document is first reduced to those (a fixed-size bit table lets through a few
more, which is harmless). Reduced documents and items are put in classes by size.
A containment of at least t between an item of size q and a document of size u
means a Jaccard similarity of at least t q / (u + q - t q); each pair of classes
gets as many MinHash coordinates as that similarity needs to share one with near
certainty. Documents and items that agree in a coordinate are candidates, and
the exact containment of shingle sets decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import materialise, per_portion, sized
from fieldloom.llm.words import LOWER_ALNUM, flat, mix, windows, words

SHINGLE = 5
CONTAINMENT = 0.8
# A match is missed with at most this probability before its exact check.
MISS = 1e-6
# Bits of the table of benchmark shingles: 16 MB, whatever the size of the benchmark.
TABLE_BITS = 27
# A document's reduced shingles are searched in pieces of so many, overlapping by half; items are cut into pieces of at most so many.
PIECE = 1024
# Added to the class of a piece of a longer document.
PART = 16


def ordered_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in reading order, and the number of the text of each."""
    element, owner, _ = windows(words(data, offsets, LOWER_ALNUM), SHINGLE)
    return _first_places(element, owner)


def _first_places(element: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(element):
        return element, owner
    order = np.lexsort((np.arange(len(element)), element, owner))
    fresh = np.append(True, (element[order][1:] != element[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    first = np.sort(order[fresh])
    return element[first], owner[first]


def _listed(element: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(element.astype(np.int64)))


def coordinates(document_class: int, item_class: int, containment: float, miss: float = MISS) -> int:
    """MinHash coordinates for documents of 2^c up to 2^(c+1) - 1 shingles and items of 2^d up to 2^(d+1) - 1."""
    largest = 2 ** (document_class + 1) - 1
    least = 1.0
    for size in range(2**item_class, 2 ** (item_class + 1)):
        need = math.ceil(containment * size - 1e-9)
        if need <= largest:
            least = min(least, need / (largest + size - need) if largest + size > need else 1.0)
    return max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - min(least, 1 - 1e-9)))))


def _signatures(element: np.ndarray, group: np.ndarray, groups: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, coordinate and least hash for the first ``wanted`` coordinates of each group; elements are ordered by group."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = np.bincount(group, minlength=groups)
    for c in range(int(wanted.max(initial=0))):
        use = np.flatnonzero((wanted > c) & (size > 0))
        if not len(use):
            break
        keep = np.zeros(groups, bool)
        keep[use] = True
        own = element[keep[group]]
        ends = np.append(0, np.cumsum(size[use]))[:-1]
        least = np.minimum.reduceat(mix(own ^ mix(np.array([c + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))), ends)
        out.append((use, np.full(len(use), c), least))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingle_table(items: DataFrame) -> np.ndarray:
    """A bit for each shingle of ``items`` (column shingles). The driver gets at most 2^21 words of 64 bits."""
    place = F.col("s").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bits = items.select(F.explode("shingles").alias("s")).select(
        F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("b"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for batch in bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        table[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return table.view(np.uint64)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 containment: float = CONTAINMENT) -> DataFrame:
    """Rows (doc_id, item_id, shared, item_size, containment): the items of which a document holds at least this share.

    Words are runs of letters and digits of the lower-cased text, shingles five words; an item's share is taken over its
    set of shingles and the whole document. An item of fewer than five words holds no shingle and is never found, nor is
    a null text. Documents with the same id are searched apart and reported once, with the best containment; a null id
    stays null. Items with the same id are separate texts. Both tables may be empty.

    An item of more than 1,024 shingles is cut into pieces in reading order: a document that holds its share of the whole
    holds that share of one piece at least. An item spread over a document of more than 1,024 benchmark shingles is sought in
    pieces of that many, overlapping by half: at least half of what it needs must stand in one piece. The check then covers
    the whole item and the whole document.
    """
    spark = docs.sparkSession
    source = benchmark.select(F.col(item_id).alias("item_id"), F.lower(F.col(item_text)).alias("text"))

    def cut_items(batch: pa.RecordBatch) -> pa.RecordBatch:
        element, owner = ordered_shingles(*flat(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("item_id"), _listed(element, np.bincount(owner, minlength=batch.num_rows))], ["item_id", "shingles"])

    held = source.mapInArrow(per_portion(cut_items), T.StructType([source.schema["item_id"]]).add("shingles", T.ArrayType(T.LongType())))
    items = materialise(held.where(F.size("shingles") > 0).withColumn("item_key", F.monotonically_increasing_id()))
    table = spark.sparkContext.broadcast(shingle_table(items))

    def reduce(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = table.value
        data, offsets = flat(batch.column("text"))
        element, owner, _ = windows(words(data, offsets, LOWER_ALNUM), SHINGLE)
        place = element & np.uint64((1 << TABLE_BITS) - 1)
        hit = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        element, owner = element[hit], owner[hit]
        # first places in the text only, in reading order
        element, owner = _first_places(element, owner)
        count = np.bincount(owner, minlength=batch.num_rows)
        rows = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), _listed(element, count[rows])], ["doc_id", "shingles"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))
    kind = plain.schema["doc_id"].dataType
    reduced = plain.mapInArrow(per_portion(reduce), T.StructType([T.StructField("doc_id", kind), T.StructField("shingles", T.ArrayType(T.LongType()))]))
    reduced = materialise(reduced.withColumn("row", F.monotonically_increasing_id()))

    pieces_ = F.ceil(F.size("shingles") / PIECE)
    ends = F.array(F.floor(F.size("shingles") / pieces_), F.ceil(F.size("shingles") / pieces_))
    sizes = items.select(F.explode(ends).alias("n")).select(F.floor(F.log2("n")).cast("int").alias("d")).distinct().collect()  # at most 11 classes
    classes = sorted(r.d for r in sizes)
    levels = range(int(math.log2(PIECE)) + 1)
    # half the share in a piece of a longer document: an item may lie across two
    need = {(c, d): coordinates(c, d, containment) for c in levels for d in classes} | {(c + PART, d): coordinates(c, d, containment / 2) for c in levels for d in classes}
    most = {c: max((need[c, d] for d in classes), default=0) for c in (*levels, *(c + PART for c in levels))}
    deepest = {d: max(need[c, d] for c in most) for d in classes}

    def sign_documents(batches):
        for batch in batches:
            for row, values in zip(batch.column("row").to_pylist(), batch.column("shingles"), strict=True):
                whole = values.values.to_numpy().view(np.uint64)
                starts = range(0, max(1, len(whole) - PIECE // 2), PIECE // 2) if len(whole) > PIECE else [0]
                pieces = [whole[s:s + PIECE] for s in starts]
                group = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
                level = np.array([int(math.log2(len(p))) + PART * (len(pieces) > 1) for p in pieces])
                own, c, least = _signatures(np.concatenate(pieces), group, len(pieces), np.array([most[x] for x in level]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(level[own].astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(least.astype(np.int64))], ["row", "c", "i", "least"])

    def sign_items(batches):
        for batch in batches:
            lists = batch.column("shingles")
            whole = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            parts = -(-whole // PIECE)
            of = np.repeat(np.arange(len(whole)), parts)
            # pieces of an item differ by one shingle at most
            place = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            count = (place + 1) * whole[of] // parts[of] - place * whole[of] // parts[of]
            level = np.floor(np.log2(count)).astype(int)
            own, c, least = _signatures(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(count)), count), len(count), np.array([deepest[x] for x in level]))
            yield pa.RecordBatch.from_arrays([batch.column("item_key").take(pa.array(of[own])), pa.array(level[own].astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(least.astype(np.int64))], ["item_key", "d", "i", "least"])

    document_side = reduced.select("row", "shingles").mapInArrow(sign_documents, "row bigint, c int, i int, least bigint")
    item_side = sized(materialise(items.select("item_key", "shingles").mapInArrow(sign_items, "item_key bigint, d int, i int, least bigint")))
    # each class pair looks at its own number of coordinates
    limits = F.create_map(*[F.lit(x) for (c, d), n in need.items() for x in (c * 64 + d, n)]) if need else None
    found = document_side.join(item_side, ["i", "least"])
    if limits is not None:
        found = found.where(F.col("i") < limits[F.col("c") * 64 + F.col("d")])
    candidates = found.select("row", "item_key").distinct()
    texts = items.select("item_key", "item_id", F.col("shingles").alias("item"))
    joined = candidates.join(reduced, "row").join(sized(texts), "item_key")
    shared = F.size(F.array_intersect("item", "shingles"))
    exact = joined.select("doc_id", "item_id", shared.cast("bigint").alias("shared"), F.size("item").cast("bigint").alias("item_size"))
    exact = exact.where(1000 * F.col("shared") >= round(1000 * containment) * F.col("item_size"))
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("item_size")).alias("containment"), "shared", "item_size")).alias("b"))
    return best.select("doc_id", "item_id", "b.shared", "b.item_size", "b.containment")


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The documents that hold no benchmark item; same columns. All rows that share an id with a contaminated one go."""
    ids = materialise(contaminated(docs, benchmark, doc_id, text, **options).select("doc_id").distinct())
    ids = sized(ids).withColumnRenamed("doc_id", "_contaminated")
    return docs.join(ids, docs[doc_id].eqNullSafe(ids["_contaminated"]), "left_anti")
