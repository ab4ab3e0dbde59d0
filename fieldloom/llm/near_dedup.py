"""Operator 8: near-duplicate classes by DartMinHash.

Each shingle owns a region of the plane weight x rank: as wide as its weight,
without end in rank. Darts fall on the plane by a Poisson process that depends
on the shingle alone. Each dart has a coordinate; a document keeps, for each
coordinate, the dart of lowest rank among the regions of its shingles. Two
documents agree in a coordinate with the probability of their weighted Jaccard
similarity. Ranks beyond a bound are never generated, so the work is the number
of shingles plus the darts below the bound, whatever the number of coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import materialise, per_portion, sized, text_key
from fieldloom.llm.words import LOWER_ALNUM, flat, mix, uniform, windows, words

SHINGLE = 5
SIMILARITY = 0.8
# A pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^24 = 0.00007.
BANDS = 24
ROWS = 5
# Members of a bucket are first compared in sub-buckets of about so many, beside the bucket's leader.
SUB_BUCKET = 8
# Shingles are ordered by how often their class of so many occurs, the rarest first.
ORDER_CLASSES = 1 << 18


def dart_signatures(texts: int, text: np.ndarray, element: np.ndarray, weight: np.ndarray | None, coordinates: int) -> np.ndarray:
    """Ids of the earliest dart per coordinate, one row for each text; a text without elements has zeros.

    ``text`` numbers the texts of the elements, ``weight`` is 1 if None. With weight 1 a repeated element changes nothing.
    """
    signature = np.zeros((texts, coordinates), np.uint64)
    total = np.bincount(text, weight, texts)
    todo = total > 0
    bound = np.where(todo, coordinates * (math.log(coordinates) + 2) / np.maximum(total, 1e-300), 0.0)
    while todo.any():
        use = todo[text]
        own_text, own, own_weight = text[use], element[use], None if weight is None else weight[use]
        found_text, found_rank, found_id = _throw(own_text, own, own_weight, bound)
        place = found_text * coordinates + (found_id % np.uint64(coordinates)).astype(np.int64)
        order = np.argsort(-found_rank, kind="stable")
        fresh = np.zeros(texts * coordinates, np.uint64)
        fresh[place[order]] = found_id[order]
        fresh = fresh.reshape(texts, coordinates)
        full = todo & (fresh != 0).all(axis=1)
        signature[full] = fresh[full]
        todo &= ~full
        bound *= 2
    return signature


def _throw(text: np.ndarray, element: np.ndarray, weight: np.ndarray | None, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts in the elements' regions up to their text's bound: text, rank, id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low, high, level = 0.0, 1.0, 0
    top = 1.0 if weight is None else float(weight.max(initial=0))
    while low < top:
        active = np.arange(len(element)) if weight is None else np.flatnonzero(weight > low)
        rank = np.zeros(len(active))
        throw = 0
        while len(active):
            seed = mix(element[active] + np.uint64(((level << 40) + throw + 1) * 0xD1342543DE82EF95 % (1 << 64)))
            rank = rank - np.log(uniform(seed)) / (high - low)
            inside = rank <= bound[text[active]]
            active, rank, seed = active[inside], rank[inside], seed[inside]
            dart = mix(seed ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1 << 63)
            if weight is None:
                out.append((text[active], rank, dart))
            else:
                hit = low + uniform(mix(dart)) * (high - low) <= weight[active]
                out.append((text[active][hit], rank[hit], dart[hit]))
            throw += 1
        low, high, level = high, high * 2, level + 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of a signature; the number of the band is part of the key."""
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.zeros((len(signature), 1), np.uint64)
    for j in range(rows):
        keys = mix(keys ^ signature[:, j::rows][:, :bands])
    return keys.astype(np.int64)


def with_bands(docs: DataFrame, weighting: str = "set", bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """Replace the lower-cased ``text`` by ``bands``; null for a text without a word. All other columns stay."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat(batch.column("text"))
        element, text, _ = windows(words(data, offsets, LOWER_ALNUM), shingle, short=True)
        weight = None
        if weighting == "count" and len(element):
            order = np.lexsort((element, text))
            element, text = element[order], text[order]
            first = np.flatnonzero(np.append(True, (element[1:] != element[:-1]) | (text[1:] != text[:-1])))
            weight = np.diff(np.append(first, len(element))).astype(float)
            element, text = element[first], text[first]
        n = batch.num_rows
        signature = dart_signatures(n, text, element, weight, bands * rows)
        keys = band_keys(signature, bands, rows)
        some = np.bincount(text, minlength=n) > 0
        flat_keys = pa.array(keys[some].ravel(), pa.int64())
        ends = np.append(0, np.cumsum(np.where(some, bands, 0))).astype(np.int32)
        # a null offset marks the list that begins there as null
        offsets_ = pa.array(ends, pa.int32(), mask=np.append(~some, False))
        lists = pa.ListArray.from_arrays(offsets_, flat_keys)
        rest = [c for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists], [*rest, "bands"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(per_portion(sign), f"{rest}, bands array<bigint>")


def with_shingles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Replace the lower-cased ``text`` by the sorted set of its shingle hashes."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = flat(batch.column("text"))
        element, text, _ = windows(words(data, offsets, LOWER_ALNUM), shingle, short=True)
        order = np.lexsort((element, text))
        element, text = element[order], text[order]
        if len(element):
            first = np.append(True, (element[1:] != element[:-1]) | (text[1:] != text[:-1]))
            element, text = element[first], text[first]
        ends = np.append(0, np.cumsum(np.bincount(text, minlength=batch.num_rows))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(element.astype(np.int64)))
        rest = [c for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), lists], [*rest, "shingles"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(per_portion(cut), f"{rest}, shingles array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of its component.

    Alternating large-star and small-star steps: every step hangs nodes under the
    smallest neighbour known, and no step holds a node's neighbours in one place.
    """
    both = edges.select("a", "b").where("a <> b")
    current = materialise(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        sides = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        small = materialise(small.where("a <> b").distinct())
        # done when every node has one parent and no parent has a parent
        state = small.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
        deep = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        current = small
        if state.n == state.d and not deep:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def similar_pairs(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets have at least this Jaccard similarity; ``pairs`` is a written table.

    If the keys in question are few, only their sets are moved.
    """
    asked = sized(materialise(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()))
    sets = shingles.join(asked, "key", "left_semi")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("right_set"))
    shared = F.size(F.array_intersect("left_set", "right_set"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", shared.alias("s"), (F.size("left_set") + F.size("right_set")).alias("t"))
    # s / (t - s) >= similarity, in whole thousandths
    return joined.where(1000 * F.col("s") >= round(1000 * similarity) * (F.col("t") - F.col("s"))).select("a", "b")


def sharing_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of keys of different roots that can have this Jaccard similarity, from rows (key, root, shingles).

    No pair that has it is missing: two such sets share a shingle among the first of each in any common order, here the
    rarest first, and the places of the first one they share leave room for the overlap they need.
    """
    share = round(1000 * similarity)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ORDER_CLASSES, np.int64)
        for batch in batches:
            values = batch.column("shingles").flatten().to_numpy().view(np.uint64)
            n += np.bincount((values % np.uint64(ORDER_CLASSES)).astype(np.int64), minlength=ORDER_CLASSES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["class", "n"])

    counted = sets.select("shingles").mapInArrow(count, "class bigint, n bigint").groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(ORDER_CLASSES, np.int64)
    often[counted["class"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            value = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((value, often[(value.view(np.uint64) % np.uint64(ORDER_CLASSES)).astype(np.int64)], row))
            place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
            first = place < (size + (-share * size // 1000) + 1)[row]
            at = row[first]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), batch.column("root").take(pa.array(at)), pa.array(value[order][first]), pa.array(place[first]), pa.array(size[at])],
                                             ["key", "root", "shingle", "place", "size"])

    kind = sets.schema["key"].dataType.simpleString()
    firsts = materialise(sets.select("key", "root", "shingles").mapInArrow(begin, f"key {kind}, root {kind}, shingle bigint, place bigint, size bigint"))
    several = firsts.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    firsts = materialise(firsts.join(several, "shingle"))
    left = firsts.select("shingle", F.col("key").alias("a"), F.col("root").alias("root_a"), F.col("place").alias("place_a"), F.col("size").alias("size_a"))
    right = firsts.select("shingle", F.col("key").alias("b"), F.col("root").alias("root_b"), F.col("place").alias("place_b"), F.col("size").alias("size_b"))
    both = F.col("size_a") + F.col("size_b")
    room = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    able = ((1000 + share) * F.least("size_a", "size_b") >= share * both) & ((1000 + share) * room >= share * both)
    # the rule holds for the first shared shingle, so the pair comes once or more
    return left.join(right, "shingle").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & able).select("a", "b").distinct()


def _apart(placed: DataFrame) -> DataFrame:
    """The buckets whose members are of several classes."""
    return placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighting: str = "set",
                           bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document: doc_id, key (of the text), class_id, class_size, representative.

    class_id is the smallest doc_id of the class, representative is true for the
    documents that have that id and the text it belongs to. Words are runs of
    letters and digits of the lower-cased text, shingles are five words, similarity
    is Jaccard of the shingle sets, checked exactly for every candidate pair, and
    classes are closed under links. A text of one to four words is one shingle.
    Equal texts are one class, whatever their words. Null texts count as empty;
    empty texts are one class, texts without any word only match equal texts.
    Repeated rows are members of their class. A null doc_id is kept and is class_id
    only where no document of the class has an id. ``weighting="count"`` weights a
    shingle by its occurrences when candidates are sought.

    Candidates: members of a band's bucket are compared with the bucket's leader,
    the member that shares most buckets with others; first with the greatest of
    their leaders, then with those that are still in another class, and then
    within random sub-buckets of about eight. Members of buckets that still hold
    several classes are compared wherever their rarest shingles allow the
    similarity, so that no similar pair of a bucket is left out.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"), text_key(F.col(text)).alias("text_key"))
    signed = materialise(with_bands(source, weighting, bands, rows))
    distinct = signed.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    # from here on a text is a number
    nodes = materialise(distinct.withColumn("key", F.monotonically_increasing_id()))
    buckets = nodes.select("key", F.explode("bands").alias("bucket"))
    sizes = materialise(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = materialise(buckets.join(sized(sizes), "bucket"))
    crowd = materialise(members.groupBy("key").agg(F.sum("size").alias("crowd")))
    leaders = members.join(sized(crowd), "key").groupBy("bucket").agg(F.max(F.struct("crowd", "key")).alias("lead")).select("bucket", F.col("lead.key").alias("b"), "lead.crowd")
    star = materialise(members.join(sized(materialise(leaders)), "bucket").where("key <> b").groupBy(F.col("key").alias("a"), "b").agg(F.first("crowd").alias("crowd")))

    wanted = crowd.select("key").join(nodes.select("key", "text_key", "rep"), "key")
    texts = docs.select(text_key(F.col(text)).alias("text_key"), F.col(doc_id).alias("id"), F.lower(F.col(text)).alias("text"))
    one = texts.join(wanted, (texts["text_key"] == wanted["text_key"]) & texts["id"].eqNullSafe(wanted["rep"])).select("key", "text").dropDuplicates(["key"])
    shingles = materialise(with_shingles(one))
    best = materialise(star.groupBy("a").agg(F.max(F.struct("crowd", "b")).alias("m")).select("a", F.col("m.b").alias("b")))
    first = materialise(similar_pairs(best, shingles, similarity))
    roots = components(first)
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    # the other leaders, where they are in another class
    rest = star.select("a", "b").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    rest = materialise(rest.join(best, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        first = materialise(first.unionByName(similar_pairs(rest, shingles, similarity)))
        roots = components(first)

    # what the leaders left apart
    links = first
    placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "bucket", "size", F.coalesce("root", "key").alias("root"))
    apart = materialise(_apart(placed))
    if not apart.isEmpty():
        sub = F.pmod(F.xxhash64("key", "bucket"), F.ceil(F.col("size") / SUB_BUCKET))
        groups = placed.join(sized(apart), "bucket").groupBy("bucket", sub.alias("sub")).agg(F.array_sort(F.collect_list(F.struct("key", "root"))).alias("g"))
        tails = F.transform("g", lambda x, i: F.struct(x.alias("x"), F.filter(F.slice("g", i + 2, F.size("g")), lambda y: y["root"] != x["root"]).alias("ys")))
        pairs = groups.select(F.explode(tails).alias("t")).select(F.col("t.x").alias("x"), F.explode("t.ys").alias("y"))
        pairs = materialise(pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct())
        second = materialise(similar_pairs(pairs, shingles, similarity))
        if not second.isEmpty():
            links = links.unionByName(second)
            roots = components(links)

        # what is still apart in a bucket, exactly
        placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "bucket", F.coalesce("root", "key").alias("root"))
        open_ = materialise(placed.join(sized(materialise(_apart(placed))), "bucket").select("key", "root").distinct())
        if not open_.isEmpty():
            pairs = materialise(sharing_pairs(shingles.join(sized(open_), "key"), similarity))
            third = materialise(similar_pairs(pairs, shingles, similarity))
            if not third.isEmpty():
                roots = components(links.unionByName(third))

    rooted = nodes.select("key", "text_key", "rep", "n").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = materialise(rooted)
    best = F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "text_key")))
    classes = rooted.groupBy("root").agg(F.coalesce(best, F.min(F.struct("rep", "text_key"))).alias("best"), F.sum("n").alias("class_size"))
    labelled = rooted.join(classes, "root").select("text_key", F.col("best.rep").alias("class_id"), F.col("best.text_key").alias("class_key"), "class_size")
    out = signed.select("doc_id", "text_key").join(labelled, "text_key")
    chosen = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    return out.select("doc_id", F.col("text_key").alias("key"), "class_id", "class_size", chosen.alias("representative"))


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """One document of each class, with all its columns; of repeated rows one."""
    found = near_duplicate_classes(docs, doc_id, text, **options)
    chosen = materialise(found.where("representative").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.col(text)).alias("key"), F.col(doc_id).alias("id"))
    small = sized(chosen)
    kept = rows.join(small, (rows["key"] == small["_key"]) & rows["id"].eqNullSafe(small["_id"]), "left_semi")
    return kept.dropDuplicates(["key"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
