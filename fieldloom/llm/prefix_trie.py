"""Operator 12: the prefix tree of conversations, peeled from its deepest turns.

Every distinct sequence of first turns is a node. The peeling starts at the
greatest depth with the conversations that end there. Equal ones are one node.
Each node then loses its last turn and meets, one depth higher, the others that
now are the same sequence and the conversations that end at that depth. So every
node is found by the rows that make it, and its members, children, leaves and
the tokens its subtree shares are summed on the way; no table of all prefixes of
all conversations is made.

A row carries the turns it still has to lose, at most ``BLOCK`` of them; the
turns before come by a join once these are gone. A depth that many conversations
reach is one grouping with partial sums, so neither a common first turn nor
copies of a conversation fill a task. Neighbouring depths that together hold at
most ``NARROW_ROWS`` rows are peeled in one go, dealt out by the node they end in.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldloom.llm.common import materialise
from fieldloom.plans.lookup import lookup_join

# Turns that a row carries.
BLOCK = 64
# Rows of neighbouring depths that are peeled in one go.
NARROW_ROWS = 10_000
# Ids of ended conversations are joined into one text for each 512 numbers.
ID_BITS = 9

_STEP = T.StructType().add("t1", "long").add("t2", "long").add("words", "long")
_ROW = T.StructType().add("depth", "long").add("k1", "long").add("k2", "long").add("conv_id", "long").add("path", T.ArrayType(_STEP)).add(
    "n_convs", "long").add("child", "long").add("n_leaves", "long").add("saved", "long")
_NODE = T.StructType().add("depth", "long").add("k1", "long").add("k2", "long").add("p1", "long").add("p2", "long").add("conv_id", "long").add(
    "path", T.ArrayType(_STEP)).add("n_convs", "long").add("n_children", "long").add("n_leaves", "long").add("saved_tokens", "long")


def _half(hex_digits: Column, start: int) -> Column:
    return F.conv(F.substring(hex_digits, start, 16), 16, -10).cast("bigint")


def paths(turns: DataFrame) -> DataFrame:
    """The turns of every conversation in blocks: conv_id, top (the depth of the block's last turn), last, k1, k2, path.

    A turn's two values depend on its place, role and text. All of a sequence's values combined bit by bit are its key
    (k1, k2), given for the last block only; so a key without its last turn is the key of the shorter sequence.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    placed = turns.select("conv_id", F.row_number().over(order).cast("bigint").alias("place"), F.lead(F.lit(1)).over(order).isNull().alias("last"), digest.alias("digest"),
                          F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0))).cast("bigint").alias("words"))
    valued = placed.select("conv_id", "place", "last", "words", F.xxhash64("place", _half(F.col("digest"), 1)).alias("t1"), F.xxhash64("place", _half(F.col("digest"), 17)).alias("t2"))
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = valued.withColumns({"k1": F.bit_xor("t1").over(so_far), "k2": F.bit_xor("t2").over(so_far)})
    blocks = keyed.groupBy("conv_id", F.floor((F.col("place") - 1) / BLOCK).alias("block")).agg(
        F.max("place").alias("top"), F.max("last").alias("last"), F.max_by(F.struct("k1", "k2"), "place").alias("key"), F.array_sort(F.collect_list(F.struct("place", "t1", "t2", "words"))).alias("steps"))
    return blocks.select("conv_id", "top", "last", "key.k1", "key.k2", F.transform("steps", lambda s: F.struct(s["t1"].alias("t1"), s["t2"].alias("t2"), s["words"].alias("words"))).alias("path"))


def _strip(node: DataFrame) -> DataFrame:
    """Nodes as children: without their last turn, with the key of their parent."""
    return node.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", F.slice("path", 1, F.size("path") - 1).alias("path"), "n_convs",
                       F.lit(1).cast("bigint").alias("child"), "n_leaves", F.col("saved_tokens").alias("saved"))


def _regroup(rows: DataFrame) -> DataFrame:
    """The nodes of one depth from the conversations that end there and the children that lost a turn."""
    # equal keys have equal paths
    grouped = rows.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.first("path").alias("path"), F.sum("n_convs").alias("n_convs"),
                                                    F.sum("child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    last = F.try_element_at("path", F.lit(-1))
    value = lambda name: F.coalesce(last[name], F.lit(0).cast("bigint"))  # noqa: E731  the root has no turn
    return grouped.select("depth", "k1", "k2", F.col("k1").bitwiseXOR(value("t1")).alias("p1"), F.col("k2").bitwiseXOR(value("t2")).alias("p2"), "conv_id", "path", "n_convs", "n_children",
                          F.when(F.col("n_children") == 0, F.lit(1).cast("bigint")).otherwise(F.col("n_leaves")).alias("n_leaves"),
                          (F.col("saved") + (F.col("n_convs") - 1) * value("words")).alias("saved_tokens"))


def _peel(lowest: int):
    """The function for ``mapInArrow`` that peels whole subtrees down to the depth ``lowest``; only nodes there keep a path."""
    schema = to_arrow_schema(_NODE)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, out = defaultdict(dict), []

        def meet(depth, k1, k2, conv_id, path, n_convs, child, n_leaves, saved):
            held = waiting[depth].setdefault((k1, k2), [None, path, 0, 0, 0, 0])
            held[0] = conv_id if held[0] is None else held[0] if conv_id is None else min(held[0], conv_id)
            for i, x in enumerate((n_convs, child, n_leaves, saved), 2):
                held[i] += x

        for batch in batches:
            for row in batch.to_pylist():
                meet(**row)
        for depth in range(max(waiting, default=0), lowest - 1, -1):
            for (k1, k2), (conv_id, path, n_convs, n_children, n_leaves, saved) in waiting.pop(depth, {}).items():
                last = path[-1]
                node = {"depth": depth, "k1": k1, "k2": k2, "p1": k1 ^ last["t1"], "p2": k2 ^ last["t2"], "conv_id": conv_id, "path": path if depth == lowest else None, "n_convs": n_convs,
                        "n_children": n_children, "n_leaves": n_leaves if n_children else 1, "saved_tokens": saved + (n_convs - 1) * last["words"]}
                out.append(node)
                if depth > lowest:
                    meet(depth - 1, node["p1"], node["p2"], conv_id, path[:-1], n_convs, 1, node["n_leaves"], node["saved_tokens"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return work


def segments(reaching: dict[int, int]) -> list[tuple[int, int]]:
    """Ranges of depths from the greatest to 0, given how many conversations reach each depth.

    A range of several depths has at most NARROW_ROWS rows and turns of one block; the root is alone.
    """
    out: list[tuple[int, int]] = []
    rows = 0
    for depth in sorted(reaching, reverse=True):
        rows += reaching[depth]
        if out and depth and depth % BLOCK and rows <= NARROW_ROWS:
            out[-1] = (depth, out[-1][1])
        else:
            out.append((depth, depth))
            rows = reaching[depth]
    return out


def prefix_trie(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each node: depth, k1 and k2 (its key), conv_id (its smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    ``conversations`` has conv_id, turn, role and text. Turns are ordered by turn, null first, ties by role and text; repeated
    rows are turns of their own. Null role and text are empty ones. A null conv_id is one conversation; it is a node's
    conv_id only if the node has no other member. ``ids`` may name conversations without a turn, which end at the root; without any
    conversation there is no node. ``saved_tokens`` sums, over a node's subtree, each node's (n_convs - 1) times the words of
    its last text. ``ends_sha256`` is over the ids of the conversations that end at the node, ascending and joined by commas, null as "".
    Other columns are left.
    """
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = paths(turns)
    if ids is not None:
        known = turns.select("conv_id").distinct().withColumn("known", F.lit(True))
        named = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().alias("a").join(known.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left_anti")
        zero = F.lit(0).cast("bigint")
        blocks = blocks.unionByName(named.select("conv_id", zero.alias("top"), F.lit(True).alias("last"), zero.alias("k1"), zero.alias("k2"), F.array().cast(T.ArrayType(_STEP)).alias("path")))
    # in order of depth, so that reading a range of depths passes over the rest of a file
    blocks = materialise(blocks.sortWithinPartitions("top"))
    ended = {r["top"]: r["count"] for r in blocks.where("last").groupBy("top").count().collect()}
    depths = range(max(ended, default=-1), -1, -1)
    reaching = dict(zip(depths, itertools.accumulate(ended.get(d, 0) for d in depths), strict=True))
    survivors, found = None, []
    for low, high in segments(reaching):
        rows = blocks.where(F.col("last") & F.col("top").between(low, high)).select(
            F.col("top").alias("depth"), "k1", "k2", "conv_id", "path", F.lit(1).cast("bigint").alias("n_convs"), *[F.lit(0).cast("bigint").alias(c) for c in ("child", "n_leaves", "saved")])
        if survivors is not None:
            if high and high % BLOCK == 0:
                before = blocks.where(~F.col("last") & (F.col("top") == high)).select(F.col("conv_id").alias("of"), F.col("path").alias("earlier"))
                survivors = survivors.join(before, F.col("conv_id").eqNullSafe(F.col("of"))).select(*[F.col("earlier").alias("path") if c == "path" else F.col(c) for c in _ROW.names])
            rows = rows.unionByName(survivors)
        if low == high:
            nodes = _regroup(rows)
        else:
            gone = F.col("depth").cast("int") - low
            bottom = [F.aggregate(F.slice(F.col(f"path.{t}"), F.size("path") - gone + 1, gone), F.col(k), lambda a, x: a.bitwiseXOR(x)) for k, t in (("k1", "t1"), ("k2", "t2"))]
            nodes = rows.repartition(*bottom).select(*_ROW.names).mapInArrow(_peel(low), _NODE)
        nodes = materialise(nodes)
        found.append(nodes)
        survivors = _strip(nodes.where(F.col("depth") == low))
    every = functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _NODE)
    parents = materialise(every.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")))
    placed = lookup_join(every.where("depth > 0"), parents, ["p1", "p2"])
    root = every.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    ends = end_digests(blocks.where("last").select("conv_id", "k1", "k2"))
    columns = ["depth", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    joined = placed.select(columns).unionByName(root.select(columns)).join(ends, ["k1", "k2"], "left")
    return joined.select(*columns, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def end_digests(ended: DataFrame) -> DataFrame:
    """For each key (k1, k2) the SHA-256 of its conversations' ids, ascending and joined by commas.

    Ids are first joined for each 512 numbers, anywhere; these texts then stream through one task for each key in order.
    """
    near = ended.groupBy("k1", "k2", F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.coalesce("conv_id", F.lit(0)))).alias("ids"))
    text = F.when(F.col("block").isNull(), F.array_join(F.transform("ids", lambda x: F.lit("")), ",")).otherwise(F.array_join(F.col("ids").cast("array<string>"), ","))
    ordered = near.select("k1", "k2", "block", text.alias("ids")).repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.col("block").asc_nulls_first())
    schema = T.StructType().add("k1", "long").add("k2", "long").add("ends_sha256", "string")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("k1", "k2", "ids")]
            for k1, k2, ids in zip(*columns, strict=True):
                if (k1, k2) == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield _digests(out, schema)
                out = []
        if key is not None:
            yield _digests([(*key, digest.hexdigest())], schema)

    return ordered.mapInArrow(work, schema)


def _digests(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], to_arrow_schema(schema))
