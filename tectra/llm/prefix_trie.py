"""The trie of conversation prefixes, from globally sorted turn arrays.

Conversations are range-sorted by their turn arrays; the longest common prefixes of neighbours drive a stack whose closed
intervals are the trie's nodes. What is still open at a task's two ends (the prefixes of its first and last conversation)
is stitched afterwards: parts of one node meet by the digest of their prefix.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a turn in an array: MD5 of role and text, then the text's code points.
TURN = 20
_DIGEST = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
#: closed nodes have kind 0 (parent closed too) or 1 (parent is the open node of that side and depth); kind 2 are open nodes
_PARTS = "kind int, part int, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, size long, ends binary"
_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _PARTS.split(", "))])
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
#: Rows of an output batch.
_ROWS = 20_000


def turn_arrays(conversations: DataFrame, *keys: str) -> DataFrame:
    """Per conversation: conv_id, turns (TURN bytes a turn, in order of turn, null first; rows of one turn in order of their digests).
    Null roles and texts are empty. A conversation is one row of 20 bytes a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.unhex(F.concat(F.md5(said.cast("binary")), F.lpad(F.hex(F.length(text)), 8, "0")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("at"), turn.alias("turn")).alias("said"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said")).select("conv_id", F.unhex(F.array_join(F.transform("said", lambda x: F.hex(x["turn"])), "")).alias("turns"))


def rebuilt(arrays: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % group, h = crc32(decimal c) % heads."""
    base = F.expr(f"conv_id - conv_id % {group}")
    first = arrays.filter(f"conv_id % {group} = 0").select(F.col("conv_id").alias("base"), F.expr(f"substring(turns, 1, {TURN * (heads - 1)})").alias("head"))
    rows = arrays.withColumn("base", base).withColumn("h", F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {heads} as int)")).join(first, "base", "left")
    return rows.select("conv_id", F.expr(f"concat(coalesce(substring(head, 1, {TURN} * h), X''), substring(turns, {TURN} * h + 1))").alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that both arrays begin with."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("least", "n", "children", "leaves", "saved", "ends", "size", "waiting", "left")

    def __init__(self, size: int, left: bool):
        self.least, self.n, self.children, self.leaves, self.saved, self.ends, self.size, self.waiting, self.left = None, 0, 0, 0, 0, [], size, [], left

    def join(self, other: _Node) -> None:
        self.n += other.n
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least


def _prefix_keys(turns: bytes) -> list[bytes]:
    h = hashlib.md5()
    keys = [h.digest()]
    for k in range(0, len(turns), TURN):
        h.update(turns[k : k + TURN])
        keys.append(h.copy().digest())
    return keys


def _sweep(rows, part: int):
    """Rows of _PARTS for one task's sorted conversations. The left side are the prefixes of its first conversation, the right side
    those of its last one that are not among them."""
    stack, before, first = [_Node(0, True)], b"", None
    left = {}  # open nodes of the left side, by depth

    def close():
        node, parent = stack.pop(), stack[-1]
        parent.join(node)
        if node.left:
            left[len(stack)] = node
            return
        if not node.children:
            node.leaves = 1
        node.saved += (node.n - 1) * node.size
        for w in node.waiting:
            yield (0, part, None, w[0], w[1], node.least, *w[2:], None, None, None, None)
        parent.children += 1
        parent.leaves += node.leaves
        parent.saved += node.saved
        sha = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else _EMPTY
        own = (len(stack), node.least, node.n, node.children, node.leaves, node.saved, sha)
        if parent.left:
            yield (1, part, 0, own[0], own[1], None, *own[2:], None, None, None, None)
        else:
            parent.waiting.append(own)

    for conv, turns in rows:
        if first is None:
            first = turns
        shared = _common(before, turns)
        while len(stack) - 1 > shared:
            yield from close()
        for k in range(len(stack) - 1, len(turns) // TURN):
            stack.append(_Node(int.from_bytes(turns[k * TURN + _DIGEST : (k + 1) * TURN], "big"), turns is first))
        top = stack[-1]
        top.ends.append(conv)
        top.n += 1
        if top.least is None or conv < top.least:
            top.least = conv
        before = turns
    if first is None:
        return
    right = {}
    while len(stack) > 1:
        node = stack.pop()
        stack[-1].join(node)
        (left if node.left else right)[len(stack)] = node
    left[0] = stack[0]
    keys = _prefix_keys(first)
    for depth, node in left.items():
        yield _open(part, 0, depth, node, keys)
    if right:
        keys = _prefix_keys(before)
        for depth in range(len(keys)):
            node = right.get(depth)
            for w in node.waiting if node else ():
                yield (1, part, 1, w[0], w[1], None, *w[2:], None, None, None, None)
            yield _open(part, 1, depth, node, keys)


def _open(part: int, side: int, depth: int, node: _Node | None, keys: list[bytes]) -> tuple:
    """An open node's part. Without a node: the same task's left side counts it already."""
    above = keys[depth - 1] if depth else None
    if node is None:
        return (2, part, side, depth, None, None, 0, 0, 0, 0, None, keys[depth], above, 0, b"")
    return (2, part, side, depth, node.least, None, node.n, node.children, node.leaves, node.saved, None, keys[depth], above, node.size, b"".join(x.to_bytes(8, "little", signed=True) for x in node.ends))


def _batches(rows):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == _ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _swept(batches):
    pairs = (p for b in batches for p in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()))
    yield from _batches(_sweep(pairs, TaskContext.get().partitionId()))


def _digests(batches):
    """One digest a node of its conversations' ids, which come in order, a part a row; no part stays in memory."""
    key, h, n = None, None, 0
    out = []
    for b in batches:
        for k, ends in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, h.hexdigest()))
                key, h, n = k, hashlib.sha256(), 0
            ids = [int.from_bytes(ends[i : i + 8], "little", signed=True) for i in range(0, len(ends), 8)]
            h.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
            n += len(ids)
        if len(out) >= _ROWS:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["key", "ends_sha256"])
            out = []
    if key is not None:
        out.append((key, h.hexdigest()))
    if out:
        yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["key", "ends_sha256"])


def prefix_nodes(arrays: DataFrame) -> DataFrame:
    """Nodes of the trie over conversations' turn arrays (conv_id, turns); see `prefix_trie`.

    Sorted by (turns, conv_id) in ranges, so that a group of equal conversations of any size is dealt over tasks. A task holds its own
    range's open nodes; tasks exchange two prefixes each.
    """
    spark = arrays.sparkSession
    rows = arrays.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    parts = common.cut(rows.mapInArrow(_swept, _PARTS))
    pieces = parts.filter("kind = 2").select("part", "side", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "key", "parent_key", "size", "ends")
    merged = pieces.groupBy("key").agg(F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"), F.max("size").alias("size"), F.min(F.struct("part", "side")).alias("owner"))
    merged = common.cut(merged)
    below = merged.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("open"))
    nodes = merged.join(below, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("open", F.lit(0)))
    nodes = common.cut(nodes.select("key", "depth", "parent_key", "conv_id", "n_convs", "n_children", "owner", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own")))
    # a path's nodes add up from its end to the root; what a node adds itself counts on one path alone
    paths = pieces.select("part", "side", "depth", "key", "n_leaves", "saved_tokens").join(nodes.select("key", "owner", "leaf", "own"), "key")
    mine = F.col("owner") == F.struct("part", "side")
    down = Window.partitionBy("part", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = paths.select("key", *(F.sum(F.col(c) + F.when(mine, F.col(o)).otherwise(0)).over(down).alias(c) for c, o in (("n_leaves", "leaf"), ("saved_tokens", "own"))))
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = pieces.filter("length(ends) > 0").select("key", "part", "ends").repartition("key").sortWithinPartitions("key", "part").mapInArrow(_digests, "key binary, ends_sha256 string")
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    opened = nodes.join(sums, "key").join(ends, "key", "left").join(parents, "parent_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).select(_NODE)
    # closed nodes under an open one find it by task, side and depth, a key of no more rows than a task made
    places = pieces.select("part", "side", "depth", "key").join(nodes.select("key", F.col("conv_id").alias("above")), "key").select("part", "side", (F.col("depth") + 1).alias("depth"), "above")
    under = parts.filter("kind = 1").drop("parent_conv_id").join(places, ["part", "side", "depth"]).withColumnRenamed("above", "parent_conv_id").select(_NODE)
    return parts.filter("kind = 0").select(_NODE).unionByName(under).unionByName(opened)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per distinct sequence of first d turns (role, text) of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, a null turn stands before others, rows of one turn stand in order of their digests and repeated rows are
    turns of their own. Rows without conv_id belong to no conversation. An empty table has no node; a conversation without turns is a member
    of the root. Other columns are ignored. A text is 20 bytes in an array, whatever its length.
    """
    arrays = common.cut(turn_arrays(conversations.filter("conv_id IS NOT NULL")))
    return prefix_nodes(rebuilt(arrays))
