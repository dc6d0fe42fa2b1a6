"""Prefix trie of conversations by Patricia construction.

Conversations that start with the same turns share nodes; a node is a distinct sequence of first turns. Paths are
strings of 16-byte turn hashes, so that the order of bytes puts equal beginnings side by side:

* Paths are sorted over ranges of partitions, by path and conversation; copies of a path may span several ranges.
* Each range is read once, with a stack of the points of the path at hand: branches, ends and leaves; what lies between
  two points is a compressed edge. A point that the next path leaves is closed: its sums go to the point below.
  On closing, the unary nodes of its edge are expanded; their savings are sums over the rest of the edge.
* Nodes on a range's first or last path may go on in the neighbouring ranges. Their sums are added up by node; for the
  nodes that two neighbours share, what both counted (a child, a leaf, one occurrence to keep) is taken back.
* A node at the top of an edge gets its parent's conversation by a join on the node's hash, the parents of very many
  children by broadcast.

Conversations without an id take no part; equal turns of a conversation are in order of role and text; null roles and
texts are empty. A repeated row is a turn of its own. A path is one row of 24 bytes a turn, however long its texts.
An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop, join_hot, stored

FAMILY, LONGEST_HEAD = 100, 5
_ROOT = b"\0" * 16


def paths(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of turns (conv_id, turn, role, text): hashes and lengths in code points, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = df.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    hash_ = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary")))
    turns = rows.select("conv_id", F.struct(place.alias("place"), hash_.alias("hash"), F.length("text").cast("long").alias("size")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.hash.alias("hash"), t["size"].alias("size"))).alias("turns"))


def rebuilt(df: DataFrame) -> DataFrame:
    """Paths whose first turns are those of their family's first conversation: crc32 of the id modulo 6 of them."""
    own = stored(paths(df), "trie-paths")
    head = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, LONGEST_HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST_HEAD + 1)).cast("int")
    both = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(head, "family", "left")
    first = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns") + 1)).alias("turns"))


class _Point:
    __slots__ = ("children", "depth", "ends", "least", "leaves", "n", "saved")

    def __init__(self, depth: int, n: int = 0, least: int | None = None):
        self.depth, self.n, self.least = depth, n, least
        self.children, self.leaves, self.saved = 0, 0, 0  # saved: by nodes below the point
        self.ends = array("q")


def _decimals(ids) -> bytes:
    return ",".join(map(str, ids)).encode()


_COLUMNS = {
    "kind": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "part": pa.int64(), "data": pa.binary(), "first": pa.binary(), "last": pa.binary(),
}
_SQL = ", ".join(f"{k} {'int' if t == pa.int32() else 'string' if t == pa.string() else 'binary' if t == pa.binary() else 'bigint'}" for k, t in _COLUMNS.items())
NODE, SPINE, ENDS, RANGE = range(4)  # kinds of rows
_CHUNK = 1 << 16


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths have in common at their beginning."""
    lo, hi = 0, min(len(a), len(b)) // 16
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[16 * lo : 16 * mid] == b[16 * lo : 16 * mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class _Range:
    """The trie of one sorted range of paths."""

    def __init__(self, part: int):
        self.part, self.rows, self.stack = part, [], [_Point(0)]
        self.path, self.first, self.first_sizes, self.on_first = None, b"", b"", 0
        self.ids, self.upto = [_ROOT], [0]  # of each node of the path: its hash, code points down to it

    def add(self, conv: int, path: bytes, sizes: np.ndarray) -> None:
        n = len(path) // 16
        if self.path is None:
            self.first, self.first_sizes, self.on_first, common = path, sizes.astype("<i8").tobytes(), n, 0
        else:
            common = shared_turns(path, self.path)
            self.leave(common)
            self.on_first = min(self.on_first, common)
        del self.ids[common + 1 :], self.upto[common + 1 :]
        for d in range(common, n):
            self.ids.append(hashlib.md5(self.ids[d] + path[16 * d : 16 * d + 16]).digest())
            self.upto.append(self.upto[d] + int(sizes[d]))
        top = self.stack[-1]
        if n > common:
            top.children += 1
            top = _Point(n)
            self.stack.append(top)
        top.n += 1
        top.least = conv if top.least is None else min(conv, top.least)
        top.ends.append(conv)
        self.path = path

    def leave(self, depth: int, last: bool = False) -> None:
        """Close points below a depth; a branch is made there if none is."""
        while self.stack[-1].depth > depth:
            t, b = self.stack.pop(), self.stack[-1]
            if b.depth < depth:
                b = _Point(depth)
                b.children = 1
                self.stack.append(b)
            if not t.children:
                t.leaves = 1
            self.close(t, b.depth, last)
            b.n, b.leaves = b.n + t.n, b.leaves + t.leaves
            b.least = t.least if b.least is None else min(b.least, t.least)
            b.saved += t.saved + (t.n - 1) * (self.upto[t.depth] - self.upto[b.depth])

    def close(self, t: _Point, above: int, last: bool) -> None:
        for d in range(t.depth, above, -1):
            at_point, spine = d == t.depth, last or d <= self.on_first
            known = not spine and d - 1 > max(above, self.on_first)  # the parent has the same members
            self.row(t, d, at_point, SPINE if spine else NODE, t.least if known else None, None if known else self.ids[d - 1])

    def row(self, t: _Point, d: int, at_point: bool, kind: int, parent_conv, parent) -> None:
        saved = t.saved + (t.n - 1) * (self.upto[t.depth] - self.upto[d - 1] if d else 0)
        node = self.ids[d] if kind == SPINE or at_point and t.children else None
        ends = hashlib.sha256(_decimals(t.ends if at_point else [])).hexdigest() if kind == NODE else None
        self.rows.append((kind, node, parent, t.least, d, parent_conv, t.n, t.children if at_point else 1, t.leaves, saved, ends, None, None, None, None))
        if kind == SPINE and at_point:
            for i in range(0, len(t.ends), _CHUNK):
                self.rows.append((ENDS, self.ids[d], *[None] * 2, i, *[None] * 6, self.part, _decimals(t.ends[i : i + _CHUNK]), None, None))

    def finish(self) -> None:
        self.leave(0, last=True)
        root = self.stack[0]
        if not root.children:
            root.leaves = 1
        self.row(root, 0, True, SPINE, None, None)
        self.rows.append((RANGE, *[None] * 10, self.part, self.first_sizes, self.first, self.path))

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)], names=list(_COLUMNS))


def _ranges(batches):
    trie = _Range(TaskContext.get().partitionId())
    for batch in batches:
        conv, path, sizes = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        from_, flat = sizes.offsets.to_numpy(), sizes.values.to_numpy()
        for r in range(batch.num_rows):
            trie.add(conv[r], path[r].as_py(), flat[from_[r] : from_[r + 1]])
            if len(trie.rows) > 10_000:
                yield trie.taken()
    if trie.path is not None:
        trie.finish()
        yield trie.taken()


def _shared(batches):
    """What two neighbouring ranges both counted, for each node that they share, to take back."""
    for batch in batches:
        rows = []
        for before, first, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, node = shared_turns(before, first), _ROOT
            upto = np.append(0, np.cumsum(np.frombuffer(sizes, "<i8"))).tolist()
            for d in range(n + 1):
                parent = None if d == 0 else node
                node = node if d == 0 else hashlib.md5(node + first[16 * d - 16 : 16 * d]).digest()
                rows.append((node, parent, d, -int(d < n), -int(16 * n == len(before)), upto[n] - upto[max(0, d - 1)]))
        kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "parent", "depth", "n_children", "n_leaves", "saved_tokens"])


def _end_hashes(batches):
    """SHA-256 of each node's chunks, which follow each other in order."""
    at, sha = None, None
    for batch in batches:
        done = []
        for node, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if node == at:
                sha.update(b",")
            else:
                if at is not None:
                    done.append((at, sha.hexdigest()))
                at, sha = node, hashlib.sha256()
            sha.update(data.as_buffer())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in ((0, pa.binary()), (1, pa.string()))], names=["node", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of paths (conv_id, turns array of (hash, size)).

    conv_id: the least member; depth; parent_conv_id; n_convs: members; n_children; n_leaves: childless nodes at or
    below; saved_tokens: over the node and all below, (n_convs - 1) times the last turn's size; ends_sha256: of the ids
    that end here, ascending, with commas.
    """
    path = F.array_join(F.transform("turns", lambda t: F.hex(t.hash)), "")
    rows = stored(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(path).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "trie-rows")
    local = stored(rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_ranges, _SQL), "trie-ranges")

    in_order = Window.orderBy("part")  # a row for each range
    pairs = local.where(F.col("kind") == RANGE).select(F.lag("last").over(in_order).alias("before"), "first", "data").where("before is not null")
    numbers = ["n_children", "n_leaves", "saved_tokens"]
    back = pairs.mapInArrow(_shared, f"node binary, parent binary, depth bigint, {', '.join(f'{c} bigint' for c in numbers)}").select("node", "parent", "depth", F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"), *numbers)
    parts = local.where(F.col("kind") == SPINE).select(*back.columns).union(back)
    spine = parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", *numbers)])
    chunks = local.where(F.col("kind") == ENDS).select("node", "data", "part", F.col("conv_id").alias("seq"))
    ends = chunks.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "data").mapInArrow(_end_hashes, "node binary, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    spine = stored(spine.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "trie-spine")

    nodes = local.where(F.col("kind") == NODE)
    parents = stored(nodes.where("node is not null").select("node", "conv_id", "n_children").union(spine.where("n_children > 0").select("node", "conv_id", "n_children")).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), "trie-parents")
    found = [c for c in _OUT if c != "parent_conv_id"]
    tops = nodes.where("parent is not null").select("parent", *found).union(spine.where("parent is not null").select("parent", *found))
    inner = nodes.where("parent is null").select(*_OUT)
    root = spine.where("parent is null").select(*[F.lit(None).cast("long").alias(c) if c == "parent_conv_id" else F.col(c) for c in _OUT])
    drop(rows)
    return join_hot(tops, parents, "parent", "n").select(*_OUT).union(inner).union(root)
