"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id has ``ID_BYTES`` bytes: the code points of its text as 4 big-endian bytes, then 16 bytes
of the SHA-256 of role and text. So equal turns have equal ids without a dictionary to join, however
common a turn is, and an id tells the length of its text. A conversation is the byte string of its
turns' ids.

Byte strings and conv_ids are dealt by range, so that equal conversations, however many, lie on several
tasks; each task passes on its runs' ids in pieces. A second range deal brings the distinct byte
strings in order. Each task builds adaptive radix trees over blocks of them (4, 16, 48 and 256 children,
single paths compressed) and emits a trie node wherever a byte depth is a whole number of turns. Nodes that
neighbouring blocks may share lie on the paths of a block's first and last string; those stay open and
are merged in a reduction tree over consecutive blocks, all others are final at once.

Defined results: rows of null conv_id belong to no conversation; null role or text is empty; turns of a
conversation are ordered by turn (null first), then by id, and repeated rows are turns of their own; an
empty table gives an empty result; further columns are ignored. Values beside texts are of long range.
One conversation's ids (20 bytes a turn) are held in one row, as one text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_side, stage_table

ID_BYTES = 20
#: Conversations of which each hundredth is a base, and the most turns that are taken from it.
BASE_EVERY = 100
BASE_TURNS = 6
#: Distinct byte strings, and bytes of them, that one tree holds at most.
BLOCK_KEYS = 20_000
BLOCK_BYTES = 8 << 20
#: Blocks whose open nodes one task merges.
FAN_IN = 64
#: Most tasks that build trees; the open nodes are at most two paths a task.
MAX_PARTS = 4096
#: Characters of one piece of joined conv_ids.
PIECE_CHARS = 1 << 16

_EMPTY = hashlib.sha256(b"").hexdigest()


# --- adaptive radix tree --------------------------------------------------------


class Node:
    """A radix tree node: the compressed bytes before it, what ends at it, and its children.

    Up to 4 and 16 children are kept as sorted bytes beside a list, up to 48 as a table of 256
    places into a list, more as a list of 256."""

    __slots__ = ("prefix", "value", "size", "bytes", "places", "kids")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value, self.size = prefix, value, 4
        self.bytes, self.places, self.kids = bytearray(), None, []

    def child(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = self.bytes.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.size == 48:
            at = self.places[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Sets the child of ``byte``; a full node grows to the next layout."""
        if self.size <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.kids[at] = node
                return
            if len(self.kids) == self.size:
                self.grow()
                return self.put(byte, node)
            at = sum(b < byte for b in self.bytes)
            self.bytes.insert(at, byte)
            self.kids.insert(at, node)
        elif self.size == 48:
            if self.places[byte]:
                self.kids[self.places[byte] - 1] = node
            elif len(self.kids) == 48:
                self.grow()
                self.put(byte, node)
            else:
                self.kids.append(node)
                self.places[byte] = len(self.kids)
        else:
            self.kids[byte] = node

    def grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            self.places = bytearray(256)
            for k, byte in enumerate(self.bytes):
                self.places[byte] = k + 1
            self.size, self.bytes = 48, None
        else:
            every = [None] * 256
            for byte in range(256):
                if self.places[byte]:
                    every[byte] = self.kids[self.places[byte] - 1]
            self.size, self.kids, self.places = 256, every, None

    def children(self) -> list[tuple[int, Node]]:
        """In the order of their bytes."""
        if self.size <= 16:
            return list(zip(self.bytes, self.kids))
        if self.size == 48:
            return [(b, self.kids[self.places[b] - 1]) for b in range(256) if self.places[b]]
        return [(b, kid) for b, kid in enumerate(self.kids) if kid is not None]


def insert(root: Node, key: bytes, value) -> None:
    """Puts ``value`` at ``key``; the root's prefix is empty."""
    node, at = root, 0
    while at < len(key):
        kid = node.child(key[at])
        if kid is None:
            node.put(key[at], Node(key[at + 1 :], value))
            return
        prefix, begin = kid.prefix, at + 1
        if key.startswith(prefix, begin):
            node, at = kid, begin + len(prefix)
            continue
        same, most = 0, min(len(prefix), len(key) - begin)
        while same < most and prefix[same] == key[begin + same]:
            same += 1
        fork = Node(prefix[:same])
        kid.prefix = prefix[same + 1 :]
        fork.put(prefix[same], kid)
        node.put(key[at], fork)
        node, at = fork, begin + same
    node.value = value


# --- trie nodes of a block --------------------------------------------------------


class Turns:
    """A trie node: a sequence of turns. ``node`` is its digest where the node is or was open."""

    __slots__ = ("depth", "up", "length", "n", "least", "ends", "kids", "leaves", "saved", "node", "first", "last")

    def __init__(self, depth: int, up: Turns | None, length: int):
        self.depth, self.up, self.length = depth, up, length
        self.n, self.least, self.ends = 0, None, None
        self.kids = self.leaves = self.saved = 0
        self.node, self.first, self.last = None, False, False

    def end(self, n: int, least: int, ends: str) -> None:
        self.ends = ends
        self.meet(n, least)

    def meet(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def close(self) -> None:
        """Own saved tokens and, without children, the own leaf."""
        self.saved += (self.n - 1) * self.length
        if not self.kids:
            self.leaves += 1


def turn_nodes(root: Node) -> list[Turns]:
    """The trie nodes of a tree in preorder; only depths of whole turns make one. ``n``, ``least`` and ``ends``
    are those of the strings that end there."""
    out, path = [Turns(0, None, 0)], bytearray()
    if root.value:
        out[0].end(*root.value)
    stack = [(kid, bytes([b]), 0, out[0]) for b, kid in reversed(root.children())]
    while stack:
        node, byte, at, above = stack.pop()
        del path[at:]
        path += byte + node.prefix
        for depth in range(at // ID_BYTES + 1, len(path) // ID_BYTES + 1):
            begin = (depth - 1) * ID_BYTES
            above = Turns(depth, above, int.from_bytes(path[begin : begin + 4], "big"))
            out.append(above)
        if node.value:
            above.end(*node.value)
        at = len(path)
        stack.extend((kid, bytes([b]), at, above) for b, kid in reversed(node.children()))
    return out


def block_nodes(block: list[tuple[bytes, tuple[int, int, str]]]) -> tuple[list[Turns], list[Turns]]:
    """Final and open nodes of a block of sorted distinct byte strings."""
    root = Node(b"")
    for key, value in block:
        insert(root, key, value)
    nodes = turn_nodes(root)
    for key, last in ((block[0][0], False), (block[-1][0], True)):
        digest = hashlib.sha256()
        path, node = [], nodes[-1] if last else nodes[len(key) // ID_BYTES]
        while node is not None:
            path.append(node)
            node = node.up
        for depth, node in enumerate(reversed(path)):
            digest.update(key[(depth - 1) * ID_BYTES : depth * ID_BYTES] if depth else b"")
            node.node = digest.copy().digest()[:16]
            if last:
                node.last = True
            else:
                node.first = True
    return settle(nodes)


def settle(nodes: list[Turns]) -> tuple[list[Turns], list[Turns]]:
    """Final and still open nodes of ``nodes``, which come with parents first; open ones are at a block's
    border (``first`` or ``last``). A final node is counted in its parent."""
    for node in reversed(nodes):
        if not (node.first or node.last):
            node.close()
            node.up.kids += 1
            node.up.leaves += node.leaves
            node.up.saved += node.saved
        if node.up is not None:
            node.up.meet(node.n, node.least)
    return [x for x in nodes if not (x.first or x.last)], [x for x in nodes if x.first or x.last]


def merge(parts: list[list[Turns]], at_end: bool = False) -> tuple[list[Turns], list[Turns]]:
    """Final and open nodes of consecutive blocks' open nodes; none stays open ``at_end``."""
    met: dict[bytes, Turns] = {}
    for k, part in enumerate(parts):
        for node in part:
            held = met.get(node.node)
            if held is None:
                held = met[node.node] = Turns(node.depth, node.up and met[node.up.node], node.length)
                held.node = node.node
            held.meet(node.n, node.least)
            held.ends = held.ends or node.ends
            held.kids += node.kids
            held.leaves += node.leaves
            held.saved += node.saved
            held.first |= node.first and k == 0 and not at_end
            held.last |= node.last and k == len(parts) - 1 and not at_end
    nodes = sorted(met.values(), key=lambda x: x.depth)
    for node in reversed(nodes):
        if not (node.first or node.last):
            node.close()
            if node.up is not None:
                node.up.kids += 1
                node.up.leaves += node.leaves
                node.up.saved += node.saved
    return [x for x in nodes if not (x.first or x.last)], [x for x in nodes if x.first or x.last]


# --- rows of nodes --------------------------------------------------------------

_ROW = (
    "part bigint, open boolean, node binary, up binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, length bigint, first boolean, last boolean"
)
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _ROW.split(", ")])


def _rows(nodes: list[Turns], part: int, still_open: bool) -> list[tuple]:
    """A final parent gives its smallest member; one that was open when its child was settled, its digest."""
    out = []
    for x in nodes:
        known = x.up is not None and not (x.up.first or x.up.last)
        up = x.up.node if x.up is not None and not known else None
        out.append((part, still_open, x.node, up, x.least, x.depth, x.up.least if known else None, x.n, x.kids, x.leaves, x.saved, x.ends, x.length, x.first, x.last))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)


def _from_rows(table: pa.Table) -> list[list[Turns]]:
    """The open nodes of each part, in order, parents first."""
    parts: dict[int, dict[bytes, Turns]] = {}
    for r in table.sort_by([("part", "ascending"), ("depth", "ascending")]).to_pylist():
        by = parts.setdefault(r["part"], {})
        x = by[r["node"]] = Turns(r["depth"], by[r["up"]] if r["up"] is not None else None, r["length"])
        x.node, x.n, x.least, x.ends = r["node"], r["n_convs"], r["conv_id"], r["ends_sha256"]
        x.kids, x.leaves, x.saved, x.first, x.last = r["n_children"], r["n_leaves"], r["saved_tokens"], r["first"], r["last"]
    return [list(by.values()) for by in parts.values()]


def _tree_task(batches: Iterator[pa.RecordBatch], block_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, least, piece, part) in order: runs of equal keys become one string with the digest of
    its joined pieces; blocks of strings become trees."""
    block, size, spine, key, digest, part = [], 0, None, None, None, 0
    out: list[tuple] = []

    def close_run() -> None:
        nonlocal size
        block.append((key, (n, least, digest.hexdigest())))
        size += len(key)

    def close_block() -> None:
        nonlocal spine, size
        final, held = block_nodes(block)
        out.extend(_rows(final, part, False))
        if spine is None:
            spine = held
        else:
            final, spine = merge([spine, held])
            out.extend(_rows(final, part, False))
        block.clear()
        size = 0

    for batch in batches:
        columns = [batch.column(c) for c in ("key", "n", "least", "piece", "part")]
        for k in range(batch.num_rows):
            this, some, low, piece, part = (c[k].as_py() for c in columns)
            if this == key:
                n += some
                least = min(least, low)
                digest.update(b"," + piece.encode())
                continue
            if key is not None:
                close_run()
                if len(block) >= block_keys or size >= BLOCK_BYTES:
                    close_block()
            key, n, least, digest = this, some, low, hashlib.sha256(piece.encode())
        while len(out) >= 10_000:
            yield _batch(out[:10_000])
            del out[:10_000]
    if key is not None:
        close_run()
        close_block()
        out.extend(_rows(spine, part, True))
    for k in range(0, len(out), 10_000):
        yield _batch(out[k : k + 10_000])


def _run_pieces(batches: Iterator[pa.RecordBatch], piece_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order: each run of equal keys as joined ids, in pieces of bounded length."""
    schema = pa.schema([("key", pa.binary()), ("at", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("piece", pa.string())])
    out, key, ids, chars = [], None, [], 0

    def told() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        keys, convs = batch.column("key"), batch.column("conv_id").to_pylist()
        for k, conv in enumerate(convs):
            this = keys[k].as_py()
            if key is not None and (this != key or chars >= piece_chars):
                out.append((key, ids[0], len(ids), ids[0], ",".join(map(str, ids))))
                ids, chars = [], 0
                if len(out) >= 2_000:
                    yield told()
            key = this
            ids.append(conv)
            chars += 12
        if out and sum(len(x[4]) + len(x[0]) for x in out) > 4 << 20:
            yield told()
    if ids:
        out.append((key, ids[0], len(ids), ids[0], ",".join(map(str, ids))))
    if out:
        yield told()


def _merge_task(at_end: bool, fan_in: int):
    def join_parts(table: pa.Table) -> pa.Table:
        done, held = merge(_from_rows(table), at_end)
        part = table["part"][0].as_py() // fan_in
        return pa.Table.from_batches([_batch([*_rows(done, part, False), *_rows(held, part, True)])])

    return join_parts


# --- Spark --------------------------------------------------------------------


def turn_id(role: Column, text: Column) -> Column:
    """A turn's id in hexadecimal digits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.lpad(F.hex(F.length(text)), 8, "0"), F.substring(whole, 1, 2 * (ID_BYTES - 4)))


def conversation_keys(turns: DataFrame) -> DataFrame:
    """conv_id and key, the byte string of a conversation's turn ids in order."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), turn_id(F.col("role"), F.col("text")).alias("id"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return told.select("conv_id", F.unhex(F.array_join(F.col("all.id"), "")).alias("key"))


def shared_starts(keys: DataFrame, every: int = BASE_EVERY, most: int = BASE_TURNS) -> DataFrame:
    """``keys`` with the first h turns of each conversation replaced by those of conversation
    conv_id - conv_id % ``every``; h is the CRC of the decimal conv_id, mod ``most``."""
    bases = keys.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("of"), F.expr(f"substring(key, 1, {ID_BYTES * (most - 1)})").alias("start"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)) * ID_BYTES
    joined = keys.join(bases, F.col("conv_id") - F.col("conv_id") % every == F.col("of"), "left").withColumn("h", h.cast("int"))
    start = F.expr("coalesce(substring(start, 1, h), X'')")
    return joined.select("conv_id", F.concat(start, F.expr("substring(key, h + 1)")).alias("key"))


def prefix_nodes(keys: DataFrame, parts: int | None = None, block_keys: int = BLOCK_KEYS, piece_chars: int = PIECE_CHARS, fan_in: int = FAN_IN) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 of each. ``keys`` has distinct conv_ids."""
    spark = keys.sparkSession
    parts = min(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTS)
    keys = stage_table(keys, "trie-keys")
    dealt = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = stage_table(dealt.mapInArrow(lambda batches: _run_pieces(batches, piece_chars), "key binary, at bigint, n bigint, least bigint, piece string"), "trie-runs")
    strings = pieces.repartitionByRange(parts, "key").sortWithinPartitions("key", "at").select("key", "n", "least", "piece", F.spark_partition_id().cast("long").alias("part"))
    level = stage_table(strings.mapInArrow(lambda batches: _tree_task(batches, block_keys), _ROW), "trie-blocks")
    final, left = level.where("NOT open"), MAX_PARTS
    while True:
        left = -(-left // fan_in)
        at_end = left == 1

        group = F.floor(F.col("part") / fan_in).alias("group_")
        level = stage_table(level.where("open").groupBy(group).applyInArrow(_merge_task(at_end, fan_in), _ROW), "trie-level")
        final = final.unionByName(level.where("NOT open"))
        if at_end:
            break
    # nodes that were open once, two paths a task at most: they tell their children's parent
    were = small_side(stage_table(final.where("node IS NOT NULL").select(F.col("node").alias("up_"), F.col("conv_id").alias("of_")), "trie-open"))
    return final.join(were, F.col("up") == F.col("up_"), "left").select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "of_").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations with shared starts."""
    return prefix_nodes(shared_starts(conversation_keys(turns)))
