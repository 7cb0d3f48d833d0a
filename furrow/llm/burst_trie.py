"""Prefix trie of conversations as a burst trie.

A turn's id is a hash of its role and text with the text's length behind it, a conversation is the string
of its turns' ids. Equal conversations of a run of ids are one entry with a packed list of its members.
Entries start in one container under the root. A container that is too large bursts: the turns that all
its entries share become a chain of head nodes, entries that end there end in the head, the others go to
new containers by their next turn id. This is done for all oversized containers at once, one aggregation
(size, smallest and largest entry) per round, until none is left. Rounds follow the number of
branchings under large containers and not the number of turns, as shared turns are passed at once.

The containers that remain are shards: each is sorted and swept once, its nodes end where neighbours in
the order part. Heads get their figures from the containers below, by aggregations that combine on the
map side, so neither a frequent first turn nor a conversation with millions of copies is ever in one
task as single rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from furrow.sources.stages import stage

#: Bytes of a turn in an entry: hash of role and text, then the length of the text in UTF-8.
HASH, WIDTH = 16, 20
#: Bytes of entries in a container; beyond, it bursts.
BURST_BYTES = 1 << 20
#: Conversations of 2^BLOCK_BITS groups of GROUP following ids are rebuilt by one task, in order of id.
BLOCK_BITS, GROUP = 6, 5
#: Members packed into one entry at most.
PACKED_MEMBERS = 1 << 16
#: A conversation takes at most LONGEST_HEAD - 1 turns from the first of its group.
LONGEST_HEAD = 9

ENTRIES = "path binary, block long, n long, first long, members binary"
NODES = ("path binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string, top boolean")
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- conversations -------------------------------------------------------------------------------

def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id) of every turn; null roles and texts are empty. Rows without conv_id are left out."""
    c = conversations
    role, text = (F.coalesce(c[x].cast("string"), F.lit("")) for x in ("role", "text"))
    # The role's length before it keeps ("a", "bc") and ("ab", "c") apart.
    key = F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text)), 2 * (WIDTH - HASH), "0"))
    return c.where(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
        F.concat(F.unhex(F.md5(key)), size).alias("id"))


def block_of(conv_id: Column) -> Column:
    """Groups of GROUP following ids stay together, and blocks follow the order of ids."""
    return F.shiftright(F.floor((conv_id - F.pmod(conv_id, F.lit(GROUP))) / GROUP), BLOCK_BITS)


def taken(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its group."""
    return zlib.crc32(b"%d" % conv_id) % LONGEST_HEAD


def rebuilt(turns: DataFrame) -> DataFrame:
    """Entries (path, block, n, first, members) of the rebuilt conversations of (conv_id, turn, id).

    A conversation is rebuilt from the first `taken` turns of the first conversation of its group and its
    own turns after as many. Turns of the same number are ordered by id. One conversation's turns
    (20 bytes each) are held at once.
    """
    rows = turns.withColumn("block", block_of(F.col("conv_id")))
    ordered = rows.repartition("block").sortWithinPartitions("block", "conv_id", F.col("turn").asc_nulls_first(), "id")
    return ordered.select("block", "conv_id", "id").mapInArrow(_rebuilt, ENTRIES)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, own in groupby(_turns(batches), key=lambda row: row[0]):
        entries: dict[bytes, list[int]] = {}
        size = 0
        base, shared = None, b""
        for conv_id, turns in groupby(own, key=lambda row: row[1]):
            path = b"".join(row[2] for row in turns)
            if base != conv_id - conv_id % GROUP:
                base = conv_id - conv_id % GROUP
                shared = path[:WIDTH * LONGEST_HEAD] if conv_id == base else b""
            head = WIDTH * taken(conv_id)
            path = shared[:head] + path[head:]
            entries.setdefault(path, []).append(conv_id)
            size += len(path) + 16
            if size > 4 * BURST_BYTES or len(entries[path]) >= PACKED_MEMBERS:
                yield _entries(block, entries)
                entries, size = {}, 0
        if entries:
            yield _entries(block, entries)


def _entries(block: int, entries: dict[bytes, list[int]]) -> pa.RecordBatch:
    paths, members = list(entries), list(entries.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.binary()), pa.array([block] * len(paths), pa.int64()),
         pa.array([len(m) for m in members], pa.int64()), pa.array([m[0] for m in members], pa.int64()),
         pa.array([zlib.compress(np.diff(np.array(m, np.int64), prepend=0).tobytes(), 1) for m in members],
                  pa.binary())], names=["path", "block", "n", "first", "members"])


def _members(packed: bytes) -> list[int]:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64)).tolist()


# --- bursting ------------------------------------------------------------------------------------

def _cut(path: Column, turns: Column) -> Column:
    return F.substring(path, F.lit(1), (turns * WIDTH).cast("int"))


def _common(a: bytes, b: bytes) -> int:
    """Bytes of whole turns that two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle * WIDTH] == b[:middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low * WIDTH


#: Turns that two paths begin with alike; of the smallest and the largest path it is that of all.
_shared_turns = F.udf(lambda a, b: _common(bytes(a), bytes(b)) // WIDTH, IntegerType())


def burst(entries: DataFrame, burst_bytes: int = BURST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(placed, heads): entries with their container, and the heads that containers burst into.

    Placed entries have `container` (turns that name it), `cuts` (turns of each head above, from the
    root down) and `ends` (the entry ends in the last head). Heads (path, low, high, cuts) are chains of
    nodes of `low` to `high` turns along `path`; `cuts` are those of the heads above.
    """
    left = entries.select("*", F.lit(0).alias("container"), F.array().cast("array<int>").alias("cuts"))
    placed, heads = [], []
    while True:
        left = left.withColumn("key", _cut(F.col("path"), F.col("container")))
        large = (left.groupBy("key", "container")
                 .agg(F.sum(F.octet_length("path") + 32).alias("size"), F.min("path").alias("low_path"),
                      F.max("path").alias("high_path"), F.first("cuts").alias("above"))
                 .where(F.col("size") > burst_bytes)
                 .select("key", "container", "low_path", "above",
                         _shared_turns("low_path", "high_path").alias("high")))
        large = stage(large, "burst")
        if large.isEmpty():
            placed.append(left.drop("key").withColumn("ends", F.lit(False)))
            break
        heads.append(large.select(_cut(F.col("low_path"), F.col("high")).alias("path"), F.col("container").alias("low"),
                                  "high", F.col("above").alias("cuts")))
        met = stage(left.join(large.select("key", "container", "high"), ["key", "container"], "left").drop("key"), "entries")
        ends = F.octet_length("path") == F.col("high") * WIDTH
        placed.append(met.where("high is null").drop("high").withColumn("ends", F.lit(False)))
        inner = met.where("high is not null").withColumn("cuts", F.concat("cuts", F.array("high")))
        placed.append(inner.where(ends).drop("high").withColumn("ends", F.lit(True)))
        left = inner.where(~ends).withColumn("container", F.col("high") + 1).drop("high")
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    none = entries.sparkSession.createDataFrame([], "path binary, low int, high int, cuts array<int>")
    for part in heads:
        none = none.unionByName(part)
    return out, none


# --- sweeping containers -------------------------------------------------------------------------

SWEPT = NODES + ", cuts array<int>, in_head boolean"


def swept(placed: DataFrame) -> DataFrame:
    """The nodes of every container. The top node of a container has `top`, no parent yet, and `cuts`;
    entries that end in a head are one row per head with `in_head`, their number, first and digest."""
    ordered = (placed.withColumn("key", F.when(F.col("ends"), F.col("path")).otherwise(_cut(F.col("path"), F.col("container"))))
               .repartition("key").sortWithinPartitions("key", "ends", "path", "block", "first")
               .select("key", "ends", "path", "n", "first", "members", "cuts"))
    return ordered.mapInArrow(_swept, SWEPT)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                yield from zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns))

    out: list[tuple] = []
    for (key, ends), own in groupby(rows(), key=lambda row: row[:2]):
        found = _ended(key, own) if ends else _container(key, own)
        for node in found:
            out.append(node)
            if len(out) >= 4096:
                yield _node_batch(out)
                out = []
    if out:
        yield _node_batch(out)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), *[pa.int64()] * 7, pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.bool_()]
    names = [part.split()[0] for part in SWEPT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class _Ends:
    """Digest over members that come in ascending order, without holding them."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def add(self, members: list[int]) -> None:
        text = ",".join(map(str, members))
        self.hash.update((f",{text}" if self.some else text).encode())
        self.some = True


def _ended(path: bytes, own: Iterator[tuple]) -> Iterator[tuple]:
    ends, n, first, cuts = _Ends(), 0, None, None
    for _, _, _, count, least, members, cuts in own:
        ends.add(_members(members))
        n, first = n + count, least if first is None else min(first, least)
    yield (path, len(path) // WIDTH, first, None, n, 0, 0, 0, ends.hash.hexdigest(), False, cuts, True)


class _Node:
    __slots__ = ("turns", "n", "first", "children", "leaves", "saved", "ends", "rows")

    def __init__(self, turns: int):
        self.turns, self.n, self.first = turns, 0, None
        self.children = self.leaves = self.saved = 0
        self.ends: _Ends | None = None
        self.rows: list[list] = []  # nodes below, that wait for their parents


def _container(key: bytes, own: Iterator[tuple]) -> Iterator[tuple]:
    """Sweeps one container's sorted entries; a node is done when an entry parts above it.

    The nodes of a container wait for their parents' smallest members, which is why it has a bound.
    """
    low = len(key) // WIDTH
    stack: list[_Node] = [_Node(low)]
    done: list[list] = []
    path, cuts = key, None

    def close() -> None:
        node = stack.pop()
        size = int.from_bytes(path[node.turns * WIDTH - 4:node.turns * WIDTH], "big") if node.turns else 0
        node.saved += (node.n - 1) * size
        node.leaves += node.children == 0
        for row in node.rows:
            row[3] = node.first
        mine = [path[:node.turns * WIDTH] if not stack else None, node.turns, node.first, None, node.n, node.children,
                node.leaves, node.saved, node.ends.hash.hexdigest() if node.ends else NO_ENDS, not stack, None, False]
        done.append(mine)
        if stack:
            up = stack[-1]
            up.n, up.children = up.n + node.n, up.children + 1
            up.first = node.first if up.first is None else min(up.first, node.first)
            up.leaves, up.saved = up.leaves + node.leaves, up.saved + node.saved
            up.rows.append(mine)

    for _, _, entry, count, least, members, cuts in own:
        shared = max(low, _common(path, entry) // WIDTH)
        while stack[-1].turns > shared:
            close()
        path = entry
        for turns in range(stack[-1].turns + 1, len(entry) // WIDTH + 1):
            stack.append(_Node(turns))
        top = stack[-1]
        top.ends = top.ends or _Ends()
        top.ends.add(_members(members))
        top.n += count
        top.first = least if top.first is None else min(top.first, least)
    while stack:
        close()
    done[-1][10] = cuts
    yield from map(tuple, done)


# --- heads ---------------------------------------------------------------------------------------

def nodes(conversations: DataFrame, burst_bytes: int = BURST_BYTES) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see `trie`."""
    return trie(rebuilt(turn_ids(conversations)), burst_bytes)


def trie(entries: DataFrame, burst_bytes: int = BURST_BYTES) -> DataFrame:
    """All nodes of the trie of entries (path, block, n, first, members).

    Each sequence of the first turns of a conversation is a node, the root the empty one; members are the
    conversations that start with it, also those without turns. Null roles and texts are empty ones,
    null turns come first, turns of one number are ordered by the hash of role and text, repeated rows
    are turns of their own. Rows without conv_id belong to no conversation and are left out. No
    conversations give no nodes. Further columns are left out.
    """
    placed, heads = burst(stage(entries, "entries"), burst_bytes)
    found = stage(swept(placed), "swept")
    heads = stage(heads, "heads")
    final = found.where("not in_head and not top").drop("path", "cuts", "in_head", "top")
    tops = found.where("top or in_head").withColumn("root", F.size("cuts") == 0)
    result = final.unionByName(tops.where("root").select(final.columns))
    if not heads.isEmpty():
        result = result.unionByName(_head_nodes(tops.where("not root"), heads).select(final.columns))
    return result.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         "ends_sha256")


def _last(cuts: str) -> Column:
    return F.element_at(cuts, -1)


def _above(rows: DataFrame, path: str) -> DataFrame:
    """One row per head above each row: `head` its path, `direct` if it is the next one up."""
    return (rows.withColumn("cut", F.explode("cuts")).withColumn("direct", F.col("cut") == _last("cuts"))
            .withColumn("head", _cut(F.col(path), F.col("cut"))))


def _turn_bytes(path: bytes, low: int, high: int) -> np.ndarray:
    """Bytes of the texts of a path's turns low + 1 to high."""
    turns = np.frombuffer(path, np.uint8)[low * WIDTH:high * WIDTH].reshape(-1, WIDTH)
    return np.ascontiguousarray(turns[:, HASH:]).view(">u4").ravel().astype(np.int64)


def _chain_bytes(path: bytes, low: int, high: int) -> int:
    return int(_turn_bytes(bytes(path), max(0, low - 1), high).sum())


_bytes_of_chain = F.udf(_chain_bytes, LongType())
CHAIN = ("path binary, low int, high int, first long, parent_first long, n long, children long, leaves long, "
         "saved long, ends string")
CHAIN_NODES = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
               "saved_tokens long, ends_sha256 string")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of heads; `saved` is what lies below the deepest node of each."""
    names = [part.split()[0] for part in CHAIN_NODES.split(", ")]
    for batch in batches:
        for path, low, high, first, parent, n, children, leaves, saved, ends in zip(*(c.to_pylist() for c in batch.columns)):
            own = _turn_bytes(path, max(0, low - 1), high) * (n - 1)
            own = np.concatenate([np.zeros(int(low == 0), np.int64), own])  # the root has no text
            count = high - low + 1
            rest = np.full(count - 1, first, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(low, high + 1)), pa.array([first] * count, pa.int64()),
                 pa.array([parent, *rest.tolist()], pa.int64()), pa.array([n] * count, pa.int64()),
                 pa.array([1] * (count - 1) + [children], pa.int64()), pa.array([leaves] * count, pa.int64()),
                 pa.array(saved + np.cumsum(own[::-1])[::-1]), pa.array([NO_ENDS] * (count - 1) + [ends])], names=names)


def _head_nodes(tops: DataFrame, heads: DataFrame) -> DataFrame:
    """The heads' nodes, and the containers' top nodes with their parents."""
    zero = F.lit(0).cast("long")
    up = _above(tops, "path").groupBy("head").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("first"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.sum(F.when(F.col("direct") & ~F.col("in_head"), 1).otherwise(0)).alias("children"),
        F.max(F.when(F.col("direct") & F.col("in_head"), F.col("ends_sha256"))).alias("ends"))
    own = (F.col("n") - 1) * _bytes_of_chain("path", "low", "high")
    known = stage(heads.join(up, heads["path"] == up["head"]).drop("head").withColumn("own", own), "head_sums")
    # Heads without containers below are leaves or have heads only.
    below = _above(known.where(F.size("cuts") > 0), "path").groupBy("head").agg(
        F.sum("own").alias("lower_saved"), F.sum(F.when(F.col("direct"), 1).otherwise(0)).alias("more_children"))
    known = known.join(below, known["path"] == below["head"], "left").drop("head")
    known = stage(known.withColumn("children", F.col("children") + F.coalesce("more_children", zero))
                  .withColumn("saved", F.col("saved") + F.coalesce("lower_saved", zero)).drop("more_children", "lower_saved"),
                  "head_children")
    leaves = _above(known.where((F.col("children") == 0) & (F.size("cuts") > 0)), "path").groupBy("head").agg(
        F.count(F.lit(1)).alias("lower_leaves"))
    firsts = known.select(F.col("path").alias("parent"), F.col("first").alias("parent_first"))
    parent = F.when(F.size("cuts") > 0, _cut(F.col("path"), _last("cuts"))).alias("parent")
    whole = (known.join(leaves, known["path"] == leaves["head"], "left").withColumn("parent", parent)
             .join(firsts, "parent", "left")
             .withColumn("leaves", F.col("leaves") + F.coalesce("lower_leaves", zero) + F.when(F.col("children") == 0, 1).otherwise(0))
             .withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))))
    chains = whole.select(*(part.split()[0] for part in CHAIN.split(", "))).mapInArrow(_chains, CHAIN_NODES)
    under = (tops.where("top").withColumn("parent", parent).join(firsts, "parent", "left")
             .select("depth", "conv_id", F.col("parent_first").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                     "saved_tokens", "ends_sha256"))
    return chains.unionByName(under)
