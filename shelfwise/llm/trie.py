"""The prefix trie of all conversations, with what sharing its prefixes would save.

A turn is a code of fixed width, the MD5 of role and text and the text's bytes; a
conversation is its codes laid end to end. Equal conversations are combined, and
the rest is dealt by ranges of the codes and sorted, so a first turn that a third of
all conversations open with spreads over many tasks. A shard is a bounded run of
that order. Its trie is a sequence of balanced parentheses: ``findclose`` over range
minima of blocks delimits every subtree, the rank of leaf pairs counts its leaves,
and cumulative arrays give its members and savings.

Only nodes on a shard's first or last path, its spines, can go on in another shard.
All others are final. Spines, with what hangs off them summed up, are the rows of
the next round, which merges those that shards share, until one shard holds them.

Defined results: a null role or text is empty; rows without a conv_id belong to no
conversation; turns with equal numbers stand in the order of role, then of text;
repeated rows are turns of their own; an empty table gives no rows. A conversation's
codes, 24 bytes a turn, are held in memory as a whole.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored
from shelfwise.operators.filters import bounded_broadcast

WIDTH = 24  # bytes of a turn's code
SHARD_TURNS = 1 << 18  # codes that a task holds at once
LEAST_ROWS = 4  # of a shard, which leaves two rows for the next round
CHUNK_BITS = 12  # conversations are listed in chunks of ids that agree but for these bits
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()
SUMS = ("n", "children", "leaves", "saved")

NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, key binary, parent_key binary"
)
SPINE = "path binary, first array<bigint>, ends array<string>, " + ", ".join(f"{c} array<bigint>" for c in SUMS)
BOTH = f"node struct<{NODE.replace(' bigint', ': bigint').replace(' string', ': string').replace(' binary', ': binary')}>, {SPINE}"


# --- conversations as sequences of codes ---


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, tie, code``; ``tie`` has the text where another turn of the same number differs."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text)
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    code = F.concat(F.md5(told), F.lpad(F.hex(size.cast("bigint")), 16, "0"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"), code.alias("code")
    )
    tied = rows.groupBy("conv_id", "turn").agg(F.min("code").alias("a"), F.max("code").alias("b")).where("a <> b")
    tied = stored(tied.select("conv_id", "turn", F.lit(True).alias("tied")), "trie-tied")
    if tied.isEmpty():
        return rows.select("conv_id", "turn", "role", F.lit(None).cast("string").alias("tie"), "code")
    a, b = rows.alias("a"), tied.alias("b")
    same = (F.col("a.conv_id") == F.col("b.conv_id")) & F.col("a.turn").eqNullSafe(F.col("b.turn"))
    return a.join(b, same, "left").select("a.conv_id", "a.turn", "role", F.when(F.col("tied"), F.col("text")).alias("tie"), "code")


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``conv_id, path``: the first h turns of the conversation ``conv_id - conv_id % every``, then its own after h.

    h is the CRC-32 of the id, modulo ``most``. Only codes are shuffled, once: both conversations are in one group.
    """
    donor = F.col("conv_id") - F.col("conv_id") % every
    turns = F.struct("conv_id", "turn", "role", "tie", "code")
    held = ordered_turns(conversations).groupBy(donor.alias("donor")).agg(F.sort_array(F.collect_list(turns)).alias("turns"))
    ids = F.array_distinct(F.transform("turns", lambda t: t["conv_id"]))

    def codes(conv: Column) -> Column:
        return F.transform(F.filter("turns", lambda t: t["conv_id"] == conv), lambda t: t["code"])

    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    each = held.select("donor", "turns", F.explode(ids).alias("conv_id")).select(
        "conv_id", h.alias("h"), codes(F.col("donor")).alias("given"), codes(F.col("conv_id")).alias("own")
    )
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = F.concat(F.slice("given", F.lit(1), F.col("h")), rest)
    return each.select("conv_id", F.unhex(F.array_join(whole, "")).alias("path"))


# --- balanced parentheses ---


class Parentheses:
    """A tree as open (1) and closed (0) parentheses, with the least excess of every block and of ranges of blocks."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = -(-len(bits) // self.BLOCK)
        self.leaves = 1 << max(blocks - 1, 0).bit_length()
        padded = np.full(blocks * self.BLOCK, NONE)
        padded[: len(bits)] = self.excess
        self.least = np.full(2 * self.leaves, NONE)
        self.least[self.leaves : self.leaves + blocks] = padded.reshape(-1, self.BLOCK).min(axis=1)
        for node in range(self.leaves.bit_length() - 1, 0, -1):  # a level of the tree of ranges at a time
            low, high = 1 << (node - 1), 1 << node
            self.least[low:high] = self.least[2 * low : 2 * high].reshape(-1, 2).min(axis=1)

    def _scan(self, at: np.ndarray, target: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on, before ``stop``, where the excess is ``target``; ``stop`` if there is none."""
        found, going, at = stop.copy(), np.arange(len(at)), at.copy()
        while len(going):
            going = going[at[going] < stop[going]]
            hit = self.excess[at[going]] == target[going]
            found[going[hit]] = at[going[hit]]
            going = going[~hit]
            at[going] += 1
        return found

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Where the parentheses at ``opens`` are closed."""
        n, target = len(self.bits), self.excess[opens] - 1
        stop = np.minimum((opens // self.BLOCK + 1) * self.BLOCK, n)
        close = self._scan(opens + 1, target, stop)
        far = np.flatnonzero((close == stop) & ((stop == n) | (self.excess[np.minimum(stop, n - 1)] != target)))
        far = far[close[far] < n]
        goal = target[far]
        node = self.leaves + close[far] // self.BLOCK
        while (up := self.least[node] > goal).any():
            node = np.where(up, np.where(node & 1, (node + 1) >> 1, node + 1), node)
        while (down := node < self.leaves).any():
            left = 2 * np.minimum(node, self.leaves - 1)
            node = np.where(down, np.where(self.least[left] > goal, left + 1, left), node)
        begin = (node - self.leaves) * self.BLOCK
        close[far] = self._scan(begin, goal, np.minimum(begin + self.BLOCK, n))
        return close

    def opened(self, places: np.ndarray) -> np.ndarray:
        """Open parentheses before each place."""
        return np.concatenate(([0], np.cumsum(self.bits)))[places]

    def leaf_pairs(self) -> np.ndarray:
        """For every open parenthesis, in order, whether it is closed at once."""
        opens = np.flatnonzero(self.bits)
        return ~self.bits[opens + 1].astype(bool)


# --- shards ---


@dataclass
class Rows:
    """Sorted paths, and what each adds at its depths: ``at[i]`` the depth of the first of ``values[i]``."""

    paths: list[bytes]
    at: list[int]
    values: list[dict]  # n, first, children, leaves, saved: lists of numbers; ends: list of digests or None


def prefix_keys(path: bytes) -> list[bytes]:
    """A name for the node of each depth of a path."""
    state, out = hashlib.md5(), []
    for k in range(0, len(path) + 1, WIDTH):
        out.append(state.copy().digest())
        state.update(path[k : k + WIDTH])
    return out


def common_turns(flat: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Turns that each path shares with the one before it; -1 for the first."""
    shared = np.minimum(sizes[1:], sizes[:-1])
    pair = np.repeat(np.arange(len(shared)), shared)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(shared) - shared, shared)
    unlike = np.flatnonzero((flat[begin[:-1][pair] + nth] != flat[begin[1:][pair] + nth]).any(axis=1))
    np.minimum.at(shared, pair[unlike], nth[unlike])
    return np.concatenate(([-1], shared))


def solve(rows: Rows, last: bool, named: bool):
    """The nodes of a shard that are final, as columns, and its spines, as rows.

    ``last`` says that no other shard exists; ``named`` that the nodes were spines, and get their keys.
    """
    sizes = np.array([len(p) // WIDTH for p in rows.paths], np.int64)
    begin = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(rows.paths), ">u8").reshape(-1, 3).astype(np.uint64)
    common = common_turns(flat, sizes, begin)
    made = sizes - common
    start = np.cumsum(made) - made
    total = int(made.sum())
    number = np.arange(total)
    depth = np.repeat(common + 1 - start, made) + number
    turn = np.repeat(begin + common - start, made) + number
    text_bytes = np.where(depth > 0, flat[np.maximum(turn, 0), 2].astype(np.int64), 0) if len(flat) else np.zeros(total, np.int64)

    # contributions, and each first new node's parent, along the path of the moment
    parent, here = number - 1, np.zeros(int(sizes.max()) + 1, np.int64)
    sums = {c: np.zeros(total, np.int64) for c in SUMS}
    first, ends, keys = np.full(total, NONE), [None] * total, [None] * total
    opened = np.zeros(total, bool)
    of_last = np.zeros(0, np.int64)
    for i, (size, shared, new) in enumerate(zip(sizes.tolist(), common.tolist(), start.tolist())):
        if size > shared:
            if shared >= 0:
                parent[new] = here[shared]
            here[shared + 1 : size + 1] = np.arange(new, new + size - shared)
        own, at, values = here[: size + 1], rows.at[i], rows.values[i]
        nodes = own[at:]
        for c in SUMS:
            if c in values:
                sums[c][nodes] += values[c]
        first[nodes] = np.minimum(first[nodes], values["first"])
        for node, digest in zip(nodes.tolist(), values["ends"]):
            ends[node] = digest or ends[node]
        if named or (not last and i in (0, len(sizes) - 1)):
            for node, key in zip(own.tolist(), prefix_keys(rows.paths[i])):
                keys[node] = key
        if not last and i in (0, len(sizes) - 1):
            opened[own] = True
        of_last = own if i == len(sizes) - 1 else of_last

    # the parentheses: back up to what a path shares, then down its new nodes
    back = np.concatenate(([0], sizes[:-1] - common[1:]))
    counts = np.append(np.stack((back, made), axis=1).ravel(), sizes[-1] + 1)
    kinds = np.append(np.tile([0, 1], len(sizes)), 0)
    tree = Parentheses(np.repeat(kinds, counts).astype(np.int8))
    close = tree.findclose(np.flatnonzero(tree.bits))
    end = tree.opened(close)

    def below(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(values)))
        return upto[end] - upto[:-1]

    final = ~opened
    members = below(sums["n"])
    by_depth = np.argsort(depth, kind="stable")
    by_depth = by_depth[final[by_depth] & (parent[by_depth] >= 0)]
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[::-1]:
        np.minimum.at(first, parent[level], first[level])
    children = sums["children"] + np.bincount(parent[1:], minlength=total)
    leaves = below(sums["leaves"] + (tree.leaf_pairs() & (sums["children"] == 0)))
    saved = below(sums["saved"] + np.where(final, (members - 1) * text_bytes, 0))

    known = final & (parent >= 0)
    known &= final[np.maximum(parent, 0)]
    done = np.flatnonzero(final).tolist()
    columns = {
        "conv_id": first[final], "depth": depth[final],
        "parent_conv_id": pa.array(first[np.maximum(parent, 0)][final], mask=~known[final]),
        "n_convs": members[final], "n_children": children[final], "n_leaves": leaves[final], "saved_tokens": saved[final],
        "ends_sha256": pa.array([ends[k] or NO_ENDS for k in done], pa.string()),
        "key": pa.array([keys[k] if named else None for k in done], pa.binary()),
        "parent_key": pa.array([keys[parent[k]] if parent[k] >= 0 and not final[parent[k]] else None for k in done], pa.binary()),
    }
    if last:
        return columns, []
    hanging = np.flatnonzero(final & (parent >= 0) & opened[np.maximum(parent, 0)])
    for c, gained in zip(SUMS, (members, np.ones(total, np.int64), leaves, saved)):
        np.add.at(sums[c], parent[hanging], gained[hanging])

    def spine(path: bytes, nodes: np.ndarray, skip: int) -> dict:
        """A path's row; what its first ``skip`` nodes have is on the other spine's row."""
        row = {c: np.where(np.arange(len(nodes)) < skip, 0, sums[c][nodes]).tolist() for c in SUMS}
        row["first"] = np.where(np.arange(len(nodes)) < skip, NONE, first[nodes]).tolist()
        row["ends"] = [None if k < skip else ends[node] for k, node in enumerate(nodes.tolist())]
        return row | {"path": path}

    of_first = np.arange(int(sizes[0]) + 1)
    spines = [spine(rows.paths[0], of_first, 0)]
    if len(rows.paths) > 1:
        skip = int((of_last[: len(of_first)] == of_first[: len(of_last)]).sum())
        spines.append(spine(rows.paths[-1], of_last, skip))
    return columns, spines


def batches_of(columns: dict, spines: list[dict]) -> Iterator[pa.RecordBatch]:
    names = [c.split(": ")[0] for c in BOTH.split("<", 1)[1].split(">", 1)[0].split(", ")]
    parts = [v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in (columns[n] for n in names)]
    node = pa.StructArray.from_arrays(parts, names)
    many = pa.list_(pa.int64())
    kinds = {"path": pa.binary(), "first": many, "ends": pa.list_(pa.string())} | {c: many for c in SUMS}
    yield pa.RecordBatch.from_arrays([node, *[pa.nulls(len(node), t) for t in kinds.values()]], ["node", *kinds])
    if spines:
        held = [pa.array([s[c] for s in spines], t) for c, t in kinds.items()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(spines), node.type), *held], ["node", *kinds])


def shards(items: Iterator[tuple[bytes, int, dict]], most: int, last: bool, named: bool) -> Iterator[pa.RecordBatch]:
    """Items (path, depth of its first value, values) in order, a bounded run at a time."""
    rows, turns = Rows([], [], []), 0
    for path, at, values in items:
        if not last and turns >= most and len(rows.paths) >= LEAST_ROWS:
            yield from batches_of(*solve(rows, last, named))
            rows, turns = Rows([], [], []), 0
        rows.paths.append(path)
        rows.at.append(at)
        rows.values.append(values)
        turns += len(path) // WIDTH + 1
    if rows.paths:
        yield from batches_of(*solve(rows, last, named))


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, dict]]:
    """Equal conversations, told by chunks of their ids in order, as one item each."""
    path = None
    for batch in batches:
        for now, n, first, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if now != path:
                if path is not None:
                    yield path, len(path) // WIDTH, {"n": [count], "first": [least], "ends": [digest.hexdigest()]}
                path, count, least, digest = now, n, first, hashlib.sha256(ids.encode())
            else:
                count += n
                digest.update(b"," + ids.encode())
    if path is not None:
        yield path, len(path) // WIDTH, {"n": [count], "first": [least], "ends": [digest.hexdigest()]}


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node of the trie of ``sequences`` (``conv_id``, ``path`` of codes): its members and what its subtree has.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    chunks = sequences.groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), ids.alias("ids")
    )
    chunks = stored(chunks, "trie-chunks")
    dealt = chunks.repartitionByRange("path").sortWithinPartitions("path", "chunk").select("path", "n", "first", "ids")
    out = stored(dealt.mapInArrow(lambda b: shards(listed(b), shard_turns, False, False), BOTH), "trie-nodes")
    found = [out.where("node IS NOT NULL").select("node.*")]

    def spines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, dict]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row.pop("path"), 0, row

    before = None
    while True:
        rows = out.where("node IS NULL").drop("node")
        n, turns = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("n")), F.lit(0))).first()
        last = turns <= shard_turns or n <= 2 * LEAST_ROWS or n == before
        parts, before = min(-(-turns // shard_turns), n // (2 * LEAST_ROWS)), n
        near = rows.coalesce(1) if last else rows.repartitionByRange(parts, "path")
        merged = near.sortWithinPartitions("path").mapInArrow(
            lambda b, last=last: shards(spines(b), shard_turns, last, True), BOTH
        )
        out = stored(merged, "trie-spines")
        found.append(out.where("node IS NOT NULL").select("node.*"))
        if last:
            break
    nodes, named = found[0], found[1]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    for more in found[2:]:
        named = named.unionByName(more)
    names = named.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    open_ = nodes.where("parent_key IS NOT NULL").join(bounded_broadcast(names, names.count()), "parent_key")
    columns = [c.split()[0] for c in NODE.split(", ")[:8]]
    return nodes.where("parent_key IS NULL").select(columns).unionByName(
        open_.withColumn("parent_conv_id", F.col("_parent")).select(columns)
    )
