"""Suffix-array dedup: maximal repeats from the common-prefix interval tree.

A byte is removed where a 400-byte string that also starts elsewhere covers it.
Pieces that share an anchor (``repeats``) are laid end to end and get an enhanced
suffix array: suffixes sorted by doubling, and the common prefix of neighbours.
A stack scan over the common prefixes yields the tree's intervals. An interval
whose suffixes are preceded by different bytes is a maximal repeat, given with
all its places, not just neighbours; one whose suffixes are all preceded by the
same byte lies within a longer repeat.

Defined results: a null text is empty; repeated rows are one document and get
equal rows; a null doc_id is a value like any other; an empty table gives no
rows. Where a cut splits a character the digest is of the bytes that stay.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import small_batches, stored
from shelfwise.llm.repeats import (
    Windows, all_pieces, fetched, merged, one_each, piece_texts, repeated_spans, window_hashes, with_spans,
)

LENGTH = 400
BYTES = Windows(length=LENGTH, gram=32, words=False, most=2000)
SHARD_BYTES = 1 << 18  # pieces that are sorted together; the pieces of an anchor always are


PACKED = 4  # elements of nine bits in the first rank
MOST_ELEMENTS = (1 << 21) - 1  # rank, rank and place share a 64-bit number, which sorts faster than places


def _group_starts(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, where the run of equals that each is in starts."""
    at = np.arange(len(keys))
    at[1:][keys[1:] == keys[:-1]] = 0
    return np.maximum.accumulate(at)


def enhanced_suffix_array(codes: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before it, exact up to ``most`` elements.

    Ranks by the first 4 elements (0 to 256) are doubled until they tell
    ``most``; the ranks of every length give the common prefixes. A suffix that
    is alone before ``least`` elements are told shares fewer and is left out.
    """
    n = len(codes)
    assert n <= MOST_ELEMENTS, n
    bits = np.uint64(n.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    padded = np.concatenate((codes.astype(np.uint64), np.zeros(PACKED, np.uint64)))
    keys = np.zeros(n, np.uint64)
    for i in range(PACKED):
        keys = (keys << np.uint64(9)) | padded[i : i + n]
    packed = np.sort((keys << bits) | np.arange(n, dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    group = _group_starts(packed >> bits)
    rank = np.empty(n, np.int64)
    rank[order] = group
    ranks, size = [rank.astype(np.int32)], PACKED
    while True:
        if size <= least and len(group):
            alone = np.ones(len(group), bool)
            alone[1:] &= group[1:] != group[:-1]
            alone[:-1] &= group[1:] != group[:-1]
            order, group = order[~alone], group[~alone]
        if size >= most:
            break
        after = order + size
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        packed = np.sort((group.astype(np.uint64) << (bits + bits)) | (second.astype(np.uint64) << bits) | order.astype(np.uint64))
        order, both = (packed & mask).astype(np.int64), packed >> bits
        old = both >> bits
        group = old.astype(np.int64) + _group_starts(both) - _group_starts(old)
        rank[order] = group
        ranks.append(rank.astype(np.int32))
        size *= 2
    if not len(order):
        return order, order
    a, b = order[1:], order[:-1]
    common = np.zeros(len(a), np.int64)
    for k, level in reversed(list(enumerate(ranks))):
        x, y = a + common, b + common
        inside = np.flatnonzero((x < n) & (y < n))
        common[inside[level[x[inside]] == level[y[inside]]]] += PACKED << k
    going = np.arange(len(a))
    for _ in range(PACKED - 1):
        x, y = a[going] + common[going], b[going] + common[going]
        inside = (x < n) & (y < n)
        going, x, y = going[inside], x[inside], y[inside]
        going = going[codes[x] == codes[y]]
        common[going] += 1
    return order, np.concatenate(([0], common))


def maximal_repeats(order, common, left, least: int):
    """``(length, suffix slice)`` of every interval of ``least`` or more whose left bytes differ.

    ``left`` is the byte before each suffix in order, negative and unlike any other
    where a piece starts. Stretches whose left bytes are all the same hold no
    such interval and are passed over before the scan.
    """
    high = common >= least
    begins = np.flatnonzero(high & ~np.concatenate(([False], high[:-1]))) - 1
    ends = np.flatnonzero(high & ~np.concatenate((high[1:], [False]))) + 1
    for begin, end in zip(begins.tolist(), ends.tolist()):
        lefts = left[begin:end]
        if (lefts == lefts[0]).all():
            continue
        change = np.concatenate(([0], np.cumsum(lefts[1:] != lefts[:-1])))  # equal at two ends: one byte between
        stack: list[tuple[int, int]] = []
        prefixes = common[begin:end].tolist()
        for i in range(1, end - begin + 1):
            length = prefixes[i] if i < end - begin else 0
            start = i - 1
            while stack and stack[-1][0] > length:
                held, start = stack.pop()
                if change[start] != change[i - 1]:
                    yield held, begin + start, begin + i
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, start))


def repeats_in(pieces: list[bytes], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeat groups of some texts: the length, and all places as text and offset."""
    starts = np.cumsum([0] + [len(p) + 1 for p in pieces])
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    codes = data.astype(np.int64) + 1
    codes[starts[1:] - 1] = 0  # ends of pieces, unlike any byte
    owner = np.repeat(np.arange(len(pieces)), np.diff(starts))
    stop = starts[1:][owner] - 1
    order, common = enhanced_suffix_array(codes, least, max(map(len, pieces)) + 1)
    room = (stop - np.arange(len(data)))[order]
    common = np.minimum(common, np.minimum(room, np.concatenate(([0], room[:-1]))))
    left = np.where(order == starts[owner[order]], -1 - order, data[order - 1].astype(np.int64))
    for length, begin, end in maximal_repeats(order, common, left, least):
        at = order[begin:end]
        yield length, list(zip(owner[at].tolist(), (at - starts[owner[at]]).tolist()))


def _spans(pieces: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """Per text the spans that repeats cover, with few overlaps."""
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for length, places in repeats_in(pieces, least):
        for piece, at in places:
            out[piece].append((at, at + length))
    return out


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of bytes that repeat among the pieces of an anchor; whole anchors are sorted, several together."""
    held, size, anchor = [], 0, None

    def flushed():
        spans = _spans([row[2] for row in held], LENGTH)
        found = [
            (key, at + s["start"], at + s["end"]) for (key, at, text), own in zip(held, spans)
            for s in ({"start": a, "end": b} for a, b in merged([{"start": a, "end": b} for a, b in own], len(text)))
        ]
        columns = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "start", "end"])

    for batch in batches:
        for a, _, key, at, _, _, text in zip(*[c.to_pylist() for c in batch.columns]):
            if a != anchor and size >= SHARD_BYTES:
                yield flushed()
                held, size = [], 0
            anchor = a
            held.append((key, at, text))
            size += len(text)
    if held:
        yield flushed()


def repeated_bytes(docs: DataFrame, spec: Windows = BYTES) -> DataFrame:
    """Per document with any: ``key`` and the spans of bytes that other places repeat."""
    return repeated_spans(docs, spec, compare, "suffixes", keep_first=False)


def dedup_suffixes(docs: DataFrame, spec: Windows = BYTES) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans``, the bytes that stay and their SHA-256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
                text = text or b""
                gone, kept, at = merged(spans, len(text)), [], 0
                for start, end in gone:
                    kept.append(text[at:start])
                    at = end
                stays = b"".join([*kept, text[at:]])
                rows.append((doc_id, len(text), len(text) - len(stays), len(gone), hashlib.sha256(stays).hexdigest(), stays))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = with_spans(docs, repeated_bytes(docs, spec)).selectExpr("CAST(doc_id AS BIGINT) doc_id", "text", "spans")
    return rows.mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )


def _groups_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats among the pieces of an anchor: a row per group and different piece that holds it.

    A piece that stands more than once is laid in twice, so that it repeats itself.
    """
    held, size, anchor = [], 0, None
    names = ["anchor", "key", "at", "group", "length", "offset"]

    def flushed():
        owners = [i for i, row in enumerate(held) for _ in range(min(row[3], 2))]
        found = []
        for length, places in repeats_in([held[i][4] for i in owners], LENGTH):
            own = sorted({(owners[p], at) for p, at in places})
            for i, at in own:
                a, key, start, _, _ = held[i]
                first = held[own[0][0]]
                name = hashlib.blake2b(repr((a, length, first[1], first[2], own[0][1])).encode(), digest_size=8).digest()
                found.append((a, key, start, int.from_bytes(name, "big", signed=True), length, at))
        columns = zip(*found) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    for batch in batches:
        for a, _, key, at, _, n, text in zip(*[c.to_pylist() for c in batch.columns]):
            if a != anchor and size >= SHARD_BYTES:
                yield flushed()
                held, size = [], 0
            anchor = a
            held.append((a, key, at, n, text))
            size += len(text)
    if held:
        yield flushed()


def repeat_groups(docs: DataFrame, spec: Windows = BYTES) -> DataFrame:
    """Repeated strings with all the places where they stand: ``group, length, doc_id, key, at``, a row per place.

    The groups are the maximal repeats of each shard, copies expanded to every
    place. A longer repeat is given in the parts that its anchors cut it into.
    An anchor with more than ``spec.most`` different pieces gives its repeated
    windows as groups. The places of all groups cover exactly what
    ``dedup_suffixes`` removes; repeated rows count as one document.
    """
    with small_batches(docs.sparkSession):
        return _repeat_groups(docs, spec)


def _repeat_groups(docs: DataFrame, spec: Windows) -> DataFrame:
    one = one_each(docs)
    occurring = stored(all_pieces(one, spec), "groups-pieces")
    counts = occurring.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = stored(occurring.join(counts, "anchor").drop("times"), "groups-shared")
    first = F.min(F.struct("doc_id", "key", "at", "more")).alias("first")
    different = stored(shared.groupBy("anchor", "piece").agg(first, F.count(F.lit(1)).alias("n")), "groups-different")
    met = stored(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("met")), "groups-met")
    pieces = F.collect_list(F.struct("anchor", "at", "more", "n")).alias("pieces")
    cold = different.join(met.where(F.col("met") <= spec.most), "anchor").select("anchor", "piece", "first.*", "n")
    texts = piece_texts(fetched(one, stored(cold.groupBy("key").agg(pieces), "groups-wanted")), spec)
    by_anchor = texts.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "key", "at")
    with small_batches(docs.sparkSession, 4096):
        found = stored(by_anchor.mapInArrow(
            _groups_in, "anchor bigint, key bigint, at bigint, group bigint, length bigint, offset bigint"
        ), "groups-found")
    held = found.join(cold.select("anchor", "key", "at", "piece"), ["anchor", "key", "at"]).select(
        "anchor", "piece", "group", "length", "offset"
    )
    places = shared.join(held, ["anchor", "piece"]).select(
        "group", "length", "doc_id", "key", (F.col("at") + F.col("offset")).alias("at")
    )
    hot = met.where(F.col("met") > spec.most)
    if hot.isEmpty():
        return places
    every = shared.join(hot, "anchor").withColumn("n", F.lit(1).cast("bigint"))
    windows = stored(window_hashes(fetched(one, stored(every.groupBy("key").agg(pieces), "groups-hot")), spec), "groups-windows")
    often = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    more = windows.join(often, ["anchor", "window"]).select(
        F.xxhash64("anchor", "window").alias("group"), F.lit(spec.length).cast("bigint").alias("length"), "doc_id", "key", "at"
    )
    return places.unionByName(more)
