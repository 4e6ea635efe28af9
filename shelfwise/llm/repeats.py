"""Where fixed-length windows repeat in a corpus: the search that both substring operators share.

A window's anchor is its run of ``gram`` elements with the least hash, the first
of equals. Equal windows have equal anchors at equal places, so windows are only
compared under a common anchor. Neighbouring windows mostly share an anchor: a
piece is all windows of one anchor in one place, one row for many windows.

1. Pieces go out as hashes. Anchors that occur once anywhere are dropped.
2. Equal pieces are combined before they are shuffled; a passage that a third of
   all documents copy is one row per task.
3. Only an anchor with different pieces needs the text: one copy of each of its
   pieces is fetched and given to the operator's own method, sorted by anchor.
4. An anchor with more than ``most`` different pieces is split by window instead,
   as hashes, so no task holds more than ``most`` pieces of an anchor.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import (
    WORD_BASE, WORD_INVERSE, Sums, byte_sums, groups_by_bytes, row_key, sliding_argmin, small_batches, stored, word_bounds,
)

FILTER_BITS = 24  # of the bit map that spares texts a shuffle: 2 MB, whatever the input


@dataclass(frozen=True)
class Windows:
    """``length`` elements to a window, ``gram`` to an anchor; elements are words or bytes."""

    length: int
    gram: int
    words: bool
    most: int


def elements(texts: list[bytes], words: bool):
    """Hash sums over the elements of all texts, each element's text, and where elements start and end in the bytes."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    sums = byte_sums(data)
    if not words:
        at = np.arange(len(data))
        return sums, np.repeat(np.arange(len(texts)), sizes + 1), at, at + 1, data
    starts, stops = word_bounds(data)
    return Sums(sums(starts, stops), WORD_BASE, WORD_INVERSE), np.searchsorted(ends, starts, side="right"), starts, stops, data


def pieces_of(texts: list[bytes], spec: Windows):
    """Per piece: its text's index, the first window's place in it, the windows less one, anchor and piece hash."""
    sums, doc, _, _, _ = elements(texts, spec.words)
    n, length = len(doc), spec.length
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    at = np.arange(n - spec.gram + 1)
    grams = sums(at, at + spec.gram)
    anchor = sliding_argmin(grams, length - spec.gram + 1)
    last = length if spec.words else length + 1  # a text's bytes are followed by one that is not its own
    whole = np.zeros(len(anchor) + 1, bool)
    stop = np.minimum(np.arange(len(anchor)) + last - 1, n - 1)
    whole[:-1] = doc[: len(anchor)] == doc[stop]
    if not spec.words:
        whole[len(anchor) - 1] = False
    new = whole[:-1].copy()
    new[1:] &= ~whole[:-2] | (anchor[1:] != anchor[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1])
    final = whole[:-1] & (~whole[1:] | np.append(new[1:], True))
    begin, end = np.flatnonzero(new), np.flatnonzero(final)
    offset = np.searchsorted(doc, np.arange(len(texts)))
    piece = sums(begin, end + length)
    return doc[begin], begin - offset[doc[begin]], end - begin, grams[anchor[begin]].view(np.int64), piece.view(np.int64)


def one_each(docs: DataFrame) -> DataFrame:
    """``key, doc_id, text`` (bytes) without repeated rows; texts are only shuffled where there are any."""
    slim = docs.where("text IS NOT NULL").select(
        row_key().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    repeated = slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return slim if repeated.isEmpty() else slim.dropDuplicates(["key"])


def all_pieces(one: DataFrame, spec: Windows) -> DataFrame:

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for part in groups_by_bytes([len(t) for t in texts]):
                doc, at, more, anchor, piece = pieces_of(texts[part], spec)
                rows = pa.array(doc + part.start)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(rows), ids.take(rows), pa.array(at), pa.array(more), pa.array(anchor), pa.array(piece)],
                    ["key", "doc_id", "at", "more", "anchor", "piece"],
                )

    return one.mapInArrow(emit, "key bigint, doc_id bigint, at bigint, more bigint, anchor bigint, piece bigint")


def key_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that all of ``keys`` pass and few others, from a bit map of fixed size.

    It only spares rows a shuffle; where the map fills up, it spares fewer.
    """
    words = (
        keys.selectExpr(f"(key & {(1 << FILTER_BITS) - 1}) >> 6 AS word", "shiftleft(1L, CAST(key & 63 AS INT)) AS bit")
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    sent = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def passes(key):
        place = key.to_numpy() & ((1 << FILTER_BITS) - 1)
        return type(key)(((sent.value[place >> 6] >> (place & 63)) & 1).astype(bool))

    return passes


def fetched(one: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts that ``wanted`` (``key``, ``pieces``) asks for, joined to it."""
    return one.where(key_filter(wanted)(F.col("key"))).join(wanted, "key")


def piece_texts(texts: DataFrame, spec: Windows) -> DataFrame:
    """Every wanted piece with its bytes: words joined by single spaces, or bytes as they are."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc_id, text, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                held = text.split() if spec.words else text
                for w in wanted:
                    part = held[w["at"] : w["at"] + w["more"] + spec.length]
                    rows.append((w["anchor"], doc_id, key, w["at"], w["more"], w["n"], b" ".join(part) if spec.words else part))
            for part in groups_by_bytes([len(r[6]) + 50 for r in rows], 4 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows[part]), [pa.int64()] * 6 + [pa.binary()]
                )], ["anchor", "doc_id", "key", "at", "more", "n", "text"])

    return texts.select("key", "doc_id", "text", "pieces").mapInArrow(
        emit, "anchor bigint, doc_id bigint, key bigint, at bigint, more bigint, n bigint, text binary"
    )


def window_hashes(texts: DataFrame, spec: Windows) -> DataFrame:
    """Every window of the wanted pieces as a hash: ``anchor, window, doc_id, key, at, n``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                sums = elements([text], spec.words)[0]
                for w in wanted:
                    at = np.arange(w["at"], w["at"] + w["more"] + 1)
                    same = lambda v: pa.array([v] * len(at), pa.int64())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([
                        same(w["anchor"]), pa.array(sums(at, at + spec.length).view(np.int64)), same(doc_id), same(key),
                        pa.array(at), same(w["n"]),
                    ], ["anchor", "window", "doc_id", "key", "at", "n"])

    return texts.select("key", "doc_id", "text", "pieces").mapInArrow(
        emit, "anchor bigint, window bigint, doc_id bigint, key bigint, at bigint, n bigint"
    )


def repeated_spans(docs: DataFrame, spec: Windows, compare, name: str, keep_first: bool) -> DataFrame:
    """Per document with any: ``key`` and ``spans``, structs of first and past-the-last element of repeated windows.

    ``keep_first`` leaves the earliest of equal windows out. ``compare`` turns an
    iterator of batches of different pieces, sorted by anchor and then by place,
    into batches of ``key, start, end``.
    """
    with small_batches(docs.sparkSession):
        return _repeated_spans(docs, spec, compare, name, keep_first)


def _repeated_spans(docs: DataFrame, spec: Windows, compare, name: str, keep_first: bool) -> DataFrame:
    one = one_each(docs)
    occurring = all_pieces(one, spec)
    if not spec.words:  # a row per some hundred bytes: cheaper to keep than to compute again
        occurring = stored(occurring, f"{name}-pieces")
    often = occurring.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    often = stored(often, f"{name}-often")  # apart from the join, whose hot anchors can then be split
    shared = stored(occurring.join(often, "anchor", "left_semi"), f"{name}-shared")

    first = F.min(F.struct("doc_id", "key", "at", "more")).alias("first")
    different = stored(shared.groupBy("anchor", "piece").agg(first, F.count(F.lit(1)).alias("n")), f"{name}-different")
    met = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    wanted = (
        different.join(met, "anchor").select(F.col("first.key").alias("key"), "met", "anchor", "first.at", "first.more", "n")
        .groupBy("key", (F.col("met") > spec.most).alias("hot")).agg(F.collect_list(F.struct("anchor", "at", "more", "n")).alias("pieces"))
    )
    wanted = stored(wanted, f"{name}-wanted")

    cold = piece_texts(fetched(one, wanted.where("NOT hot").drop("hot")), spec)
    sorted_pieces = cold.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "key", "at")
    with small_batches(docs.sparkSession, 4096):
        found = [stored(sorted_pieces.mapInArrow(compare, "key bigint, start bigint, end bigint"), f"{name}-compared")]
    if not wanted.where("hot").isEmpty():
        windows = stored(window_hashes(fetched(one, wanted.where("hot").drop("hot")), spec), f"{name}-windows")
        place = F.struct("doc_id", "key", "at")
        groups = windows.groupBy("anchor", "window").agg(F.min(place).alias("first"), F.sum("n").alias("times")).where("times > 1")
        both = windows.join(groups, ["anchor", "window"])
        hit = both.where(place != F.col("first")) if keep_first else both
        found.append(hit.select("key", F.col("at").alias("start"), (F.col("at") + spec.length).alias("end")))

    copies = different.where("n > 1").select("anchor", "piece", "first")
    pairs = shared.join(copies, ["anchor", "piece"])
    if keep_first:
        pairs = pairs.where((F.col("key") != F.col("first.key")) | (F.col("at") != F.col("first.at")))
    found.append(pairs.select("key", F.col("at").alias("start"), (F.col("at") + F.col("more") + spec.length).alias("end")))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return stored(spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), f"{name}-spans")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text`` (bytes) and ``spans``, null for none; texts without spans are not shuffled."""
    rows = docs.select(row_key().alias("key"), F.col("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = rows.withColumn("marked", key_filter(spans.select("key"))(F.col("key")))
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    alone = marked.where("NOT marked").select("doc_id", "text", none.alias("spans"))
    return alone.unionByName(marked.where("marked").join(spans, "key", "left").select("doc_id", "text", "spans"))


def merged(spans, n: int) -> list[tuple[int, int]]:
    """Sorted spans that neither overlap nor touch."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], min(s["end"], n)) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]
