"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that lie within ``radius`` 3 agree in at least three of six bit
ranges, so each distinct fingerprint is filed under the 20 choices of three
ranges; a large file is filed again by its other bits. Within a file, distances are not taken pair by pair: the 64 bit planes
of all fingerprints of a batch stand vertically, 64 fingerprints to a machine
word, each is compared with the one ``s`` places on for s = 1, 2, ... at once,
differing bits are added up in carry-save counters, and a block of words is
abandoned when every lane in it has passed the radius.

Links go out as a forest: per file, one link for each join of two groups. Links
of all files give the components, found on Spark tables alone.

Defined results: a null text has no words; no words give fingerprint zero, which
links like any other; repeated rows share a fingerprint; a null doc_id is linked
but names no component, unless all of a component are null, whose id is null;
an empty table gives no rows.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import row_key, small_batches, stored
from shelfwise.llm.graph import components

SEED, SHINGLE, RADIUS = 42, 3, 3
RANGES = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
SHARED = 3  # of the six ranges, three at most hold a difference
BLOCK_WORDS = 64  # words of 64 lanes that are abandoned together
LARGE_FILE = 1 << 11  # rows from which a file is filed again by its other bits
TILE_ROWS = 1 << 16  # rows of files that a task holds as bit planes


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority, bit by bit, of the XXH64 of all word shingles; ties are 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1
    )
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 4096)):
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``doc_id``, the row key, a hash of the text, and its fingerprint ``fp`` as a signed number."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pd.Series(found.view(np.int64))

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select(
        "doc_id", row_key().alias("key"), F.xxhash64("text").alias("hash"), F.pandas_udf(of, "long")("text").alias("fp")
    )


def filed(fps: DataFrame) -> DataFrame:
    """Each fingerprint under its 20 keys: the bits of three ranges, and which three."""
    keys = []
    for n, chosen in enumerate(combinations(RANGES, SHARED)):
        mask = sum(((1 << high) - 1) ^ ((1 << low) - 1) for low, high in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.choice", "key.bits", "fp")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b has bit b of every value, 64 values to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the pairs ``left[i], right[i]`` differ in ``radius`` bits or fewer (3 at most).

    Two counter planes hold 0 to 3 differences per lane and a third the lanes
    that are past it; adding a plane is a carry-save step on whole words.
    """
    out = np.zeros(len(left), bool)
    a, b = planes(left), planes(right)
    for at in range(0, a.shape[1], BLOCK_WORDS):
        x, y = a[:, at : at + BLOCK_WORDS], b[:, at : at + BLOCK_WORDS]
        low, high, past = (np.zeros(x.shape[1], "<u8") for _ in range(3))
        for bit in range(64):
            differs = x[bit] ^ y[bit]
            carry = low & differs
            low ^= differs
            past |= high & carry
            high ^= carry
            if bit % 8 == 7 and (past == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                break
        good = ~past
        for count in range(radius + 1, 4):
            good &= ~((low if count & 1 else ~low) & (high if count & 2 else ~high))
        lanes = np.unpackbits(good.view(np.uint8), bitorder="little").astype(bool)
        span = out[at * 64 : (at + BLOCK_WORDS) * 64]
        span[:] = lanes[: len(span)]
    return out


class Forest:
    """Union-find that says whether a link joined two groups."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.above.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.above[p] = x
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def _linked(file: np.ndarray, fps: np.ndarray, radius: int):
    """Index pairs of rows of the same file that are linked, step by step; rows of a file stand together."""
    at, step = np.arange(len(fps)), 1
    while True:
        at = at[at + step < len(fps)]
        at = at[file[at] == file[at + step]]
        if not len(at):
            return
        near = at[within(fps[at], fps[at + step], radius)]
        yield near, near + step
        step += 1


def _within_file(fps: np.ndarray, free: list[int], radius: int, at: np.ndarray):
    """Index pairs of one large file. Its rows differ in the bits ``free`` only.

    Of ``radius`` + 1 parts of these bits two linked rows share one, so rows are
    filed again by each part, and so on while files are large.
    """
    if len(at) <= LARGE_FILE or len(free) < 4 * (radius + 1):
        for a, b in _linked(np.zeros(len(at), np.int8), fps[at], radius):
            yield at[a], at[b]
        return
    for part in np.array_split(np.array(free), radius + 1):
        mask = np.bitwise_or.reduce(np.uint64(1) << part.astype(np.uint64))
        own = fps[at] & mask
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        rest = [b for b in free if b not in set(part.tolist())]
        for group in np.split(order, cuts):
            if len(group) > 1:
                yield from _within_file(fps, rest, radius, at[group])


def _free_bits(choice: int) -> list[int]:
    taken = list(combinations(RANGES, SHARED))[choice]
    return [b for low, high in RANGES if (low, high) not in taken for b in range(low, high)]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links between distinct fingerprints, enough to connect all that are linked."""
    assert 0 <= radius <= 3
    spark = fps.sparkSession

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, chosen = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        last, number = None, 0

        def pairs_of(file, held, chosen):
            _, starts, sizes = np.unique(file, return_index=True, return_counts=True)
            large = sizes > LARGE_FILE
            for start, size in zip(starts[large].tolist(), sizes[large].tolist()):
                yield from _within_file(held, _free_bits(int(chosen[start])), radius, np.arange(start, start + size))
            rest = np.flatnonzero(~np.repeat(large, sizes))
            for a, b in _linked(file[rest], held[rest], radius):
                yield rest[a], rest[b]

        def found(file, held, chosen):
            forest, ends = Forest(), held.view(np.int64)
            kept = [
                pair for a, b in pairs_of(file, held, chosen) for pair in zip(a.tolist(), b.tolist()) if forest.join(*pair)
            ]
            pairs = np.array(kept, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[pairs[:, 0]]), pa.array(ends[pairs[:, 1]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            choice = batch.column(0).to_numpy(zero_copy_only=False)
            bits = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])
            new[0] = last != (choice[0], bits[0])
            numbers = number + np.cumsum(new)
            last, number = (choice[-1], bits[-1]), int(numbers[-1])
            file, held, chosen = np.concatenate((file, numbers)), np.concatenate((held, fp)), np.concatenate((chosen, choice))
            if len(held) >= TILE_ROWS:  # the last file may go on in the next batch
                end = np.searchsorted(file, number)
                if end:
                    yield found(file[:end], held[:end], chosen[:end])
                    file, held, chosen = file[end:], held[end:], chosen[end:]
        if len(held):
            yield found(file, held, chosen)

    files = filed(fps).repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    return files.mapInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and per fingerprint its least doc_id and the root of its component."""
    with small_batches(docs.sparkSession):
        rows = stored(fingerprints(docs, shingle), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    with small_batches(docs.sparkSession, 16384):
        edges = stored(links(nodes.select("fp"), radius), "simhash-links")
    roots = components(edges)
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    return rows, labelled


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` in hexadecimal and ``component_id``."""
    rows, labelled = grouped(docs, shingle, radius)
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, one_per_id: bool = True) -> DataFrame:
    """``docs`` with one row of each component: the least by doc_id, nulls last, then by a hash of the text.

    Components are told apart by their fingerprints, so rows without an id lose nothing to each other. Where components
    have first rows of the same id, all of these stay with ``one_per_id=False``, else the one with the least hash.
    """
    rows, labelled = grouped(docs, shingle, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash", "key", "n")).alias("first")
    of_print = rows.groupBy("fp", "doc_id", "hash", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").agg(first)
    chosen = labelled.join(of_print, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    if one_per_id:
        apart = F.when(F.col("doc_id").isNull(), F.col("key")).alias("apart")
        chosen = chosen.groupBy("doc_id", apart).agg(F.min(F.struct("hash", "key", "n")).alias("first")).select("first.*")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key().alias("key"))
    joined = row.join(chosen.select("key", "n"), "key")
    single = joined.where("n = 1").select("row.*")
    repeated = joined.where("n > 1").dropDuplicates(["key"]).select("row.*")
    return single.unionByName(repeated)
