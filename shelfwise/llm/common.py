"""Helpers that the operators share: stored tables, row keys, text batches."""

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import new_path

SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"  # what the contracts call a word, unless they say otherwise
PIECE_BYTES = 1 << 20  # text that a task turns into arrays at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage.

    A retried task rereads the files, so nothing that was decided can change.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """What runs inside hands long texts to Python ``rows`` at a time; the session's own setting comes back after.

    A frame takes the setting when it runs, so only what is written inside is
    meant. Elsewhere a batch is bounded by its bytes, 64 MB unless the session says otherwise.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One number for a document: equal for repeated rows, which count as one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def groups_by_bytes(sizes, most: int = PIECE_BYTES):
    """Slices of consecutive texts that together have about ``most`` bytes; a longer text is alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield slice(start, len(sizes))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_BASE, BYTE_INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
WORD_BASE, WORD_INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)


class Sums:
    """Hashes of any stretch of a sequence of 64-bit numbers, from its prefix sums.

    Equal stretches have equal hashes wherever they stand.
    """

    def __init__(self, values: np.ndarray, base: int, inverse: int):
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.total[1:])
        self.back = powers(inverse, len(values) + 1)

    def __call__(self, start, end) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start] + _ODD * (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of bytes that are not spaces starts and ends."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


_SPREAD = mixed(np.arange(1, 257, dtype=np.uint64))


def byte_sums(data: np.ndarray) -> Sums:
    return Sums(_SPREAD[data], BYTE_BASE, BYTE_INVERSE)


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` numbers, the index of its least one, the first of equals."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[: len(at) - step])
        have += step
    return at
