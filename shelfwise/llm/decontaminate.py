"""Benchmark decontamination: size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles, each a 64-bit hash. Items are
partitioned by size, in powers of two. An item's sketch is its k least hashes,
with k chosen per partition so that the sketch of any item in it must share a
hash with a document that holds 0.8 of the item: more than the 0.2 that may
be missing. Documents stay whole, however long: each of their shingles is looked
up in the sketches. Candidates are then verified by exact containment.

Words are runs of letters and digits, lower-cased.

Defined results: a null text has no words; items under five words have no
shingle and are found nowhere; items with equal sets are searched once and
reported each; repeated documents are reported once; a null doc_id or item_id
is a value like any other; with an empty table on either side nothing is found.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import row_key, stored

SHINGLE, THRESHOLD = 5, 0.8
NOT_WORD = "[^\\p{L}\\p{N}]+"
BROADCAST_ROWS = 1 << 20  # of hashes, 16 bytes each


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """The distinct hashes of all runs of ``n`` words; none for a null or shorter text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")

    def runs(w):
        at = F.sequence(F.lit(0), F.size(w) - n)
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))

    hashes = F.element_at(F.transform(F.array(words), runs), 1)  # the words are split once
    return F.array_distinct(F.coalesce(hashes, F.array().cast("array<bigint>")))


def item_sets(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct set (``item_key, n, hashes``) and which items have it (``item_key, item_id``)."""
    sets = items.select("item_id", F.array_sort(shingles(F.col("text"))).alias("hashes")).where(F.size("hashes") > 0)
    keyed = stored(sets.withColumn("item_key", F.xxhash64("hashes")), "items")
    return (
        keyed.groupBy("item_key").agg(F.first("hashes").alias("hashes")).withColumn("n", F.size("hashes")),
        keyed.select("item_key", "item_id").distinct(),
    )


def sketches(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The k least hashes of each set: ``item_key, hash``, k by the largest size of the partition."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1).cast("int") - 1
    k = largest - F.ceil(largest * threshold - 1e-9).cast("int") + 1
    return sets.select("item_key", F.explode(F.slice("hashes", F.lit(1), F.least(k, F.col("n")))).alias("hash"))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item of which it holds ``threshold`` of the shingles or more.

    ``key`` tells documents apart that repeat an id.
    """
    sets, members = item_sets(items)
    index = _bounded(stored(sketches(sets, threshold), "sketches"))
    wanted = F.ceil(F.col("n") * threshold - 1e-9)
    looked_up = docs.select(row_key().alias("key"), F.explode(shingles(F.col("text"))).alias("hash"))
    candidates = stored(looked_up.join(index, "hash").select("key", "item_key").distinct(), "candidates")
    those = docs.select(row_key().alias("key"), "doc_id", "text").join(
        candidates.select("key").distinct(), "key", "left_semi"
    ).dropDuplicates(["key"])
    parts = those.select("key", "doc_id", F.explode(shingles(F.col("text"))).alias("hash"))
    bodies = _bounded(stored(sets.select("item_key", "n", F.explode("hashes").alias("hash")), "item-hashes"))
    shared = (
        parts.join(bodies, "hash").join(candidates, ["key", "item_key"])
        .groupBy("key", "doc_id", "item_key", "n").agg(F.count(F.lit(1)).alias("n_shared"))
        .where(F.col("n_shared") >= wanted)
    )
    return shared.join(members, "item_key").select(
        "key", "doc_id", "item_id", "n_shared", F.col("n").cast("bigint").alias("n_item"),
        (F.col("n_shared") / F.col("n")).alias("containment"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), row_key().alias("key"))
    found = stored(contaminated(docs, items, threshold).select("key").distinct(), "contaminated")
    return rows.join(found, "key", "left_anti").select("row.*")
