"""Exact nearest neighbours that leave out clusters of items which cannot hold one.

Items are stored by the centre whose direction is nearest to theirs, with the
widest angle to it and the shortest and longest vector of each cluster. An item's
angle to a query is at least the centre's less that width, which bounds its
inner product. A query first meets the clusters around it; where the last of its
best items there is better than another cluster's bound, that cluster is neither
read nor scored for it. How much this spares hangs on the vectors: where they
fall into directions, most; where they have none, nothing, and all is scored.
"""

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.operators.knn import nearest
from shelfwise.session import checkpointed

# The code travels with the tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CENTRES = 64  # the centres, and a few numbers of each, go to every task
SAMPLE_ROWS = 8192  # vectors that the centres are fitted to, at most; every item is then laid by them
ROUNDS = 8
FIRST_TIMES = 4  # a query's first clusters hold this many times the items it fetches
SLACK = 1e-6  # of a bound, for rounding: relative to the lengths of the vectors


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1.0)


@dataclass
class Clusters:
    """Items with their ``cluster``, and per cluster its centre, items, widest angle, shortest and longest vector."""

    items: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    widths: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray

    def bounds(self, vectors: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per query and cluster, the centre's angle, and what no item's similarity exceeds."""
        if not len(self.centres):  # no items
            return np.zeros((len(vectors), 0)), np.zeros((len(vectors), 0))
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        angle = np.arccos(np.clip(_unit(vectors) @ self.centres.T, -1.0, 1.0))
        most = np.cos(np.maximum(angle - self.widths, 0.0))
        if cosine:
            return angle, np.maximum(most, 0.0) + SLACK  # a vector of length 0 has similarity 0
        return angle, lengths * (np.where(most > 0, self.longest, self.shortest) * most + SLACK * self.longest)


def fit_centres(items: DataFrame, centres: int = CENTRES, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Directions for items to be laid by, from at most ``sample`` vectors, chosen by a hash of the id."""
    few = items.where("embedding is not null").select("embedding", F.xxhash64("item_id").alias("h")).orderBy("h").limit(sample)
    rows = [r.embedding for r in few.select(F.col("embedding").cast("array<double>").alias("embedding")).collect()]
    if not rows:
        return np.zeros((0, 0))
    units = _unit(np.array(rows))
    found = units[:: max(1, -(-len(units) // centres))][:centres].copy()
    for _ in range(ROUNDS):
        of = np.argmax(units @ found.T, axis=1)
        for c in range(len(found)):
            if (of == c).any():
                found[c] = units[of == c].sum(axis=0)
        found = _unit(found)
    return found


def _laid(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """The items with ``cluster``, and the angle to its centre and the vector's length; null without a vector."""
    extra_fields = (("cluster", T.IntegerType()), ("_angle", T.DoubleType()), ("_length", T.DoubleType()))
    schema = T.StructType([*items.schema.fields, *[T.StructField(*f) for f in extra_fields]])
    names = to_arrow_schema(schema).names

    def lay(batches):
        for batch in batches:
            vectors = batch.column("embedding")
            valid = vectors.is_valid().to_numpy(zero_copy_only=False)
            n = int(valid.sum())
            rows = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype("float64")
            found = np.zeros((3, batch.num_rows))
            if n:
                rows = rows.reshape(n, -1)
                units = rows / np.where((lengths := np.linalg.norm(rows, axis=1, keepdims=True)) > 0, lengths, 1.0)
                likeness = units @ centres.T
                of = np.argmax(likeness, axis=1)
                # a vector of length 0 has no direction, and none that a width could leave out
                angle = np.where(lengths[:, 0] > 0, np.arccos(np.clip(likeness[np.arange(n), of], -1.0, 1.0)), np.pi)
                found[:, valid] = of, angle, lengths[:, 0]
            extra = [pa.array(v.astype(t), mask=~valid) for v, t in zip(found, ("int32", "float64", "float64"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return items.mapInArrow(lay, schema)


def build_clusters(items: DataFrame, path: str, centres: int = CENTRES, sample: int = SAMPLE_ROWS) -> Clusters:
    """Write ``items`` (``item_id``, ``embedding`` and any more) to ``path`` by cluster, and measure the clusters.

    Rows are rebalanced by cluster, so a cluster that holds a third of them is
    written by several tasks, and a small one to one file.
    """
    spark = items.sparkSession
    found = fit_centres(items, centres, sample)
    laid = _laid(items, found)
    laid.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(path)
    order = [f for f in laid.schema.fields if f.name != "cluster"] + [laid.schema["cluster"]]
    stored = spark.read.schema(T.StructType(order)).parquet(path)
    measured = stored.where("cluster is not null").groupBy("cluster").agg(
        F.count(F.lit(1)), F.max("_angle"), F.min("_length"), F.max("_length")
    )
    stats = np.zeros((4, len(found)))
    for row in measured.collect():  # a row a centre
        stats[:, row[0]] = row[1:]
    return Clusters(stored.drop("_angle", "_length"), found, *stats)


def _with_clusters(clusters: Clusters, queries: DataFrame, cosine: bool, floor: bool) -> DataFrame:
    """``queries`` with ``clusters``: the ones around each, or, from its ``floor``, all that can reach it."""

    @F.pandas_udf("array<int>")
    def around(vector: pd.Series, fetch: pd.Series) -> pd.Series:
        angle, _ = clusters.bounds(np.array(vector.tolist(), dtype=float), cosine)
        order = np.argsort(angle, axis=1)
        before = np.cumsum(clusters.sizes[order], axis=1) - clusters.sizes[order]
        return pd.Series([o[b < FIRST_TIMES * f].tolist() for o, b, f in zip(order, before, fetch)])

    @F.pandas_udf("array<int>")
    def reaching(vector: pd.Series, least: pd.Series) -> pd.Series:
        _, most = clusters.bounds(np.array(vector.tolist(), dtype=float), cosine)
        return pd.Series([np.flatnonzero(m >= f).tolist() for m, f in zip(most, least.fillna(-np.inf))])

    clusters = Clusters(None, clusters.centres, clusters.sizes, clusters.widths, clusters.shortest, clusters.longest)
    found = reaching("vector", "floor") if floor else around("vector", "fetch")
    return queries.withColumn("clusters", found)


def _read(clusters: Clusters, queries: DataFrame) -> DataFrame:
    """The items of clusters that some query wants: a test on the folders they are stored in."""
    asked = queries.select(F.explode_outer("clusters").alias("c")).distinct().collect()  # a row a centre, at most
    named = [row.c for row in asked]
    return clusters.items if None in named else clusters.items.where(F.col("cluster").isin(named))


def pruned_queries(clusters: Clusters, queries: DataFrame, cosine: bool = False) -> DataFrame:
    """``queries``, as ``nearest`` takes them, with the ``clusters`` that can hold their best items and the ``floor`` these reach.

    A query that orders by a column, or finds fewer items than it fetches around
    it, has null for all clusters.
    """
    asked = checkpointed(queries.withColumn("vector", F.col("vector").cast("array<double>")).where("vector is not null and fetch > 0"))
    by_similarity = asked.where("sort_by is null") if "sort_by" in asked.columns else asked
    first = checkpointed(_with_clusters(clusters, by_similarity, cosine, floor=False))
    around = nearest(_read(clusters, first), first, cosine=cosine)
    counts = by_similarity.groupBy("query_id").agg(F.max("fetch").alias("_fetch"))
    floors = around.join(counts, "query_id").where("position = _fetch").groupBy("query_id").agg(F.min("similarity").alias("floor"))
    known = asked.join(floors, "query_id", "left")
    found = _with_clusters(clusters, known.where("floor is not null"), cosine, floor=True)
    rest = known.where("floor is null").withColumn("clusters", F.lit(None).cast("array<int>"))
    return checkpointed(found.unionByName(rest))


def nearest_in_clusters(clusters: Clusters, queries: DataFrame, cosine: bool = False) -> DataFrame:
    """As ``nearest``, over items stored by cluster."""
    pruned = pruned_queries(clusters, queries, cosine)
    return nearest(_read(clusters, pruned), pruned, cosine=cosine)


def share_scored(clusters: Clusters, pruned: DataFrame) -> float:
    """Of all items times all queries, the share that is scored."""
    sizes = F.array(*[F.lit(float(n)) for n in clusters.sizes])
    total = float(clusters.sizes.sum()) or 1.0
    held = F.aggregate("clusters", F.lit(0.0), lambda a, c: a + F.element_at(sizes, c + 1))
    part = F.coalesce(held, F.lit(total))
    return float(pruned.agg(F.avg(part / total)).first()[0] or 0.0)
