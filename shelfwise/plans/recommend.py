"""Answers a batch of ``item + property`` requests over a catalogue."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.vectors import blend
from shelfwise.operators.filters import (
    any_filter, bounded_broadcast, item_columns, merge_filters, normalize_filters, with_ids,
)
from shelfwise.operators.knn import loosest_bounds, score_partitions, within_bounds
from shelfwise.operators.resolve import all_known_values, parse_requests, resolve_items
from shelfwise.schemas import FILTERS, REQUEST
from shelfwise.session import checkpointed, small_table
from shelfwise.vocab import (
    ANCHOR_THRESHOLD, BLEND_WEIGHT, DEFAULT_TOP_K, OVERFETCH_FACTOR, OVERFETCH_MIN,
)

VECTOR_BYTES = 16 << 10  # of a stored vector, at most: 2,048 numbers of 8 bytes


@dataclass
class Recommender:
    """A catalogue with its vectors and the encoder that made them.

    ``items`` holds the catalogue columns and ``embedding`` in one table, so
    that scoring a batch scans it once and joins nothing; see ``with_vectors``.
    """

    items: DataFrame
    encoder: object
    known: DataFrame | None = None
    threshold: float = ANCHOR_THRESHOLD
    blend_weight: float = BLEND_WEIGHT
    partial_filters: bool = False
    regex_titles: bool = True

    def recommend(self, requests: DataFrame) -> DataFrame:
        """Ranked items per request: ``query_id, rank``, catalogue columns, ``similarity``.

        The parsed and the resolved requests, one short row each, are written to
        the shared folder, so that each scan of the catalogue happens once.
        Every request gets its own ranking, also where a ``query_id`` is missing
        or given twice; ``recommend_keyed`` tells such requests apart.
        """
        return self.recommend_keyed(requests).drop("request")

    def recommend_keyed(self, requests: DataFrame) -> DataFrame:
        """As ``recommend``, with a first column ``request`` that numbers the requests of the batch."""
        intake = requests if "request" in requests.columns else numbered(requests)
        parsed = self.parse(intake.withColumn("query_id", F.col("request")).drop("request"))
        active = normalize_filters(merge_filters(F.col("parsed"), F.col("filters"), self.partial_filters))
        asked = parsed.select("top_k", active.alias("active")).agg(
            F.count(F.lit(1)).alias("n"), F.max("top_k").alias("top_k"), *loosest_bounds(F.col("active"))
        ).first()
        n, top_k = asked["n"], asked["top_k"] or DEFAULT_TOP_K
        fetch = max(top_k * OVERFETCH_FACTOR, OVERFETCH_MIN)

        queries = self.query_vectors(parsed, n)
        scored = score_partitions(
            within_bounds(self.items, asked, parsed, active), queries, (n, fetch), carry=("top_k", "drop_id", "then_by", "then_ascending")
        )
        ranked = rerank(scored)
        shown = [c for c in item_columns(self.items) if c != "embedding"]
        found = with_ids(self.items.drop("embedding"), ranked.withColumnRenamed("query_id", "request"), n * top_k)
        callers = bounded_broadcast(intake.select("request", "query_id"), n)
        return found.join(callers, "request").select("request", "query_id", "rank", *shown, "similarity")

    def parse(self, requests: DataFrame) -> DataFrame:
        """Each request text taken apart; see ``resolve.parse_requests``."""
        known = all_known_values(self.items) if self.known is None else self.known
        return checkpointed(
            parse_requests(complete_requests(requests), known, self.encoder, self.threshold)
        )

    def query_vectors(self, parsed: DataFrame, n: int | None = None) -> DataFrame:
        """Each parsed request as a vector with its filters and orders.

        With a hard filter the whole pool is ordered at once. Without one the
        nearest items are fetched first, the named item among them, and the
        fetched ones are ordered afterwards.
        """
        resolved = checkpointed(resolve_items(self.items, parsed, self.regex_titles, n))
        wanted = resolved.select(F.col("exclude_id").alias("item_id")).where("item_id is not null").distinct()
        stored = with_ids(self.items, wanted, n).select(
            F.col("item_id").alias("exclude_id"), F.col("embedding").alias("_stored")
        )
        joined = resolved.join(bounded_broadcast(stored, n, VECTOR_BYTES), "exclude_id", "left")

        free_text = joined.withColumn("_free", F.when(F.col("_stored").isNull(), F.col("identifier")))
        encoded = self.encoder.encode(free_text, "_free", "_encoded")
        base = F.coalesce(F.col("_stored").cast("array<double>"), F.col("_encoded").cast("array<double>"))
        styled = F.when(
            F.col("modifier_vector").isNotNull(), blend(base, F.col("modifier_vector"), self.blend_weight)
        ).otherwise(base)

        merged = merge_filters(F.col("parsed"), F.col("filters"), self.partial_filters)
        ready = encoded.select(
            "query_id", "top_k", "exclude_id", "sort_by", "ascending",
            styled.alias("vector"), normalize_filters(merged).alias("active"),
        ).withColumn("_pool", any_filter(F.col("active")))
        pool = F.col("_pool")
        overfetch = F.greatest(F.col("top_k") * OVERFETCH_FACTOR, F.lit(OVERFETCH_MIN))
        return ready.select(
            "query_id", "vector", "top_k",
            F.when(pool, F.col("top_k")).otherwise(overfetch).alias("fetch"),
            F.when(pool, F.col("exclude_id")).alias("exclude_id"),
            F.when(pool, F.col("sort_by")).alias("sort_by"),
            F.when(pool, F.col("ascending")).alias("ascending"),
            F.when(pool, F.col("active")).cast(FILTERS).alias("filters"),
            F.col("exclude_id").alias("drop_id"),
            F.col("sort_by").alias("then_by"),
            F.col("ascending").alias("then_ascending"),
        )


def numbered(requests: DataFrame) -> DataFrame:
    """The requests with a number each, ``request``; written once, so a retried task sees the same ones."""
    have = requests if "query_id" in requests.columns else requests.withColumn("query_id", F.lit(None).cast("long"))
    return checkpointed(have.withColumn("request", F.monotonically_increasing_id()))


def complete_requests(requests: DataFrame) -> DataFrame:
    """Fill in what a request may leave out: ``top_k`` and ``filters``."""
    have = set(requests.columns)
    top_k = F.coalesce("top_k", F.lit(DEFAULT_TOP_K)) if "top_k" in have else F.lit(DEFAULT_TOP_K)
    filters = F.col("filters").cast(FILTERS) if "filters" in have else F.lit(None).cast(FILTERS)
    return requests.select(
        "query_id", "query", top_k.cast("int").alias("top_k"), filters.alias("filters")
    )


def rerank(scored: DataFrame) -> DataFrame:
    """Cut the partial results to ``fetch``, drop the named item, order, cut to ``top_k``."""
    per_query = Window.partitionBy("query_id")
    first = per_query.orderBy(F.desc("sort_key"), F.desc("similarity"), F.asc("item_id"))
    fetched = scored.withColumn("_n", F.row_number().over(first)).where("_n <= fetch")
    kept = fetched.where("drop_id is null or item_id <> drop_id")
    value = F.when(F.col("then_by") == "price", F.col("price")).when(
        F.col("then_by") == "points", F.col("points")
    ).otherwise(F.col("similarity"))
    upward = F.coalesce("then_ascending", F.lit(False))
    then = per_query.orderBy(
        F.desc_nulls_last(F.when(upward, -value).otherwise(value)), F.desc("similarity"), F.asc("item_id")
    )
    ranked = kept.withColumn("rank", F.row_number().over(then)).where("rank <= top_k")
    return ranked.select("query_id", "rank", "item_id", "similarity")


def with_vectors(catalogue: DataFrame, vectors: DataFrame) -> DataFrame:
    """The catalogue and its vectors as one table, joined on ``item_id``."""
    return catalogue.join(vectors.select("item_id", "embedding"), "item_id")


def recommend_one(recommender: Recommender, query: str, top_k: int = DEFAULT_TOP_K, filters=None) -> DataFrame:
    """A batch of one request; ``filters`` is a dict of the fields to set."""
    values = tuple((filters or {}).get(f.name) for f in FILTERS)
    schema = T.StructType(REQUEST.fields[:3])
    row = small_table(recommender.items.sparkSession, schema, [(0, query, top_k)])
    struct = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, FILTERS)])
    return recommender.recommend(
        row.withColumn("filters", struct if filters else F.lit(None).cast(FILTERS))
    ).orderBy("rank")
