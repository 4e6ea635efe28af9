"""Similar-item and free-text search without request parsing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.vectors import distance_to_similarity
from shelfwise.operators.filters import ID_SPAN, bounded_broadcast, first_with_title, with_ids
from shelfwise.operators.knn import nearest
from shelfwise.operators.profile import sample_rows
from shelfwise.session import checkpointed

# Columns of a similar-items table.
SIMILAR_COLUMNS = ("title", "variety", "country", "points", "price", "description")


def neighbours_of_titles(items: DataFrame, titles: DataFrame, top_n: int = 5) -> DataFrame:
    """The ``top_n + 1`` items nearest to each titled item, itself among them.

    ``titles`` has ``query_id`` and ``title``; a title nobody carries has no rows.
    """
    n = titles.count()
    named = titles.join(first_with_title(items, titles, n), "title")
    stored = items.select("item_id", F.col("embedding").alias("vector"))
    queries = stored.join(bounded_broadcast(named, n), "item_id").select(
        "query_id", "vector", F.lit(top_n + 1).alias("fetch")
    )
    return nearest(items, queries, size=(n, top_n + 1), cosine=True)


def over_cores(df: DataFrame) -> DataFrame:
    """A sorted and cut table, which arrives in one partition, over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def similar_items(
    catalogue: DataFrame, encoder, titles: DataFrame, top_n: int = 5, sample: int | None = None
) -> DataFrame:
    """Encode the descriptions and list the neighbours of each title; of ``sample`` rows only, if given.

    The encoded rows are read three times, so they are written to the shared folder.
    """
    rows = catalogue if sample is None else over_cores(sample_rows(catalogue, sample))
    filled = rows.withColumn("_text", F.coalesce("description", F.lit("")))
    items = checkpointed(encoder.encode(filled, "_text", "embedding").drop("_text"))
    found = neighbours_of_titles(items, titles, top_n)
    similarity = distance_to_similarity(F.lit(1.0) - F.col("similarity"))
    shown = with_ids(items.select("item_id", *SIMILAR_COLUMNS), found, titles.count() * (top_n + 1))
    return shown.select(
        "query_id", "position", "item_id", *SIMILAR_COLUMNS, similarity.alias("similarity")
    )


def search_text(items: DataFrame, encoder, searches: DataFrame, top_k: int = 5) -> DataFrame:
    """The items closest to each search text by cosine.

    ``searches`` has ``query_id`` and ``text``.
    """
    queries = encoder.encode(searches, "text", "vector").select(
        "query_id", "vector", F.lit(top_k).alias("fetch")
    )
    n = searches.count()
    found = nearest(items, queries, size=(n, top_k), cosine=True)
    columns = [c for c in ("item_id", ID_SPAN, "title", "description") if c in items.columns]
    return with_ids(items.select(*columns), found, n * top_k).select(
        "query_id", "position", "item_id", "title", "description", "similarity"
    )
