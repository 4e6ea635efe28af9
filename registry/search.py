"""Vector arithmetic, encoding, exact neighbours, ranking and limits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from registry import query
from registry import sqltext as q
from registry.bindings import CAT_SQL, cat, table, vectors
from shelfwise.functions import vectors as vec
from shelfwise.operators.encode import HashEncoder, ModelEncoder
from shelfwise.operators.clusters import build_clusters, nearest_in_clusters
from shelfwise.operators.filters import with_ids
from shelfwise.operators.knn import nearest
from shelfwise.operators.resolve import anchor_table
from shelfwise.plans.recommend import with_vectors
from shelfwise.session import new_path, small_table, spread

ENCODER = HashEncoder(64)

DOCS_SQL = q.encoded("SELECT doc_id, text FROM documents", "doc_id")
SEARCH_SQL = q.encoded("SELECT item_id AS query_id, text FROM benchmark", "query_id")
VECTORS_SQL = "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings"


def doc_items(spark, sf):
    """Every document with the vector of its whole text."""
    docs = spread(table(spark, sf, "documents"))
    return ENCODER.encode(docs, "text", "embedding").select(
        F.col("doc_id").alias("item_id"), "lang", "source", "n_chars", "embedding"
    )


def searches(spark, sf):
    """Every benchmark text as a query vector."""
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ENCODER.encode(texts, "text", "vector").select("query_id", "vector")


def _cells(df, key: str, column: str):
    """A vector column laid out as its cells, rounded.

    The outer form keeps Spark from adding a filter that computes the vector again.
    """
    return df.select(key, F.posexplode_outer(column).alias("slot", "weight")).select(
        key, "slot", F.round("weight", 9).alias("weight")
    )


def _cells_sql(source: str, key: str, column: str) -> str:
    return (
        f"SELECT {key}, CAST(i - 1 AS INT) AS slot, round({column}[i], 9) AS weight FROM ("
        f"SELECT {key}, {column}, unnest(range(1, len({column}) + 1)) AS i FROM ({source}))"
    )


@query("v1_encode_documents", _cells_sql(DOCS_SQL, "doc_id", "vec"))
def _(spark, sf):
    return _cells(doc_items(spark, sf).withColumnRenamed("item_id", "doc_id"), "doc_id", "embedding")


@query("v2_encode_queries", _cells_sql(SEARCH_SQL, "query_id", "vec"))
def _(spark, sf):
    return _cells(searches(spark, sf), "query_id", "vector")


ANCHORS_SQL = q.encoded(q.anchors_source(), "pos, sort_by, ascending")


# How close each document is to each anchor phrase.
@query(
    "v3_encode_anchors",
    f"SELECT doc_id, pos AS position, round(list_inner_product(d.vec, a.vec), 9) AS score FROM ({DOCS_SQL}) d, ({ANCHORS_SQL}) a",
)
def _(spark, sf):
    from shelfwise.operators.payload import packed

    docs = doc_items(spark, sf).withColumn("anchors", packed(anchor_table(spark, ENCODER)))
    scored = docs.select(F.col("item_id").alias("doc_id"), "embedding", F.explode("anchors").alias("a"))
    return scored.select(
        "doc_id", "a.position", F.round(vec.inner_product(F.col("embedding"), F.col("a.vector")), 9).alias("score")
    )


@query("u1_model_encoder", _cells_sql(DOCS_SQL, "doc_id", "vec"))
def _(spark, sf):
    def hash_model():
        """The hashed-word encoder as a user's Python model."""
        import hashlib

        import numpy as np
        import regex

        split = regex.compile(r"[^\p{L}\p{N}]+")

        def encode(texts):
            out = np.zeros((len(texts), 64), dtype="float32")
            for row, text in enumerate(texts):
                slots = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in split.split(text.lower()) if w]
                out[row] = np.bincount(slots, minlength=64)
            return out

        return encode

    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    encoded = ModelEncoder(hash_model, 64).encode(docs, "text", "embedding")
    return _cells(encoded, "doc_id", "embedding")


# Pairs for the arithmetic: each vector with the one of the next id.
_NEXT_SQL = (
    f"SELECT a.item_id, a.embedding AS a, b.embedding AS b FROM ({VECTORS_SQL}) a JOIN ({VECTORS_SQL}) b ON b.item_id = a.item_id + 1"
)


def _next_pairs(spark, sf):
    v = vectors(spark, sf)
    following = v.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("b"))
    return v.select("item_id", F.col("embedding").alias("a")).join(following, "item_id")


@query("v4_inner_product", f"SELECT item_id, round(list_inner_product(a, b), 9) AS score FROM ({_NEXT_SQL})")
def _(spark, sf):
    score = vec.inner_product(F.col("a"), F.col("b"))
    return _next_pairs(spark, sf).select("item_id", F.round(score, 9).alias("score"))


_SUM_SQL = "list_transform(list_zip(a, b), lambda p: p[1] + 2 * p[2])"


@query(
    "v5_l2_normalize",
    _cells_sql(f"SELECT item_id, {q.unit('m')} AS u FROM (SELECT item_id, {_SUM_SQL} AS m FROM ({_NEXT_SQL}))", "item_id", "u"),
)
def _(spark, sf):
    mixed = F.zip_with("a", "b", lambda x, y: x.cast("double") + 2 * y.cast("double"))
    return _cells(_next_pairs(spark, sf).select("item_id", vec.l2_normalize(mixed).alias("u")), "item_id", "u")


_BLEND_SQL = "list_transform(list_zip(a, b), lambda p: 0.65::DOUBLE * p[1] + 0.35::DOUBLE * p[2])"


@query(
    "v6_blend",
    _cells_sql(f"SELECT item_id, {q.unit('m')} AS u FROM (SELECT item_id, {_BLEND_SQL} AS m FROM ({_NEXT_SQL}))", "item_id", "u"),
)
def _(spark, sf):
    blended = vec.blend(F.col("a"), F.col("b"), 0.35)
    return _cells(_next_pairs(spark, sf).select("item_id", blended.alias("u")), "item_id", "u")


@query(
    "v7_cosine",
    f"SELECT item_id, round(list_cosine_similarity(m, b), 9) AS cosine, round(1 - list_cosine_similarity(m, b), 9) AS distance "
    f"FROM (SELECT item_id, {_SUM_SQL} AS m, b FROM ({_NEXT_SQL}))",
)
def _(spark, sf):
    mixed = F.zip_with("a", "b", lambda x, y: x.cast("double") + 2 * y.cast("double"))
    pairs = _next_pairs(spark, sf).select("item_id", mixed.alias("m"), "b")
    m, b = F.col("m"), F.col("b")
    return pairs.select(
        "item_id", F.round(vec.cosine(m, b), 9).alias("cosine"), F.round(vec.cosine_distance(m, b), 9).alias("distance")
    )


@query(
    "s15_distance_to_similarity",
    f"SELECT item_id, round_even(1 - d, 4) AS similarity FROM "
    f"(SELECT item_id, 1 - round(list_inner_product(a, b), 9) AS d FROM ({_NEXT_SQL}))",
)
def _(spark, sf):
    distance = 1 - F.round(vec.inner_product(F.col("a"), F.col("b")), 9)
    return _next_pairs(spark, sf).select("item_id", vec.distance_to_similarity(distance).alias("similarity"))


def _ranked_sql(items: str, queries: str, k: int, where: str = "true", expr: str = "list_inner_product(i.vec, s.vec)") -> str:
    return (
        f"SELECT query_id, item_id, round(similarity, 6) AS similarity, CAST(position AS INT) AS position FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS position FROM ("
        f"SELECT s.query_id, i.item_id, round({expr}, 12) AS similarity FROM ({items}) i, ({queries}) s WHERE {where})) "
        f"WHERE position <= {k}"
    )


def _shown(ranked):
    return ranked.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), "position")


_DOC_ITEMS_SQL = f"SELECT doc_id AS item_id, vec FROM ({DOCS_SQL})"


# The documents nearest to each benchmark text.
@query("v8_knn_batch", _ranked_sql(_DOC_ITEMS_SQL, SEARCH_SQL, 10))
def _(spark, sf):
    return _shown(nearest(doc_items(spark, sf), searches(spark, sf).withColumn("fetch", F.lit(10))))


@query("d6_score_join_all_items", _ranked_sql(
    "SELECT item_id, embedding AS vec FROM (" + VECTORS_SQL + ")",
    "SELECT item_id AS query_id, embedding AS vec FROM (" + VECTORS_SQL + ")", 5))
def _(spark, sf):
    items = vectors(spark, sf)
    queries = items.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(5).alias("fetch"))
    return _shown(nearest(items, queries))


# The same through items stored by cluster, where clusters that can't hold a near item are not scored.
@query("v8_knn_in_clusters", _ranked_sql(
    "SELECT item_id, embedding AS vec FROM (" + VECTORS_SQL + ")",
    "SELECT item_id AS query_id, embedding AS vec FROM (" + VECTORS_SQL + ")", 3))
def _(spark, sf):
    items = vectors(spark, sf)
    clusters = build_clusters(items, new_path(spark, "clusters"), centres=32)
    queries = items.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(3).alias("fetch"))
    return _shown(nearest_in_clusters(clusters, queries))


# The stored vectors nearest to each benchmark text, sixteen texts to a pass.
@query(
    "d6_score_join_several_passes",
    _ranked_sql("SELECT item_id, embedding AS vec FROM (" + VECTORS_SQL + ")", SEARCH_SQL, 3),
)
def _(spark, sf):
    queries = searches(spark, sf).withColumn("fetch", F.lit(3))
    return _shown(nearest(vectors(spark, sf), queries, pass_queries=16))


_LABEL_SQL = (
    "SELECT label AS query_id, list(m ORDER BY slot) AS vec FROM (SELECT label, slot, round(avg(x), 9) AS m FROM ("
    "SELECT label, unnest(range(64)) AS slot, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1"
)


def label_means(spark, sf):
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("slot", "x"))
    means = cells.groupBy("label", "slot").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "m"))), lambda c: c["m"]).alias("vector")
    )


LABEL_TOP_SQL = _ranked_sql(f"SELECT item_id, embedding AS vec FROM ({CAT_SQL})", _LABEL_SQL, 20)


def label_top(spark, sf):
    """Per label, the 20 catalogue items nearest to its mean."""
    return _shown(nearest(cat(spark, sf), label_means(spark, sf).withColumn("fetch", F.lit(20))))


# The mean vector of each label against the catalogue, where the price is in range.
@query(
    "v9_knn_in_filtered_pool",
    _ranked_sql(
        f"SELECT item_id, embedding AS vec, price, variety, points FROM ({CAT_SQL})",
        _LABEL_SQL, 5,
        "i.price >= 901 AND i.price <= 1500 AND i.points >= 85 AND "
        "(s.query_id % 2 = 0 OR lower(i.variety) = 'economy')",
    ),
)
def _(spark, sf):
    filters = F.struct(
        F.lit(901.0).alias("price_min"), F.lit(1500.0).alias("price_max"),
        F.when(F.col("query_id") % 2 == 1, "Economy").alias("variety"),
        F.lit(None).cast("string").alias("country"), F.lit(85).alias("min_points"),
    )
    queries = label_means(spark, sf).select("query_id", "vector", F.lit(5).alias("fetch"), filters.alias("filters"))
    return _shown(nearest(cat(spark, sf), queries))


# More rows asked for than there are, and none at all next to a filter.
@query(
    "c10_more_than_there_are",
    _ranked_sql(
        f"SELECT item_id, embedding AS vec, price FROM ({CAT_SQL})", _LABEL_SQL, 1_000_000,
        "s.query_id % 2 = 0 AND i.price >= 905",
    ),
)
def _(spark, sf):
    filters = F.struct(
        F.lit(905.0).alias("price_min"), F.lit(None).cast("double").alias("price_max"),
        F.lit(None).cast("string").alias("variety"), F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("int").alias("min_points"),
    )
    fetch = F.when(F.col("query_id") % 2 == 0, 1_000_000).otherwise(0)
    queries = label_means(spark, sf).select("query_id", "vector", fetch.alias("fetch"), filters.alias("filters"))
    return _shown(nearest(cat(spark, sf), queries))


_TITLES = ("cold widget", "small widget", "large bolt", "no such thing")
_TITLE_VALUES = ", ".join(f"({i}, {q.lit(t)})" for i, t in enumerate(_TITLES))
_NAMED_SQL = (
    f"SELECT query_id, embedding AS vec FROM ({CAT_SQL}) JOIN (SELECT t.query_id, min(c.item_id) AS first_id FROM "
    f"(VALUES {_TITLE_VALUES}) t(query_id, title) JOIN ({CAT_SQL}) c ON c.title = t.title GROUP BY 1) ON item_id = first_id"
)


def title_requests(spark):
    return small_table(spark, "query_id long, title string", list(enumerate(_TITLES)))


@query(
    "v10_item_to_item",
    _ranked_sql(
        f"SELECT item_id, embedding AS vec FROM ({CAT_SQL})", _NAMED_SQL, 6, expr="list_cosine_similarity(i.vec, s.vec)"
    ),
)
def _(spark, sf):
    from shelfwise.plans.explore import neighbours_of_titles

    return _shown(neighbours_of_titles(cat(spark, sf), title_requests(spark), top_n=5))


@query(
    "v11_vector_by_key",
    _cells_sql(f"SELECT doc_id, embedding AS v FROM labels JOIN ({VECTORS_SQL}) ON item_id = doc_id", "doc_id", "v"),
)
def _(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    found = vectors(spark, sf).join(wanted, "item_id").select(
        F.col("item_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    return _cells(found, "doc_id", "v")


@query(
    "d2_catalogue_with_vectors",
    "SELECT p_partkey AS item_id, p_retailprice AS price, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total "
    "FROM part JOIN embeddings ON vec_id = p_partkey",
)
def _(spark, sf):
    catalogue = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("price")
    )
    total = F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return with_vectors(catalogue, vectors(spark, sf)).select("item_id", "price", F.round(total, 6).alias("total"))


@query(
    "d3_neighbours_with_metadata",
    "SELECT r.query_id, r.position, r.item_id, d.lang, d.source, d.n_chars FROM ("
    + _ranked_sql(_DOC_ITEMS_SQL, SEARCH_SQL, 5) + ") r JOIN documents d ON d.doc_id = r.item_id",
)
def _(spark, sf):
    found = nearest(doc_items(spark, sf), searches(spark, sf).withColumn("fetch", F.lit(5)))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source", "n_chars")
    asked = table(spark, sf, "benchmark").count()
    return with_ids(docs, found.select("query_id", "position", "item_id"), 5 * asked)


# Per label, the vectors nearest to its mean.
@query("w4_top_k_per_group", _ranked_sql(f"SELECT item_id, embedding AS vec FROM ({VECTORS_SQL})", _LABEL_SQL, 5))
def _(spark, sf):
    return _shown(nearest(vectors(spark, sf), label_means(spark, sf).withColumn("fetch", F.lit(5))))


def _top_sql(order: str, k: int) -> str:
    return f"SELECT item_id, price, points FROM ({CAT_SQL}) ORDER BY {order} LIMIT {k}"


@query(
    "g1_order_by_similarity",
    _ranked_sql(f"SELECT item_id, embedding AS vec FROM ({VECTORS_SQL})", _LABEL_SQL, 100, "s.query_id = (SELECT min(label) FROM embeddings)"),
)
def _(spark, sf):
    means = label_means(spark, sf)
    one = means.orderBy("query_id").limit(1).withColumn("fetch", F.lit(100))
    return _shown(nearest(vectors(spark, sf), one))


@query("g2_order_by_price_up", _top_sql("price ASC NULLS LAST, item_id", 50))
def _(spark, sf):
    ordered = cat(spark, sf).orderBy(F.asc_nulls_last("price"), "item_id")
    return ordered.limit(50).select("item_id", "price", "points")


@query("g2_order_by_points_down", _top_sql("points DESC NULLS LAST, item_id", 50))
def _(spark, sf):
    ordered = cat(spark, sf).orderBy(F.desc_nulls_last("points"), "item_id")
    return ordered.limit(50).select("item_id", "price", "points")


@query("g3_head", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)
