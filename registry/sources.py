"""Files written to the shared folder and read back, and the request stream."""

from pyspark.sql import functions as F

from registry import query
from registry import sqltext as q
from registry.bindings import CAT_SQL, RAW_SQL, REQUEST_SQL, cat, raw, requests, table, vectors
from registry.cleaning import CLEAN_SQL
from registry.recommend import RECOMMEND_SQL, THRESHOLD, rounded, workload
from registry.search import ENCODER, VECTORS_SQL, _cells, _cells_sql
from shelfwise.operators.resolve import all_known_values
from shelfwise.plans.clean import clean_catalogue
from shelfwise.plans.model import build_items, build_model, load_model
from shelfwise.plans.recommend import Recommender
from shelfwise.schemas import CLEAN, RAW
from shelfwise.session import checkpointed, new_path
from shelfwise.sources import catalogue as files
from shelfwise.streaming.serve import request_stream, serve
from shelfwise.vocab import NULL_TOKENS

_TOKENS = ", ".join(q.lit(t) for t in NULL_TOKENS)


def _read_cell(name: str) -> str:
    return name if name in ("src_row", "points", "price") else f"CASE WHEN {name} IN ({_TOKENS}) THEN NULL ELSE {name} END AS {name}"


@query("a1_reviews_csv_scan", f"SELECT {', '.join(_read_cell(c) for c in RAW.names)} FROM ({RAW_SQL})")
def _(spark, sf):
    path = new_path(spark, "reviews-csv")
    files.write_csv(raw(spark, sf).select(*RAW.names), path)
    return files.read_reviews_csv(spark, path)


@query(
    "a1_csv_other_column_order",
    f"SELECT {', '.join(_read_cell(c) for c in RAW.names if c != 'src_row')} FROM ({RAW_SQL})",
)
def _(spark, sf):
    path = new_path(spark, "reviews-csv")
    files.write_csv(raw(spark, sf).selectExpr("'extra' AS more", *[c for c in reversed(RAW.names) if c != "src_row"]), path)
    return files.read_reviews_csv(spark, path).drop("src_row")


def _read_clean(name: str) -> str:
    return name if name == "item_id" else _read_cell(name)


# An empty region, from a title with (), reads back as missing.
@query("a2_a3_clean_csv_round_trip", f"SELECT {', '.join(_read_clean(c) for c in CLEAN.names)} FROM ({CLEAN_SQL})")
def _(spark, sf):
    path = new_path(spark, "clean-csv")
    files.write_csv(clean_catalogue(raw(spark, sf, wide=True)), path)
    return files.read_clean_csv(spark, path)


_CAT_COLUMNS = "item_id, title, winery, variety, price, points, country, description"


@query("a4_a5_catalogue_parquet", f"SELECT {_CAT_COLUMNS} FROM ({CAT_SQL})")
def _(spark, sf):
    path = new_path(spark, "catalogue")
    files.write_catalogue(cat(spark, sf).drop("embedding"), path)
    return files.read_catalogue(spark, path)


@query("a6_a7_vector_store", _cells_sql(VECTORS_SQL, "item_id", "embedding"))
def _(spark, sf):
    path = new_path(spark, "vectors")
    files.write_vectors(vectors(spark, sf), path)
    stored = files.read_vectors(spark, path)
    return _cells(stored.select("item_id", F.col("embedding").cast("array<double>")), "item_id", "embedding")


_MANIFEST_SQL = (
    "SELECT 'hashed-words' AS model_name, count(*) AS num_items, CAST(max(len(embedding)) AS BIGINT) AS embedding_dim FROM embeddings"
)


@query("a8_build_manifest", _MANIFEST_SQL)
def _(spark, sf):
    return files.manifest(vectors(spark, sf), "hashed-words")


@query("a9_manifest_round_trip", _MANIFEST_SQL)
def _(spark, sf):
    path = new_path(spark, "manifest")
    files.write_manifest(files.manifest(vectors(spark, sf), "hashed-words"), path)
    return files.read_manifest(spark, path)


@query(
    "a10_request_intake",
    "SELECT query_id, query, CAST(CASE WHEN query_id % 2 = 0 THEN 5 ELSE 7 END AS INT) AS top_k, "
    + ", ".join(
        f"CASE WHEN has_filters THEN f_{f} END AS {f}" for f in ("price_min", "price_max", "variety", "country", "min_points")
    )
    + f" FROM ({REQUEST_SQL})",
)
def _(spark, sf):
    path = new_path(spark, "requests")
    sometimes = F.when(F.col("query_id") % 2 == 1, 7)
    requests(spark, sf).withColumn("top_k", sometimes).write.json(path)
    read = files.read_requests(spark, path)
    return read.select("query_id", "query", "top_k", "filters.*")


# Some lines are cut off or have no query. The others are requests, these are reported.
_LINE_SQL = (
    "SELECT query_id, CASE query_id % 7 WHEN 3 THEN '{\"query_id\": ' || query_id WHEN 5 THEN '{\"query_id\": ' || query_id || '}' "
    "ELSE '{\"query_id\": ' || query_id || ', \"query\": \"any\"}' END AS line FROM (" + REQUEST_SQL + ")"
)


@query(
    "a10_rejected_requests",
    "SELECT line, CASE query_id % 7 WHEN 3 THEN 'malformed' WHEN 5 THEN 'no query' END AS problem, CAST(NULL AS BIGINT) AS query_id "
    f"FROM ({_LINE_SQL}) WHERE query_id % 7 IN (3, 5) "
    f"UNION ALL SELECT NULL, NULL, query_id FROM ({_LINE_SQL}) WHERE query_id % 7 NOT IN (3, 5)",
)
def _(spark, sf):
    path, rejects = new_path(spark, "request-lines"), new_path(spark, "rejects")
    start, i = F.concat(F.lit('{"query_id": '), F.col("query_id").cast("string")), F.col("query_id") % 7
    rest = F.when(i == 3, "").when(i == 5, "}").otherwise(', "query": "any"}')
    requests(spark, sf).select(F.concat(start, rest).alias("value")).write.text(path)
    good = files.read_requests(spark, path, rejects).select(
        F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("problem"), "query_id"
    )
    return spark.read.parquet(rejects).select("line", "problem", F.lit(None).cast("bigint").alias("query_id")).unionByName(good)


# Requests answered from what a build has written: items by span, known values, manifest.
@query("p4_serve_from_artifacts", RECOMMEND_SQL)
def _(spark, sf):
    directory = new_path(spark, "served-model")
    files.write_catalogue(cat(spark, sf).drop("embedding"), f"{directory}/catalogue")
    build_items(cat(spark, sf), directory)
    return rounded(load_model(spark, directory).recommender(ENCODER, threshold=THRESHOLD).recommend(workload(spark)))


@query("a11_result_records", RECOMMEND_SQL)
def _(spark, sf):
    path = new_path(spark, "results")
    ranked = rounded(Recommender(cat(spark, sf), ENCODER, threshold=THRESHOLD).recommend(workload(spark)))
    files.write_results(ranked, path)
    return spark.read.schema(ranked.schema).json(path)


# The clean catalogue, encoded and written as a model, then read back.
_CORPUS = q.encoded(f"SELECT item_id, text_corpus AS text FROM ({CLEAN_SQL})", "item_id")


@query(
    "p3_p4_build_and_load_model",
    f"SELECT c.item_id, c.title, c.price, k.kinds, round(list_sum(list_transform(e.vec, lambda x: CAST(x AS FLOAT)::DOUBLE)), 5) AS total "
    f"FROM ({CLEAN_SQL}) c JOIN ({_CORPUS}) e USING (item_id), "
    f"(SELECT count(DISTINCT country) + count(DISTINCT variety) AS kinds FROM ({CLEAN_SQL})) k",
)
def _(spark, sf):
    directory = new_path(spark, "model")
    build_model(clean_catalogue(raw(spark, sf, wide=True)), ENCODER, directory, "hashed-words")
    model = load_model(spark, directory)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    kinds = model.known.agg(F.count(F.lit(1)).alias("kinds")).scalar()
    return model.catalogue.join(model.vectors, "item_id").select(
        "item_id", "title", "price", kinds.alias("kinds"), F.round(total, 5).alias("total")
    )


@query("t1_streamed_requests", RECOMMEND_SQL)
def _(spark, sf):
    inbox, out, progress = (new_path(spark, f"stream-{part}") for part in ("inbox", "out", "progress"))
    workload(spark).repartition(3, "query_id").write.json(inbox)
    items = checkpointed(cat(spark, sf))  # every batch scans them several times
    recommender = Recommender(items, ENCODER, known=checkpointed(all_known_values(items)), threshold=THRESHOLD)
    serve(recommender, request_stream(spark, inbox, max_files=2), out, progress).awaitTermination()
    return rounded(spark.read.parquet(out).drop("batch_id"))
