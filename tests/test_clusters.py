"""Neighbours by cluster and filters before the product: the same rows from fewer scores."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import clusters as C
from shelfwise.operators import knn
from shelfwise.operators.filters import with_value_keys
from shelfwise.plans.model import build_items
from shelfwise.session import checkpointed, small_table

FILTERS = "struct<price_min: double, price_max: double, variety: string, country: string, min_points: int>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def directed(seed=5, groups=12, each=40, dim=16, spread=0.08):
    """Vectors in a few directions, of different lengths, with repeated ones, one of length 0 and one missing."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, dim))
    rows = (heads[:, None] + spread * rng.normal(size=(groups, each, dim))).reshape(-1, dim) * rng.uniform(0.5, 2, size=(groups * each, 1))
    rows[7] = rows[3]
    rows[11] = 0
    return rows


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(i, v.tolist(), float(i % 9), None if i % 7 == 0 else 80.0 + i % 5, ("Red ", "white", None)[i % 3], "x") for i, v in enumerate(directed())]
    rows.append((9999, None, 1.0, 90.0, "red", "x"))
    items = checkpointed(small_table(spark, "item_id long, embedding array<double>, price double, points double, variety string, country string", rows))
    return items, C.build_clusters(items, str(tmp_path_factory.mktemp("clusters") / "items"), centres=12)


def asked(spark, n=24, fetch=5, **columns):
    rows = [(i, (v + 0.01).tolist(), fetch) for i, v in enumerate(directed()[:: 480 // n][:n])]
    return small_table(spark, "query_id long, vector array<double>, fetch int", rows).withColumns(columns)


def ranked(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("fetch", [1, 5, 700])
def test_clusters_give_the_same_rows(spark, stored, cosine, fetch):
    items, found = stored
    queries = asked(spark, fetch=fetch)
    assert ranked(C.nearest_in_clusters(found, queries, cosine)) == ranked(knn.nearest(items, queries, cosine=cosine))


def test_few_clusters_are_scored_and_read(spark, stored):
    _, found = stored
    pruned = C.pruned_queries(found, asked(spark))
    assert C.share_scored(found, pruned) < 0.4
    one = C.pruned_queries(found, asked(spark, n=1))
    text = plan(knn.nearest(C._read(found, one), one, size=(1, 5)))
    assert "PartitionFilters: [isnotnull(cluster" in text or "PartitionFilters: [cluster" in text


def test_filters_orders_and_left_out_items_hold_in_clusters(spark, stored):
    items, found = stored
    pool = F.struct(
        F.when(F.col("query_id") % 2 == 0, 2.0).alias("price_min"), F.lit(None).cast("double").alias("price_max"),
        F.when(F.col("query_id") % 3 == 0, "RED").alias("variety"), F.lit(None).cast("string").alias("country"),
        F.when(F.col("query_id") % 5 == 0, 82).alias("min_points"),
    )
    queries = asked(
        spark, filters=pool.cast(FILTERS), exclude_id=F.col("query_id") * 20,
        sort_by=F.when(F.col("query_id") % 4 == 1, "points"), ascending=F.col("query_id") % 8 == 1,
    )
    want = ranked(knn.nearest(items, queries))
    assert ranked(C.nearest_in_clusters(found, queries)) == want
    assert ranked(knn.nearest(found.items, C.pruned_queries(found, queries), pass_queries=3)) == want


def test_vectors_without_direction_are_all_scored(spark, tmp_path):
    rng = np.random.default_rng(1)
    items = checkpointed(small_table(spark, "item_id long, embedding array<double>", [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 32)))]))
    found = C.build_clusters(items, str(tmp_path / "c"), centres=8)
    queries = items.where("item_id < 10").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(4).alias("fetch"))
    assert C.share_scored(found, C.pruned_queries(found, queries)) > 0.9
    assert ranked(C.nearest_in_clusters(found, queries)) == ranked(knn.nearest(items, queries))


def test_no_items_and_a_hot_cluster(spark, tmp_path):
    nothing = small_table(spark, "item_id long, embedding array<double>", [(1, None)]).where("item_id > 1")
    queries = asked(spark, n=2)
    empty = C.build_clusters(nothing, str(tmp_path / "none"))
    assert C.nearest_in_clusters(empty, queries).count() == 0
    same = checkpointed(spark.range(400).select(F.col("id").alias("item_id"), F.array(*[F.lit(1.0)] * 16).alias("embedding")))
    hot = C.build_clusters(same, str(tmp_path / "hot"), centres=4)
    assert ranked(C.nearest_in_clusters(hot, queries)) == ranked(knn.nearest(same, queries))


def batch(n=200):
    rng = np.random.default_rng(2)
    return pa.RecordBatch.from_pydict({
        "item_id": np.arange(n), "embedding": rng.normal(size=(n, 3)).tolist(), "price": np.arange(n) % 10 * 1.0,
        "points": [90.0] * n, "variety": ["red", "white", None, "rose"] * (n // 4), "country": ["x"] * n,
    })


def test_only_rows_of_the_pool_are_scored():
    nothing = {n: None for n in ("exclude_id", "sort_by", "ascending", "price_max", "min_points", "country")}
    rules = [{"price_min": 7.0, "variety": None}, {"price_min": None, "variety": "red"}, {"price_min": 7.0, "variety": None}, {"price_min": 99.0, "variety": "red"}]
    best = knn._Best(pa.array([{"query_id": i, "vector": [1.0, i, 0], "fetch": 3, **nothing, **r} for i, r in enumerate(rules)]), cosine=False)
    best.take(batch())
    assert best.cells == 60 * 2 + 50
    assert np.bincount(best.kept.query, minlength=4).tolist() == [3, 3, 3, 0]


def test_values_that_all_queries_ask_for_reach_the_scan(spark, stored, tmp_path):
    items, _ = stored
    build_items(items.where("embedding is not null"), str(tmp_path))
    kept = spark.read.parquet(str(tmp_path / "items"))
    pool = F.struct(
        F.lit(3.0).alias("price_min"), F.lit(None).cast("double").alias("price_max"),
        F.when(F.col("query_id") % 2 == 0, "Red").otherwise("WHITE").alias("variety"),
        F.lit(None).cast("string").alias("country"), F.lit(None).cast("int").alias("min_points"),
    )
    queries = checkpointed(asked(spark, filters=pool.cast(FILTERS)))
    found = knn.nearest(kept, queries)
    text = plan(found)
    assert "In(variety_key, [red,white])" in text and "GreaterThanOrEqual(price,3.0)" in text
    single = items.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert ranked(found) == ranked(knn.nearest(single, queries))
    free = checkpointed(queries.withColumn("filters", F.when(F.col("query_id") > 0, F.col("filters"))))
    assert "In(variety_key" not in plan(knn.nearest(kept, free))
    assert set(with_value_keys(items).columns) - set(items.columns) == {"variety_key", "country_key"}


def test_a_task_of_many_queries_has_bounded_work(spark, stored, monkeypatch):
    items, found = stored
    queries = asked(spark, n=96, fetch=3)
    want = ranked(knn.nearest(items, queries))
    monkeypatch.setattr(knn, "TASK_PRODUCTS", 16 * 30 * 30)
    monkeypatch.setattr(knn, "CHUNK_QUERIES", 7)
    assert ranked(knn.nearest(items, queries, pass_queries=10)) == want
    assert ranked(knn.nearest(found.items, C.pruned_queries(found, queries), pass_queries=10)) == want
    scored = knn.score_partitions(items, queries, pass_queries=10)
    scored.collect()
    work = scored.groupBy(F.spark_partition_id()).agg(F.countDistinct("query_id").alias("n")).collect()
    assert len(work) > 30 and max(r.n for r in work) < 96


@pytest.mark.parametrize("items, queries, dim", [(0, 0, 1), (700, 120_000, 3), (615_000, 615_000, 64), (10**9, 10**9, 1024), (10**7, 5000, 64)])
def test_cuts_bound_what_a_task_holds_and_computes(items, queries, dim):
    blocks, groups = knn._cut(items, queries, dim)
    rows, some = -(-items // blocks), -(-queries // groups)
    assert rows * some * dim <= knn.TASK_PRODUCTS and rows * dim * 8 <= knn.BLOCK_BYTES and some * dim * 8 <= knn.QUERY_BYTES


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e20, 1e200])
def test_scores_in_single_precision_lose_no_row(scale):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 8)) * np.exp(rng.normal(size=(3000, 1)))
    vectors[1500:] = vectors[:1500] + 1e-9 * rng.normal(size=(1500, 8))  # equal in single precision
    asked = rng.normal(size=(40, 8))
    nothing = {n: None for n in ("sort_by", "ascending", "price_min", "price_max", "min_points", "variety", "country")}
    best = knn._Best(pa.array([{"query_id": i, "vector": q.tolist(), "fetch": 6, "exclude_id": i, **nothing} for i, q in enumerate(asked)]), cosine=False)
    for rows in np.array_split(np.arange(3000), 3):
        best.take(pa.RecordBatch.from_pydict({
            "item_id": rows, "embedding": (vectors[rows] * scale).tolist(), "price": [None] * 1000, "points": [None] * 1000,
            "variety": [None] * 1000, "country": [None] * 1000,
        }))
    scores = np.round(asked @ (vectors * scale).T, 12)
    for q in range(40):
        order = [i for i in np.lexsort((np.arange(3000), -scores[q])) if i != q][:6]
        if scale >= 1:
            assert best.kept.item[best.kept.query == q].tolist() == order
        assert len(best.kept.item[best.kept.query == q]) == 6 and q not in best.kept.item[best.kept.query == q]


def test_pairs_below_the_floor_are_not_scored_in_full(monkeypatch):
    rng = np.random.default_rng(6)
    full, einsum = [], np.einsum
    monkeypatch.setattr(knn.np, "einsum", lambda spec, a, b: full.append(len(a)) or einsum(spec, a, b))
    nothing = {n: None for n in ("exclude_id", "sort_by", "ascending", "price_min", "price_max", "min_points", "variety", "country")}
    best = knn._Best(pa.array([{"query_id": i, "vector": rng.normal(size=3).tolist(), "fetch": 3, **nothing} for i in range(50)]), cosine=False)
    best.take(batch(20_000))
    assert 0 < sum(full) < best.cells // 20
