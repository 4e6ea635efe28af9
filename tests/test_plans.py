"""What the plans must and must not contain."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry import bindings
from registry.bindings import cat, raw, table, vectors
from shelfwise.operators import cleaning, dedup, filters, keys, knn, resolve
from shelfwise.plans.model import build_items
from shelfwise.session import checkpointed, small_table

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_row_is_cut_to_one_per_task_before_the_shuffle(spark):
    text = plan(dedup.keep_first(raw(spark, SF_DIR), ["title"]))
    before_shuffle = text[text.index("Exchange hashpartitioning"):]
    assert re.search(r"WindowGroupLimit .*row_number\(\), 1, Partial", before_shuffle)


def test_only_span_sizes_meet_in_one_task(spark):
    text = plan(keys.with_dense_key(table(spark, SF_DIR, "orders").withColumnRenamed("o_orderkey", "src_row")))
    single = [m.start() for m in re.finditer("Exchange SinglePartition", text)]
    assert len(single) == 1
    assert "HashAggregate" in text[single[0]:].split("\n")[1]


@pytest.fixture()
def queries(spark):
    return small_table(spark, "query_id long, vector array<double>, fetch int", [(0, [0.1] * 64, 5)])


def test_neighbours_shuffle_only_the_best_rows(spark, queries):
    text = plan(knn.nearest(vectors(spark, SF_DIR), queries, size=(1, 5)))
    main = text[: text.index("Subquery")] if "Subquery" in text else text
    after_scoring = main[main.index("MapInArrow"):]
    assert "Exchange" not in after_scoring
    assert main.count("Exchange") == 1 and "Exchange hashpartitioning(query_id" in main
    for join in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert join not in text


def test_scan_reads_only_what_scoring_needs(spark, queries):
    text = plan(knn.nearest(vectors(spark, SF_DIR), queries, size=(1, 5)))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_constant_filters_reach_the_scan(spark):
    parts = table(spark, SF_DIR, "part").withColumnRenamed("p_retailprice", "price")
    text = plan(filters.apply_filters(parts, price_min=905.0).select("p_partkey"))
    assert "GreaterThanOrEqual(p_retailprice,905.0)" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in text


def test_producer_rules_are_a_broadcast_join(spark):
    text = plan(cleaning.override_country(raw(spark, SF_DIR)))
    assert text.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in text


def test_no_text_meets_every_needle(spark):
    wanted = small_table(spark, "identifier string", [("cold",), ("c.ld",)])
    text = plan(resolve.first_title_match(cat(spark, SF_DIR), wanted, rows=2))
    for join in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert join not in text


def test_long_sides_are_not_broadcast(spark):
    df = table(spark, SF_DIR, "part")
    hinted = filters.bounded_broadcast(df, filters.BROADCAST_ROWS)
    assert "UnresolvedHint broadcast" in hinted._jdf.queryExecution().logical().toString()
    for rows in (None, filters.BROADCAST_ROWS + 1):
        assert filters.bounded_broadcast(df, rows) is df


def test_hot_key_rows_stay_whole(spark):
    hot = spark.range(30000).select(
        F.col("id").alias("src_row"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id").cast("string")).alias("title")
    )
    assert dedup.keep_first(hot, ["title"]).count() == 20001
    assert dedup.duplicate_members(hot, ["title"]).count() == 10000


def test_looking_up_a_few_items_reads_their_spans_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filters, "ITEMS_PER_SPAN", 50)
    stored = filters.with_id_span(cat(spark, SF_DIR))
    stored.write.partitionBy(filters.ID_SPAN).parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    wanted = checkpointed(small_table(spark, "item_id long", [(3,), (120,), (9999,)]))
    found = filters.with_ids(items, wanted, 3)
    assert sorted(r.item_id for r in found.collect()) == [3, 120]
    assert "dynamicpruning" in plan(found)
    assert filters.ID_SPAN not in found.columns


def test_more_queries_than_one_pass_takes_are_one_plan(spark):
    n = 120_000
    items = spark.range(700).select(F.col("id").alias("item_id"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in (1, 2, 3)]).alias("embedding"))
    items = checkpointed(items)
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.array(*[F.cos(F.col("id") * k) for k in (1, 2, 3)]).alias("vector"), F.lit(2).alias("fetch"))
    found = knn.nearest(items, asked)
    text = plan(found)
    assert text.count("MapInArrow") == 1 and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    items_of = np.array([r.embedding for r in items.orderBy("item_id").collect()])
    rows = found.where("query_id % 1000 = 7").orderBy("query_id", "position").collect()
    assert len(rows) == 2 * n // 1000 and found.count() == 2 * n
    for first, second in zip(rows[::2], rows[1::2]):
        scores = np.round(items_of.astype(float) @ np.cos(first.query_id * np.array([1.0, 2, 3])), 12)
        assert [first.item_id, second.item_id] == sorted(range(700), key=lambda i: (-scores[i], i))[:2]


@pytest.mark.parametrize("block", [1 << 10, 64 << 20])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, block):
    items = vectors(spark, SF_DIR)
    asked = items.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(3).alias("fetch"))
    want = sorted(map(tuple, knn.nearest(items, asked).collect()))
    monkeypatch.setattr(knn, "BLOCK_BYTES", block)
    monkeypatch.setattr(knn, "CHUNK_QUERIES", 7)
    assert sorted(map(tuple, knn.nearest(items, asked, pass_queries=10).collect())) == want


def test_items_that_nobody_wants_are_not_shuffled(spark):
    items = cat(spark, SF_DIR).select("item_id", "title")
    wanted = spark.createDataFrame([(i % 40,) for i in range(500)], "item_id long")
    few, many = filters.with_ids(items, wanted, 500), filters.with_ids(items, wanted, filters.BROADCAST_ROWS + 1)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert "BroadcastHashJoin" in plan(few)
    kept = items.where(filters.member_filter(wanted, "item_id")(F.col("item_id")))
    n = kept.count()
    assert 40 - (items.where("item_id < 40").count() < 40) <= n <= 45
    before_shuffle = plan(many)
    assert re.search(r"Filter .*getbit", before_shuffle) and "BroadcastNestedLoopJoin" not in before_shuffle


def test_vectors_are_broadcast_by_their_bytes(spark):
    df = table(spark, SF_DIR, "part")
    assert filters.bounded_broadcast(df, 100_000, 384 * 8) is df
    assert filters.bounded_broadcast(df, 1_000, 384 * 8) is not df


def test_a_span_of_wide_items_is_written_by_several_tasks(spark, tmp_path):
    wide = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.sha2(F.concat("id", F.lit("-"), i.cast("string")), 256)))
    items = spark.range(0, 1500, 1, 6).select(
        F.col("id").alias("item_id"), wide.alias("description"), F.lit(1.0).alias("price"), F.lit("a").alias("variety"), F.lit("b").alias("country"),
        F.array(F.lit(1.0)).alias("embedding"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        build_items(items, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    stored = spark.read.parquet(str(tmp_path / "items"))
    assert len(stored.inputFiles()) > 2 and stored.count() == 1500


def test_a_long_part_table_is_not_sent_to_every_task(spark, monkeypatch):
    monkeypatch.setattr(bindings, "BROADCAST_ROWS", 100)
    rows = cat(spark, SF_DIR).select("item_id", "title")
    first_join = re.findall(r"(\w+Join) \[(?:p_partkey|vec_id)#\d+L\], \[vec_id", plan(rows))
    assert first_join == ["SortMergeJoin"]
