from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators import cleaning, dedup, keys, profile
from shelfwise.plans.clean import EXPLORATORY_COLUMNS, clean_catalogue, clean_catalogue_exploratory
from shelfwise.schemas import CLEAN, RAW
from shelfwise.session import small_table


def column(df, name):
    return [row[name] for row in df.collect()]


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_missing_report(raw_reviews):
    report = by(profile.missing_report(raw_reviews.drop("src_row"), total=True), "column_name")
    assert {n: r["missing"] for n, r in report.items() if n != "TOTAL"} == {
        "country": 1, "description": 0, "designation": 5, "points": 1, "price": 1, "province": 1, "region_1": 2, "region_2": 5,
        "taster_name": 3, "taster_twitter_handle": 4, "title": 0, "variety": 1, "winery": 0,
    }
    assert report["designation"]["missing_pct"] == 83.33
    assert report["TOTAL"]["missing"] == sum(r["missing"] for n, r in report.items() if n != "TOTAL")
    assert profile.missing_total(raw_reviews).first()[0] == report["TOTAL"]["missing"]


def test_first_row_per_title_survives(raw_reviews):
    assert sorted(column(dedup.keep_first(raw_reviews, ["title"]), "src_row")) == [10, 12, 14, 15]
    assert sorted(column(dedup.duplicate_members(raw_reviews, ["title", "description"]), "src_row")) == [10, 11]
    assert dedup.duplicates_removed(raw_reviews, ["title"]).first()["rows_removed"] == 2


def test_missing_titles_count_as_equal(spark):
    rows = small_table(spark, "src_row long, title string", [(5, None), (2, None), (3, "x")])
    assert sorted(column(dedup.keep_first(rows, ["title"]), "src_row")) == [2, 3]
    assert sorted(column(dedup.duplicate_members(rows, ["title"]), "src_row")) == [2, 5]


def test_unused_columns_are_dropped_when_present(raw_reviews):
    dropped = cleaning.drop_unused(raw_reviews.drop("designation"))
    assert not {"designation", "region_2", "taster_twitter_handle"} & set(dropped.columns)
    assert {"winery", "region_1"} <= set(dropped.columns)


def test_full_clean(raw_reviews):
    clean = clean_catalogue(raw_reviews)
    assert clean.columns == CLEAN.names
    rows = by(clean, "item_id")
    assert [rows[i]["title"] for i in sorted(rows)] == ["harbour hill dry 2017", "millstone perry", "plum lane (gwent)"]
    assert rows[0]["text_corpus"] == "sharp, oaky.. variety: cider. region: cork"
    assert rows[1]["country"] is None and rows[1]["region"] == "unknown"
    assert rows[2]["taster_name"] == "unknown" and rows[2]["region"] == rows[2]["province"] == "gwent"


def test_exploratory_clean(raw_reviews):
    clean = clean_catalogue_exploratory(raw_reviews)
    assert clean.columns == list(EXPLORATORY_COLUMNS)
    assert sorted(column(clean, "item_id")) == [0, 1, 2]


def test_title_whose_first_copy_has_no_price_vanishes(raw_reviews):
    assert raw_reviews.where("title = 'Old Orchard 2018' AND price IS NOT NULL").count() == 1
    assert "old orchard 2018" not in column(clean_catalogue(raw_reviews), "title")


def test_producer_rule_overrides_country(spark):
    rows = [("Psagot", "France"), ("psagot", "France"), ("Büyülübağ", None), ("Other", None)]
    fixed = cleaning.override_country(small_table(spark, "winery string, country string", rows))
    assert {(r.winery, r.country) for r in fixed.collect()} == {
        ("Psagot", "Israel"), ("psagot", "France"), ("Büyülübağ", "Turkey"), ("Other", None)
    }


def test_region_and_province_fill(spark):
    rows = [(None, None, "X ()"), (None, None, "X (A) (B)"), (None, "R", "X (A)"), (None, None, "X"), ("P", None, None)]
    df = small_table(spark, "province string, region_1 string, title string", rows)
    filled = cleaning.fill_province(cleaning.fill_region(df)).collect()
    assert [(r.region_1, r.province) for r in filled] == [
        ("", ""), ("A", "A"), ("R", "R"), ("unknown", "unknown"), ("unknown", "P")
    ]


def one(spark, value, change):
    return small_table(spark, "t string", [(value,)]).select(change("t")).first()[0]


def test_encoding_repair_is_by_line(spark):
    broken = "cafÃ© â€œhiâ€\x9d\n日本 é ok\nplain"
    assert one(spark, broken, text.repair_encoding) == "café “hi”\n日本 é ok\nplain"
    assert one(spark, "é ok €5 – nice", text.repair_encoding) == "é ok €5 – nice"


def test_character_repair(spark):
    assert one(spark, "It’s “ﬁne” Ｗｉｄｅ\x1b[31m red\x07", text.repair_typography) == "It's \"fine\" Wide red"
    assert one(spark, None, text.clean_text) is None
    assert one(spark, "  nan\n", text.clean_text) is None
    assert one(spark, "a\r\n\tb  c ", text.clean_text) == "a b c"
    assert one(spark, "a\x00b​c﻿d�　e", text.remove_odd_characters) == "a b cd e"


def test_dense_keys_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 5000, 3).withColumnRenamed("id", "src_row")
    for partitions in (1, 8, 200):
        numbered = keys.with_dense_key(rows.repartition(partitions), span=100)
        found = numbered.select(
            F.count("*"), F.min("item_id"), F.max("item_id"), F.count_if(F.col("item_id") * 3 != F.col("src_row"))
        ).first()
        assert tuple(found) == (1667, 0, 1666, 0)


def test_odd_character_report(spark):
    rows = [("plain",), ("é",), ("a\tb",), ("a b",), ("�",), (None,)]
    report = by(profile.odd_character_report(small_table(spark, "t string", rows), "t"), "char_class")
    assert {k: r["row_count"] for k, r in report.items()} == {
        "non_ascii": 3, "control_chars": 1, "weird_spaces": 1, "unicode_replacement": 1
    }


def test_quantiles_equal_the_direct_ones(spark):
    import numpy as np

    values = [float((i * 7919) % 1009) ** 1.5 for i in range(3000)] + [5.0] * 1500 + [None] * 10
    df = small_table(spark, "x double", [(v,) for v in values])
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {r.prob: r.value for r in profile.exact_quantiles(df, "x", probs, bits=4).collect()}
    want = np.quantile([v for v in values if v is not None], probs)
    again = {r.prob: r.value for r in profile.exact_quantiles(df, "x", probs, bits=2, most=3).collect()}
    assert again == got
    assert np.allclose([got[p] for p in probs], want)


def test_describe_of_one_value_and_of_none(spark):
    single = by(profile.describe(small_table(spark, "x double", [(4.0,)]), "x"), "stat")
    assert single["50%"]["value"] == 4.0 and single["std"]["value"] is None
    empty = by(profile.describe(small_table(spark, "x double", [(None,)]), "x"), "stat")
    assert empty["count"]["value"] == 0.0


def test_histogram_matches_numpy(spark):
    import numpy as np

    values = [float(v) for v in (1, 2, 2, 3, 5, 8, 8, 9, 10, 10, 4.6, 5.5)]
    df = small_table(spark, "x double", [(v,) for v in values])
    for bins in (3, 9, 20):
        counts, edges = np.histogram(values, bins)
        got = profile.histogram(df, "x", bins).orderBy("bin").collect()
        assert [r.row_count for r in got] == counts.tolist()
        assert np.allclose([r.bin_start for r in got], edges[:-1])
    flat = profile.histogram(small_table(spark, "x double", [(3.0,), (3.0,)]), "x", 4).orderBy("bin").collect()
    assert [r.row_count for r in flat] == np.histogram([3.0, 3.0], 4)[0].tolist()


def test_sample_is_exact_and_repeatable(spark):
    rows = spark.range(1000).withColumnRenamed("id", "item_id")
    first = sorted(column(profile.sample_rows(rows.repartition(1), 30), "item_id"))
    again = sorted(column(profile.sample_rows(rows.repartition(7), 30), "item_id"))
    assert first == again and len(set(first)) == 30


def test_raw_schema_round_trip(raw_reviews):
    assert raw_reviews.columns == RAW.names


def test_dense_keys_keep_rows_without_an_order(spark):
    rows = small_table(spark, "src_row long, title string", [(5, "a"), (None, "b"), (2, "c"), (None, "b"), (None, "d")])
    got = keys.with_dense_key(rows).orderBy("item_id").collect()
    assert [r.item_id for r in got] == [0, 1, 2, 3, 4] and [r.src_row for r in got] == [2, 5, None, None, None]
    again = keys.with_dense_key(rows.repartition(3)).orderBy("item_id").collect()
    assert got == again


def test_no_task_sorts_more_than_the_bound(spark):
    skewed = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.exp((F.col("id") % 701) / 10)).alias("x"))
    values = skewed.groupBy(F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("n")).cache()
    ranks = [0, 13_000, 20_000, 39_999]
    ranges = profile._narrowed(values, ranks, 3, 20)
    assert sorted(r for *_, held in ranges for r in held) == ranks
    ordered = sorted(r.x for r in skewed.collect())
    for low, high, before, held in ranges:
        within = values.where(profile._within(low, high))
        assert within.count() <= 20 and before == sum(x <= low for x in ordered)
        assert all(low < ordered[r] <= high for r in held)
    odd = spark.createDataFrame([(float(x),) for x in ("nan", "inf", "-inf", "0", "-0.0", "1", "2", "3", "nan")], "x double")
    got = {r.prob: r.value for r in profile.exact_quantiles(odd, "x", (0.0, 0.25, 0.5, 1.0), bits=2, most=2).collect()}
    assert (got[0.0], got[0.25], got[0.5]) == (float("-inf"), 0.0, 2.0) and got[1.0] != got[1.0]
