import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import parse
from shelfwise.functions.vectors import l2_normalize
from shelfwise.operators import filters, resolve
from shelfwise.operators.encode import HashEncoder, ModelEncoder
from shelfwise.operators.knn import nearest
from shelfwise.plans.explore import neighbours_of_titles, search_text, similar_items
from shelfwise.plans.recommend import Recommender, recommend_one
from shelfwise.session import checkpointed, new_path, small_table

NAME = "Harbour Hill Dry Cider"


def ids(df):
    return [row.item_id for row in df.collect()]


@pytest.fixture(scope="module")
def recommender(items, encoder):
    return Recommender(items, encoder, blend_weight=0.6)


def batch(spark, *texts, top_k=2):
    return small_table(spark, "query_id long, query string, top_k int", [(i, t, top_k) for i, t in enumerate(texts)])


def answers(df):
    out = {}
    for row in df.orderBy("query_id", "rank").collect():
        out.setdefault(row.query_id, []).append((row.item_id, round(row.similarity, 5)))
    return out


def test_requests_of_every_kind(spark, recommender):
    asked = {
        f"{NAME} + a bargain": [4, 2],  # the others, cheapest first
        NAME: [1, 2],
        f"{NAME} + plums": [4],  # names a variety as well
        "0 + pears": [1, 2],
        "0 + under 20": [4],
        "+ the dearest": [3, 1],  # an empty name is the first item
        "(harbour|haven) hill": [1, 2],
        "[bad": [0, 1], "12345": [0, 1],  # no item: a text like any other
        "mill.+perry + over 85 points": [],  # at least 85 in price too, and no such item is left
        "2 + ireland": [0, 3],
        "0 + mead": [3],
    }
    got = answers(recommender.recommend(batch(spark, *asked)))
    assert [[i for i, _ in got.get(n, [])] for n in range(len(asked))] == list(asked.values())
    # the vectors have sides 3, 4, 5; "pears" is blended into (0, 0, 0.2268, 0, 0.974)
    assert got[1] == [(1, 0.8), (2, 0.6)] and got[3] == [(1, 0.77916), (2, 0.76578)]


def test_request_filters_override_parsed_ones(spark, recommender):
    assert ids(recommend_one(recommender, "0 + under 30", 5, {"country": "Wales"})) == [2, 4]
    partial = Recommender(recommender.items, recommender.encoder, partial_filters=True)
    assert ids(recommend_one(partial, "0 + under 20", 5, {"country": "Wales"})) == [4]
    assert ids(recommend_one(partial, "0 + under 20", 5, {"country": "france"})) == []
    assert ids(recommend_one(recommender, "0", 3, {"variety": " Any ", "country": "n/a"})) == [1, 2, 3]


def test_empty_pool_keeps_the_columns(recommender):
    empty = recommend_one(recommender, "0 + under 1")
    assert "similarity" in empty.columns and empty.count() == 0


def test_requests_without_defaults(spark, recommender):
    bare = small_table(spark, "query_id long, query string", [(0, NAME)])
    assert [r.item_id for r in recommender.recommend(bare).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_column_orders_put_missing_values_last(spark, items, encoder):
    holed = items.withColumn("price", F.when(~F.col("item_id").isin(0, 3), F.col("price"))).withColumn("points", F.lit(95))
    for pool in ("", " + over 80 points"):
        rec = Recommender(holed, encoder)
        got = answers(rec.recommend(batch(spark, "nothing like it + a bargain" + pool, top_k=5)))
        # over 80 points is over 80 in price as well, and nothing is
        assert [i for i, _ in got.get(0, [])] == ([] if pool else [4, 2, 1, 0, 3])


def test_overfetch_window_counts_the_item_itself(spark, encoder):
    rows = [(i, f"t{i}", float(100 - i), 90, "qq", "zz", [0.0, i / 100, 0.0, 0.0, 1.0]) for i in range(40)]
    kinds = "item_id long, title string, price double, points int, variety string, country string, embedding array<double>"
    table = small_table(spark, kinds, rows)
    rec = Recommender(table.withColumn("embedding", l2_normalize(table["embedding"])), encoder)
    got = answers(rec.recommend(batch(spark, "0 + a bargain", top_k=3)))
    assert [i for i, _ in got[0]] == [19, 18, 17]  # 20 nearest with item 0, cheapest first


def test_parse(spark):
    texts = [
        "109 + under $30", "Pinot + sweet", "Pinot", "x + OVER 90 points", "x + 95+ points", " y + thunder 30.5 + z ",
        "12345678901234567890123",
    ]
    rows = parse.split_query(batch(spark, *texts)).orderBy("query_id").collect()
    assert [r.identifier for r in rows] == ["109", "Pinot", "Pinot", "x", "x", "y", texts[6]]
    assert [r.modifier for r in rows] == ["under $30", "sweet", "", "OVER 90 points", "95 points", "thunder 30.5 z", ""]
    assert [r.price_max for r in rows] == [30.0, None, None, None, None, 30.5, None]
    assert [r.price_min for r in rows] == [None, None, None, 90.0, None, None, None]
    assert [r.min_points for r in rows] == [None, None, None, 90, 95, None, None]
    assert [r.id_wanted for r in rows] == [109] + [None] * 6


def test_sort_phrases(spark, encoder):
    rows = [("a bargain",), ("the dearest",), ("pears",), ("plums",), ("unheard of",)]
    encoded = encoder.encode(small_table(spark, "text string", rows), "text", "modifier_vector")
    got = {r.text: (r.sort_by, r.ascending) for r in resolve.classify_modifier(encoded, encoder).collect()}
    near = {"a bargain": ("price", True), "the dearest": ("price", False)}
    assert got == {text: near.get(text, (None, None)) for (text,) in rows}


def test_known_values_longest_then_first(spark):
    known = small_table(
        spark, "kind string, value string, first_id long",
        [("country", "US", 3), ("country", "Spain", 5), ("variety", "Cabernet", 0), ("variety", "Cabernet Franc", 9),
         ("variety", "Merlot", 4), ("variety", "Malbec", 2), ("variety", "", 1)],
    )
    texts = ["luscious cabernet franc", "merlot or malbec from spain", "nothing"]
    requests = small_table(spark, "query_id long, modifier string", list(enumerate(texts)))
    got = {r.query_id: (r.country, r.variety) for r in resolve.detect_values(requests, known).collect()}
    assert got == {0: ("US", "Cabernet Franc"), 1: ("Spain", "Malbec")}
    words = {r.query_id: r.country for r in resolve.detect_values(requests, known, word_bounds=True).collect()}
    assert words == {0: None, 1: "Spain"}


def test_title_match_modes(spark, catalogue):
    wanted = small_table(spark, "identifier string", [("OLD",), ("p.{2}ry",), ("",), ("(",), ("zzz",), ("d",), ("r$",)])
    got = {r.identifier: r.item_id for r in resolve.first_title_match(catalogue, wanted, rows=7).collect()}
    assert got == {"OLD": 1, "p.{2}ry": 2, "": 0, "d": 0, "r$": 0}
    literal = {r.identifier: r.item_id for r in resolve.first_title_match(catalogue, wanted, regex=False).collect()}
    assert literal == {"OLD": 1, "": 0, "d": 0}


def test_constant_filters(catalogue):
    assert sorted(ids(filters.apply_filters(catalogue, price_min=18, price_max=30))) == [1, 2, 4]
    assert ids(filters.apply_filters(catalogue, variety="Perry ")) == [2]
    assert ids(filters.apply_filters(catalogue, country="wales", min_points=80)) == [2]
    assert len(ids(filters.apply_filters(catalogue, variety="Any", country=" "))) == 5


def test_look_up(spark, catalogue):
    assert filters.by_id(catalogue, 3).first().title == "Bog Myrtle Mead"
    wanted = small_table(spark, "item_id long", [(4,), (999,)])
    got = {r.item_id: r["item"] for r in filters.look_up(catalogue, wanted).collect()}
    assert got[999] is None and got[4].title == "Plum Lane Jerkum"


def test_index_search(spark):
    items = small_table(spark, "item_id long, embedding array<double>", [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7, 0.7])])
    queries = small_table(spark, "query_id long, vector array<double>, fetch int", [(0, [1.0, 0.0], 2), (1, [0.0, 1.0], 9)])
    got = nearest(items, queries).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.item_id) for r in got] == [(0, 0), (0, 2), (1, 1), (1, 2), (1, 0)]


def brute_force(vectors, queries, k):
    scores = np.round(queries @ vectors.T, 12)
    return {
        q: [i for _, i in sorted((-s, i) for i, s in enumerate(row))[:k]] for q, row in enumerate(scores)
    }


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_neighbours_equal_brute_force_with_many_ties(spark, partitions):
    rng = np.random.default_rng(7)
    vectors = rng.integers(-2, 3, size=(600, 4)).astype(float)
    vectors[100:300] = vectors[0]  # a third of the items are copies
    queries = rng.integers(-2, 3, size=(37, 4)).astype(float)
    items = small_table(spark, "item_id long, embedding array<float>", [(i, v.tolist()) for i, v in enumerate(vectors)])
    asked = small_table(
        spark, "query_id long, vector array<double>, fetch int", [(i, v.tolist(), 7) for i, v in enumerate(queries)]
    )
    want = brute_force(vectors, queries, 7)
    for pass_queries in (4096, 10):
        got = {}
        for r in nearest(items.repartition(partitions), asked, pass_queries=pass_queries).orderBy("query_id", "position").collect():
            got.setdefault(r.query_id, []).append(r.item_id)
        assert got == want


def test_small_blocks_give_the_same_neighbours(spark, monkeypatch):
    import pyarrow as pa

    from shelfwise.operators import knn

    rng = np.random.default_rng(3)
    vectors, queries = rng.integers(-3, 4, size=(500, 3)).astype(float), rng.integers(-3, 4, size=(9, 3)).astype(float)
    monkeypatch.setattr(knn, "BLOCK_CELLS", 9 * 16)
    nothing = {n: None for n in ("exclude_id", "sort_by", "ascending", "price_min", "price_max", "min_points", "variety", "country")}
    asked = pa.array([{"query_id": i, "vector": q.tolist(), "fetch": 5, **nothing} for i, q in enumerate(queries)])
    best = knn._Best(asked, cosine=False)
    order = rng.permutation(500)
    best.take(pa.RecordBatch.from_pydict({
        "item_id": order, "embedding": vectors[order].tolist(), "price": [None] * 500, "points": [None] * 500,
        "variety": [None] * 500, "country": [None] * 500,
    }))
    got = {}
    for q, item in zip(best.kept.query, best.kept.item):
        got.setdefault(int(q), []).append(int(item))
    assert got == brute_force(vectors, queries, 5)


def test_similar_items_and_search(spark, catalogue, items, encoder):
    titles = small_table(spark, "query_id long, title string", [(0, NAME), (1, "no such title")])
    found = neighbours_of_titles(items, titles, top_n=1).orderBy("position").collect()
    assert [(r.query_id, r.item_id) for r in found] == [(0, 0), (0, 1)]
    hashed = similar_items(catalogue, HashEncoder(16), titles, top_n=2)
    assert hashed.count() == 3
    top = search_text(items, encoder, small_table(spark, "query_id long, text string", [(0, "the dearest")]), top_k=1)
    assert ids(top) == [3]


def test_model_encoder_skips_missing_texts(spark):
    def load():
        def model(texts):
            assert all(t is not None for t in texts)
            return np.array([[len(t), 1.0, 0.0] for t in texts], dtype="float32")

        return model

    rows = small_table(spark, "id long, text string", [(0, "abc"), (1, None), (2, "")])
    got = {r.id: r.v for r in ModelEncoder(load, 3).encode(rows, "text", "v").collect()}
    assert got[1] is None
    assert np.allclose(got[0], np.array([3, 1, 0]) / np.sqrt(10)) and np.allclose(got[2], [0, 1, 0])


def test_scoring_code_travels_with_the_tasks(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from shelfwise.operators import knn

    (tmp_path / "code").write_bytes(cloudpickle.dumps(knn._Best))
    load = "import pickle, sys; pickle.load(open('code', 'rb')); assert not any('shelfwise' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", load], cwd=tmp_path, check=True, timeout=60)


def test_requests_without_or_with_equal_ids(spark, items, encoder):
    rec = Recommender(items, encoder)
    rows = small_table(spark, "query_id long, query string, top_k int", [(0, "0 + a bargain", 2), (0, "2 + a bargain", 2), (None, "1", 1), (None, "0", 1)])
    got = rec.recommend_keyed(rows).collect()
    by = {}
    for r in got:
        by.setdefault(r.request, []).append(r.rank)
    assert sorted(map(len, by.values())) == [1, 1, 2, 2] and all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    assert rec.recommend(rows.drop("query_id")).count() == 6


def test_no_rows_asked_for_next_to_a_filter(spark, items, encoder):
    rows = small_table(spark, "query_id long, query string, top_k int", [(0, "0 + under 60", 0), (1, "zzz + under 60", 0)])
    assert Recommender(items, encoder).recommend(rows).count() == 0


@pytest.mark.parametrize(
    "pattern, text",
    [("Cold (Brand#12)", ["cold brand#12"]), ("(old|new) g.ar", ["old", "new"]), ("a+bcd", ["bcd"]), ("x{0,3}Hello", ["hello"]),
     ("[", None), ("(unclosed", ["(unclosed"]), ("abc?d", ["ab"]), ("(?i)ABC", ["abc"]), ("ñandú cafe", [" cafe"]), ("", None),
     ("(?:rot|wei(?:ss|n)?|b.a) x", [" x"]), ("(red|.)", None), ("^(20|19)[0-9]{2}$", ["20", "19"]), ("(ab|cd){2,}?e", ["ab", "cd"]),
     ("(ab|cd)*e", None), (r"\d\d", None)],
)
def test_text_that_a_pattern_needs(pattern, text):
    found = resolve.any_of(resolve.sre.parse(resolve.compiled(pattern).pattern, re.IGNORECASE))
    assert found == text


def test_patterns_are_run_where_the_text_they_need_is(spark, monkeypatch):
    titles = ["Cold (Brand#12)", "cold brand#12", "ſun King", "plain", None]
    items = small_table(spark, "item_id long, title string", list(enumerate(titles)))
    asked = ["Cold (Brand#12)", "sun (king)", "(plain)", "[a-z]lain", "(unclosed", "(no such)", "(king|plain)$", "BRAND", "^.{5}$"]
    wanted = small_table(spark, "identifier string", [(a,) for a in asked])
    got = {r.identifier: r.item_id for r in resolve.first_title_match(items, wanted).collect()}
    want = {"Cold (Brand#12)": 1, "sun (king)": 2, "(plain)": 3, "[a-z]lain": 3, "(king|plain)$": 2, "BRAND": 0, "^.{5}$": 3}
    assert got == want
    monkeypatch.setattr(resolve, "NEEDLE_BYTES", 40)  # many passes give the same
    assert {r.identifier: r.item_id for r in resolve.first_title_match(items, wanted).collect()} == want


def test_only_titles_that_a_pattern_can_match_are_tested(spark, monkeypatch):
    titles = [(i, f"name {i} {'merlot' if i % 50 == 0 else 'other'} 20{i % 100:02d}") for i in range(1, 1001)]
    items = small_table(spark, "item_id long, title string", titles)
    wanted = small_table(spark, "identifier string", [("(merlot|malbec) 20[5-9].",), ("zzz+ (merlot)",)])
    log = new_path(spark, "tested")
    real = resolve.compiled

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.run = pattern, real(pattern)

        def search(self, title):
            with open(log, "a") as out:
                out.write(title + "\n")
            return self.run.search(title)

    monkeypatch.setattr(resolve, "compiled", Counted)
    found = resolve._lowest_matches(items, checkpointed(wanted.select(
        "identifier", F.lower("identifier").alias("low"), F.lit(True).alias("is_pattern"),
        F.when(F.col("identifier").startswith("("), F.array(F.lit("merlot"), F.lit("malbec"))).otherwise(F.array(F.lit("merlot"))).alias("texts"),
    )))
    assert {r.identifier: r.item_id for r in found.groupBy("identifier").agg(F.min("item_id").alias("item_id")).collect()} == {
        "(merlot|malbec) 20[5-9].": 50
    }
    with open(log) as lines:
        assert all("merlot" in line for line in lines)


def test_bounds_that_all_queries_share_reach_the_items(spark, items):
    kinds = "query_id long, vector array<double>, fetch int, filters struct<price_min:double,price_max:double,variety:string,country:string,min_points:int>"
    to = [0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(0, to, 2, {"price_max": 20.0}), (1, to, 2, {"price_max": 30.0, "min_points": 90})]
    queries = spark.createDataFrame(rows, kinds)
    found = nearest(items, queries)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert re.search(r"price#\d+ <= (cast\()?30\.0", plan) and not re.search(r"points#\d+ >=", plan)
    assert {(r.query_id, r.item_id) for r in found.collect()} == {(0, 0), (0, 4), (1, 1)}


def test_needles_are_found_like_by_containment():
    from shelfwise.operators.automaton import Needles

    rng = np.random.default_rng(1)
    needles = {"".join(rng.choice(list("ab"), n)) for n in (1, 2, 3, 5, 8, 9, 12) for _ in range(n + 3)} | {"", "é", "bé a"}
    finder = Needles(needles)
    for n in (0, 1, 2, 7, 8, 30, 200):
        text = "".join(rng.choice(list("abbé "), n))
        assert sorted(finder.found(text)) == sorted(x for x in needles if x and x in text)


def test_many_identifiers_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    n = 40_000
    names = [f"{i * 7919 % 1_000_003:06d} vineyard reserve {i}" for i in range(n)]
    needs = pa.StructArray.from_arrays(
        [pa.array(names), pa.array(names), pa.array([False] * n), pa.array([[x] for x in names])], ["identifier", "low", "is_pattern", "texts"]
    )
    tracemalloc.start()
    held = resolve._Needs(needs)
    used, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [n for n, _ in held.candidates("xx " + names[77] + " yy")] == [77]
    assert used < 600 * n and peak < 900 * n
