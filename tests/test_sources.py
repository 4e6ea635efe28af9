import csv
import json
import os
import random

import pytest

from shelfwise.operators.encode import HashEncoder
from shelfwise.operators.resolve import all_known_values
from shelfwise.plans.clean import clean_catalogue
from shelfwise.plans.model import build_model, load_model
from shelfwise.plans.recommend import Recommender
from shelfwise.session import checkpointed, new_path, shared_dir, small_table
from shelfwise.sources import catalogue as files
from shelfwise.streaming.serve import request_stream, serve

CSV = (
    ",country,description,designation,points,price,province,region_1,region_2,taster_name,taster_twitter_handle,"
    "title,variety,winery\n"
    '0,US,"Two\nlines, ""quoted""",N/A,90,25.0,California,,NULL,nan,@a,Title One,Merlot,W\n'
    "1,None,  padded  ,,abc,NaN,null,#N/A,x,NA,-nan,Title Two,<NA>,W\n"
)


def test_csv_scan_reads_null_tokens_and_line_breaks(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(CSV, encoding="utf-8")
    first, second = files.read_reviews_csv(spark, str(tmp_path / "raw.csv")).orderBy("src_row").collect()
    assert first.description == 'Two\nlines, "quoted"'
    assert (first.designation, first.region_1, first.region_2, first.taster_name) == (None,) * 4
    assert (first.points, first.price) == (90, 25.0)
    assert second.description == "  padded  "
    assert (second.country, second.points, second.price, second.province, second.variety) == (None,) * 5


def test_clean_csv_round_trip(spark, raw_reviews):
    clean = clean_catalogue(raw_reviews)
    path = new_path(spark, "test-clean")
    files.write_csv(clean, path)
    again = files.read_clean_csv(spark, path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, clean.collect()))


def test_model_is_built_and_loaded(spark, raw_reviews):
    directory = new_path(spark, "test-model")
    build_model(clean_catalogue(raw_reviews), HashEncoder(32), directory, "hashed-words")
    model = load_model(spark, directory)
    assert model.manifest.first().asDict() == {"model_name": "hashed-words", "num_items": 3, "embedding_dim": 32}
    assert {(r.kind, r.value) for r in model.known.collect()} == {
        ("country", "ireland"), ("country", "wales"), ("variety", "cider"), ("variety", "perry"), ("variety", "cabernet sauvignon"),
    }
    request = small_table(spark, "query_id long, query string", [(0, "harbour + pear and perry")])
    assert [r.item_id for r in model.recommender(HashEncoder(32)).recommend(request).collect()] == [1]


def test_requests_and_results_as_json(spark, tmp_path):
    lines = [{"query_id": 1, "query": "a"}, {"query_id": 2, "query": "b", "top_k": 9, "filters": {"country": "US"}}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    got = files.read_requests(spark, str(tmp_path / "r.json")).orderBy("query_id").collect()
    assert (got[0].top_k, got[0].filters) == (5, None)
    assert (got[1].top_k, got[1].filters.country, got[1].filters.price_min) == (9, "US", None)
    texts = small_table(spark, "body string", [(json.dumps(line),) for line in lines])
    assert sorted(files.parse_requests_json(texts, "body").collect()) == sorted(got)
    out = str(tmp_path / "out")
    files.write_results(small_table(spark, "query_id long, rank int", [(1, 1)]), out)
    assert spark.read.json(out).first().asDict() == {"query_id": 1, "rank": 1}


def test_stream_answers_every_request_once(spark, items, encoder, tmp_path):
    inbox, out, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    recommender = Recommender(items, encoder, blend_weight=0.6)

    def send(query_id, query):
        small_table(spark, "query_id long, query string", [(query_id, query)]).coalesce(1).write.mode("append").json(inbox)

    def answered():
        serve(recommender, request_stream(spark, inbox, max_files=1), out, progress).awaitTermination()
        rows = spark.read.parquet(out).collect()
        return sorted((r.query_id, r.rank, r.item_id) for r in rows)

    send(0, "Millstone Perry 2018")
    send(1, "0 + mead")
    first = [(0, 1, 0), (0, 2, 1), (0, 3, 4), (0, 4, 3), (1, 1, 3)]
    assert answered() == first
    send(2, "0 + under 20")
    assert answered() == first + [(2, 1, 4)]


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "other.csv").write_text("title,winery,price,points,country,description,designation,province,region_1,region_2,"
                                        "taster_name,taster_twitter_handle,variety,extra\nT1,W1,10,90,US,\"a, b\",,P,R,,,,V,x\n")
    row = files.read_reviews_csv(spark, str(tmp_path / "other.csv")).first()
    assert (row.title, row.winery, row.price, row.points, row.country, row.description) == ("T1", "W1", 10.0, 90, "US", "a, b")
    assert row.designation is None and row.src_row == 0
    (tmp_path / "short.csv").write_text("title,price\nT,1\n")
    with pytest.raises(ValueError, match="winery"):
        files.read_reviews_csv(spark, str(tmp_path / "short.csv"))


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_quoted_file_is_read_by_several_tasks(spark, tmp_path, ending):
    rnd = random.Random(ending)
    pool = ["plain", "", "two\nlines", 'a "quoted" word', '"', "comma, here", "\n\n\n", " edge ", "é\n\"\n", "x" * 300, ("long\n" * 60).strip()]
    rows = [[str(i), *rnd.choices(pool, k=3)] for i in range(1500)]
    rows[700][2] = "deep\n" * 4000  # a cell over several splits
    for name, part in (("a.csv", rows[:1100]), ("b.csv", rows[1100:])):
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator=ending)
            writer.writerow(["n", "a", "b", "c"])
            writer.writerows(part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files._by_header(spark, str(tmp_path), files._CSV)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["own row"] for r in got}) == 1500
    want = spark.read.options(**files._CSV).csv(str(tmp_path)).collect()
    assert sorted((r.n, r.a, r.b, r.c) for r in got if r.n == "700") == sorted((r.n, r.a, r.b, r.c) for r in want if r.n == "700")
    assert sorted(map(repr, ((r.n, r.a, r.b, r.c) for r in got))) == sorted(map(repr, ((r.n, r.a, r.b, r.c) for r in want)))


def test_files_of_one_folder_share_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,a\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text("n,b\n1,z\n")
    with pytest.raises(ValueError, match="headers"):
        files._by_header(spark, str(tmp_path), files._CSV)


BAD_LINES = ['{"query_id": 1, "query": "a", "top_k": "many"}', "not json", '{"query_id": 2', "[1]", '{"query_id": 3}', '{"query": null}']


def test_bad_request_lines_are_reported(spark, tmp_path):
    good = ['{"query_id": 7, "query": "x", "filters": {"price_max": 3}}', '{"query": ""}']
    (tmp_path / "r.json").write_text("\n".join([good[0], *BAD_LINES, "", good[1]]))
    rejects = str(tmp_path / "rejects")
    got = files.read_requests(spark, str(tmp_path / "r.json"), rejects).collect()
    assert sorted((r.query_id or 0, r.query, r.top_k) for r in got) == [(0, "", 5), (7, "x", 5)]
    found = {r.line: r.problem for r in spark.read.parquet(rejects).collect()}
    assert found == {line: "no query" if line in BAD_LINES[4:] else "malformed" for line in BAD_LINES}


def test_a_stream_keeps_bad_lines_and_no_intermediate_tables(spark, items, encoder, tmp_path):
    def held():
        return sum(len(names) for _, _, names in os.walk(shared_dir(spark)))

    inbox, out, progress, rejects = (tmp_path / p for p in ("in", "out", "progress", "rejects"))
    inbox.mkdir()
    for i in range(3):
        (inbox / f"{i}.json").write_text('{"query_id": %d, "query": "0 + mead"}\n%s\n' % (i, BAD_LINES[i]))
    recommender = Recommender(items, encoder, known=checkpointed(all_known_values(items)))
    before = held()
    serve(recommender, request_stream(spark, str(inbox), max_files=1), str(out), str(progress), str(rejects)).awaitTermination()
    assert held() == before
    assert sorted(r.query_id for r in spark.read.parquet(str(out)).collect()) == [0, 1, 2]
    assert sorted(r.line for r in spark.read.parquet(str(rejects)).collect()) == sorted(BAD_LINES[:3])
