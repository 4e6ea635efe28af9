"""Row filters, deduplication, keys, the producer rule and the two full cleans."""

from pyspark.sql import functions as F

from registry import query
from registry import sqltext as q
from registry.bindings import RAW_SQL, cat, raw, table, CAT_SQL
from shelfwise.operators import cleaning, dedup, filters, keys
from shelfwise.plans.clean import clean_catalogue, clean_catalogue_exploratory
from shelfwise.schemas import RAW
from shelfwise.vocab import TEXT_COLUMNS

_RAW_COLUMNS = ", ".join(RAW.names)


def _first(source: str, keys_: str) -> str:
    return (
        f"SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY {keys_} ORDER BY src_row) AS nth "
        f"FROM ({source})) WHERE nth = 1"
    )


@query("c1_drop_without_price", f"SELECT {_RAW_COLUMNS} FROM ({RAW_SQL}) WHERE price IS NOT NULL")
def _(spark, sf):
    return cleaning.drop_without_price(raw(spark, sf))


@query(
    "d1_override_country",
    f"SELECT src_row, winery, coalesce(rule_country, country) AS country FROM ({RAW_SQL}) "
    f"LEFT JOIN {q.winery_rules()} USING (winery)",
)
def _(spark, sf):
    return cleaning.override_country(raw(spark, sf)).select("src_row", "winery", "country")


@query("w1_first_per_title", _first(RAW_SQL, "title"))
def _(spark, sf):
    return dedup.keep_first(raw(spark, sf), ["title"])


@query("w2_first_per_title_and_text", _first(RAW_SQL, "title, description"))
def _(spark, sf):
    return dedup.keep_first(raw(spark, sf), ["title", "description"])


_PAIRS = f"SELECT src_row, winery, lower(coalesce(description, 'none')) AS whole FROM ({RAW_SQL})"


@query(
    "w3_duplicate_members",
    f"SELECT src_row, winery, whole FROM (SELECT *, count(*) OVER (PARTITION BY winery, whole) AS n FROM ({_PAIRS})) WHERE n > 1",
)
def _(spark, sf):
    whole = F.lower(F.coalesce("description", F.lit("none"))).alias("whole")
    return dedup.duplicate_members(raw(spark, sf).select("src_row", "winery", whole), ["winery", "whole"])


@query(
    "w3_duplicate_texts",
    "SELECT doc_id, lang, source FROM (SELECT *, count(*) OVER (PARTITION BY text, lang) AS n FROM documents) WHERE n > 1",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return dedup.duplicate_members(docs, ["text", "lang"]).select("doc_id", "lang", "source")


@query(
    "e4_rows_removed_by_title",
    f"SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) - count(*) AS BIGINT) AS rows_removed "
    f"FROM (SELECT title, count(*) AS n FROM ({RAW_SQL}) GROUP BY title)",
)
def _(spark, sf):
    return dedup.duplicates_removed(raw(spark, sf), ["title"])


@query(
    "e4_rows_removed_by_title_and_text",
    f"SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(n) - count(*) AS BIGINT) AS rows_removed "
    f"FROM (SELECT title, description, count(*) AS n FROM ({RAW_SQL}) GROUP BY title, description)",
)
def _(spark, sf):
    return dedup.duplicates_removed(raw(spark, sf), ["title", "description"])


@query(
    "b11_dense_key",
    f"SELECT row_number() OVER (ORDER BY src_row) - 1 AS item_id, src_row, title FROM ({_first(RAW_SQL, 'title')})",
)
def _(spark, sf):
    first = dedup.keep_first(raw(spark, sf).select("src_row", "title"), ["title"])
    return keys.with_dense_key(first, span=64)


@query(
    "b11_null_order_key",
    "SELECT row_number() OVER (ORDER BY k NULLS LAST) - 1 AS item_id, k FROM (SELECT CASE WHEN l_linenumber < 5 THEN l_orderkey * 8 + l_linenumber END AS k FROM lineitem)",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("CASE WHEN l_linenumber < 5 THEN l_orderkey * 8 + l_linenumber END AS k")
    return keys.with_dense_key(lines, order="k", span=1 << 14)


@query(
    "b11_dense_key_lineitem",
    "SELECT row_number() OVER (ORDER BY k) - 1 AS item_id, k FROM (SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem)",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS k")
    return keys.with_dense_key(lines, order="k", span=1 << 14)


@query("c2_price_at_least", f"SELECT item_id, price FROM ({CAT_SQL}) WHERE price >= 905")
def _(spark, sf):
    return filters.apply_filters(cat(spark, sf), price_min=905.0).select("item_id", "price")


@query("c3_price_at_most", f"SELECT item_id, price FROM ({CAT_SQL}) WHERE price <= 915.5")
def _(spark, sf):
    return filters.apply_filters(cat(spark, sf), price_max=915.5).select("item_id", "price")


@query(
    "c4_variety_equals",
    "SELECT p_partkey, variety FROM (SELECT p_partkey, concat(' ', p_type, ' ') AS variety FROM part) "
    "WHERE lower(trim(variety)) = 'economy'",
)
def _(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey", "concat(' ', p_type, ' ') AS variety")
    return filters.apply_filters(parts, variety=" Economy ")


@query(
    "c5_country_equals",
    "SELECT doc_id, country FROM (SELECT doc_id, concat(upper(lang), ' ') AS country FROM documents) WHERE lower(trim(country)) = 'fr'",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id", "concat(upper(lang), ' ') AS country")
    return filters.apply_filters(docs, country="Fr")


@query("c6_points_at_least", f"SELECT src_row, points FROM ({RAW_SQL}) WHERE points >= 92")
def _(spark, sf):
    return filters.apply_filters(raw(spark, sf), min_points=92).select("src_row", "points")


@query("c9_exclude_item", f"SELECT item_id, title FROM ({CAT_SQL}) WHERE item_id <> 7")
def _(spark, sf):
    return filters.exclude_item(cat(spark, sf), 7).select("item_id", "title")


@query("c11_item_by_id", f"SELECT item_id, title, price FROM ({CAT_SQL}) WHERE item_id = 11")
def _(spark, sf):
    return filters.by_id(cat(spark, sf), 11).select("item_id", "title", "price")


@query(
    "c11_look_up_ids",
    f"SELECT w.item_id, c.title, c.price, c.item_id IS NOT NULL AS found FROM (SELECT doc_id AS item_id FROM labels) w "
    f"LEFT JOIN ({CAT_SQL}) c ON c.item_id = w.item_id",
)
def _(spark, sf):
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    found = filters.look_up(cat(spark, sf).select("item_id", "title", "price"), wanted)
    return found.select("item_id", "item.title", "item.price", F.col("item").isNotNull().alias("found"))


@query(
    "c12_first_with_title",
    f"SELECT title, min(item_id) AS item_id FROM ({CAT_SQL}) WHERE title IN (SELECT p_name FROM part) GROUP BY title",
)
def _(spark, sf):
    titles = table(spark, sf, "part").select(F.col("p_name").alias("title"))
    return filters.first_with_title(cat(spark, sf), titles)


@query(
    "c14_rows_with_missing",
    f"SELECT src_row, country, province, winery FROM ({RAW_SQL}) WHERE country IS NULL OR province IS NULL OR winery IS NULL",
)
def _(spark, sf):
    rows = raw(spark, sf).select("src_row", "country", "province", "winery")
    return filters.with_missing(rows, ["country", "province", "winery"])


@query("c15_values_where", f"SELECT DISTINCT province FROM ({RAW_SQL}) WHERE country = 'en'")
def _(spark, sf):
    return filters.values_where(raw(spark, sf), "country", "en", "province")


def _clean_sql(exploratory: bool) -> str:
    def cell(c: str) -> str:
        return q.remove_odd(q.clean(c)) if exploratory else q.clean(c)

    cleaned = (
        f"SELECT src_row, points, price, {', '.join(f'{cell(c)} AS {c}' for c in TEXT_COLUMNS)} FROM ({RAW_SQL})"
    )
    ruled = (
        f"SELECT * REPLACE (coalesce(rule_country, country) AS country) FROM "
        f"(SELECT * FROM ({_first(cleaned, 'title')}) WHERE price IS NOT NULL) LEFT JOIN {q.winery_rules()} USING (winery)"
    )
    filled = (
        f"SELECT * REPLACE (coalesce(variety, 'Cabernet Sauvignon') AS variety, "
        f"{q.region_fill()} AS region_1, coalesce(taster_name, 'unknown') AS taster_name) FROM ({ruled})"
    )
    filled = f"SELECT * REPLACE (coalesce(province, region_1, 'unknown') AS province) FROM ({filled})"
    texts = ("country", "description", "province", "taster_name", "title", "variety", "winery")
    out = (
        f"SELECT row_number() OVER (ORDER BY src_row) - 1 AS item_id, points, price, lower(region_1) AS region, "
        f"{', '.join(f'lower({c}) AS {c}' for c in texts)}"
    )
    if not exploratory:
        out += f", lower({q.corpus()}) AS text_corpus"
    return f"{out} FROM ({filled})"


CLEAN_SQL = _clean_sql(False)


@query("p1_clean_catalogue", CLEAN_SQL)
def _(spark, sf):
    return clean_catalogue(raw(spark, sf, wide=True))


@query("p2_clean_catalogue_exploratory", _clean_sql(True))
def _(spark, sf):
    return clean_catalogue_exploratory(raw(spark, sf, wide=True))
