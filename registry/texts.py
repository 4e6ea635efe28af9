"""Cleaning projections and display columns."""

from pyspark.sql import functions as F

from registry import query
from registry import sqltext as q
from registry.bindings import CAT_SQL, RAW_SQL, cat, raw, table
from registry.search import LABEL_TOP_SQL, label_top
from shelfwise.functions import present, text
from shelfwise.operators import cleaning
from shelfwise.session import spread
from shelfwise.operators.filters import with_ids
from shelfwise.vocab import COUNTRY_OVERRIDES, RED_VARIETIES, STYLE_WORDS, TEXT_COLUMNS, WHITE_VARIETIES


@query("b1_collapse_space", f"SELECT doc_id, {q.collapse('text')} AS text FROM documents")
def _(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", text.collapse_space("text").alias("text"))


@query(
    "b1_clean_text_columns",
    f"SELECT src_row, points, price, {', '.join(f'{q.clean(c)} AS {c}' for c in TEXT_COLUMNS)} FROM ({RAW_SQL})",
)
def _(spark, sf):
    return cleaning.clean_text_columns(raw(spark, sf, wide=True))


# Each text is first damaged the way a wrong decode damages it.
@query("b2_repair_encoding", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    docs = spread(table(spark, sf, "documents")).select("doc_id", damaged.alias("text"))
    return docs.select("doc_id", text.repair_encoding("text").alias("text"))


# The damage of a Windows decode: the bytes from 80 to 9F become its signs, the five it lacks stay control codes.
@query("b2_repair_windows_encoding", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    misread = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), text._C1, text._CP1252)
    docs = spread(table(spark, sf, "documents")).select("doc_id", misread.alias("text"))
    return docs.select("doc_id", text.repair_encoding("text").alias("text"))


@query("b2_repair_typography", f"SELECT src_row, {q.repair_typography('description')} AS description FROM ({RAW_SQL})")
def _(spark, sf):
    return raw(spark, sf, wide=True).select("src_row", text.repair_typography("description").alias("description"))


@query("b3_drop_unencodable", "SELECT page_id, html FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.drop_unencodable("html").alias("html"))


# Bytes that are not UTF-8 before, within and after each page: a stray one, an overlong start, half a character.
@query("b3_drop_bad_bytes", "SELECT page_id, html FROM pages")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    half = (F.length("html") / 2).cast("int")
    first = F.substring("html", F.lit(1), half)
    rest = F.substring("html", half + 1, F.length("html"))
    bad = [F.unhex(F.lit(h)) for h in ("FF80", "C0", "E282")]
    parts = [bad[0], first.cast("binary"), bad[1], rest.cast("binary"), bad[2]]
    damaged = pages.select("page_id", F.concat(*parts).cast("string").alias("html"))
    return damaged.select("page_id", text.drop_unencodable("html").alias("html"))


_STRINGS = TEXT_COLUMNS


@query(
    "b4_nan_text_to_null",
    f"SELECT src_row, {', '.join(f'''nullif({c}, 'nan') AS {c}''' for c in _STRINGS)} FROM ({RAW_SQL})",
)
def _(spark, sf):
    return cleaning.nan_text_to_null(raw(spark, sf).select("src_row", *_STRINGS))


@query(
    "b5_remove_odd_characters",
    f"SELECT src_row, {', '.join(f'{q.remove_odd(c)} AS {c}' for c in TEXT_COLUMNS)} FROM ({RAW_SQL})",
)
def _(spark, sf):
    return cleaning.remove_odd_characters(raw(spark, sf, wide=True)).select("src_row", *TEXT_COLUMNS)


_KEPT = (
    "src_row, country, description, points, price, province, region_1, taster_name, title, variety, winery"
)


@query("b6_drop_unused_columns", f"SELECT {_KEPT} FROM ({RAW_SQL})")
def _(spark, sf):
    return cleaning.drop_unused(raw(spark, sf))


@query("b7_rename_region", f"SELECT src_row, region_1 AS region FROM ({RAW_SQL})")
def _(spark, sf):
    return raw(spark, sf).withColumnRenamed("region_1", "region").select("src_row", "region")


@query(
    "b8_final_columns",
    f"SELECT src_row AS item_id, country, title, description, variety, province, region_1 AS region, winery, "
    f"price, points, taster_name FROM ({RAW_SQL})",
)
def _(spark, sf):
    from shelfwise.plans.clean import EXPLORATORY_COLUMNS

    renamed = raw(spark, sf).withColumnsRenamed({"src_row": "item_id", "region_1": "region"})
    return renamed.select(*EXPLORATORY_COLUMNS)


@query(
    "b9_lower_text",
    f"SELECT src_row, points, price, {', '.join(f'lower({c}) AS {c}' for c in TEXT_COLUMNS)} FROM ({RAW_SQL})",
)
def _(spark, sf):
    return cleaning.lower_text(raw(spark, sf))


@query("b10_text_corpus", f"SELECT src_row, {q.corpus()} AS text_corpus FROM ({RAW_SQL})")
def _(spark, sf):
    return cleaning.add_text_corpus(raw(spark, sf)).select("src_row", "text_corpus")


@query("b12_fill_variety", f"SELECT src_row, coalesce(variety, 'Cabernet Sauvignon') AS variety FROM ({RAW_SQL})")
def _(spark, sf):
    return cleaning.fill_variety(raw(spark, sf)).select("src_row", "variety")


@query("b13_fill_region", f"SELECT src_row, {q.region_fill()} AS region_1 FROM ({RAW_SQL})")
def _(spark, sf):
    return cleaning.fill_region(raw(spark, sf)).select("src_row", "region_1")


@query(
    "b14_fill_province",
    f"SELECT src_row, coalesce(province, region_1, 'unknown') AS province FROM ({RAW_SQL})",
)
def _(spark, sf):
    return cleaning.fill_province(raw(spark, sf)).select("src_row", "province")


@query("b15_fill_taster", f"SELECT src_row, coalesce(taster_name, 'unknown') AS taster_name FROM ({RAW_SQL})")
def _(spark, sf):
    return cleaning.fill_taster(raw(spark, sf)).select("src_row", "taster_name")


@query(
    "b16_result_columns",
    f"SELECT item_id, title, variety, country, points, price, description FROM ({CAT_SQL})",
)
def _(spark, sf):
    from shelfwise.plans.explore import SIMILAR_COLUMNS

    return cat(spark, sf).select("item_id", *SIMILAR_COLUMNS)


@query("b17_description_or_empty", f"SELECT src_row, coalesce(description, '') AS description FROM ({RAW_SQL})")
def _(spark, sf):
    return raw(spark, sf).select("src_row", F.coalesce("description", F.lit("")).alias("description"))


# Varieties for S8: the part types, with grape names and markers mixed in.
_VARIETY = (
    "CASE p_partkey % 8 WHEN 0 THEN concat(' Pinot Noir ', p_type) WHEN 1 THEN 'Rosé de ' || p_type "
    "WHEN 2 THEN 'Sparkling Blanc' WHEN 3 THEN concat(p_type, ' Vino Bianco') WHEN 4 THEN 'Noirette' "
    "WHEN 5 THEN NULL WHEN 6 THEN 'Tinta-' || p_name ELSE "
    "CASE p_size % 9 WHEN 0 THEN 'Gamay' WHEN 1 THEN 'BARBERA d''Asti' WHEN 2 THEN 'Albariño' WHEN 3 THEN 'Pinot Meunier' "
    "WHEN 4 THEN 'Mourvèdre-Syrah' WHEN 5 THEN 'Müller-Thurgau' WHEN 6 THEN 'Loureiro-Arinto' WHEN 7 THEN 'Gamayo' "
    "ELSE p_type END END"
)


def _style_sql(v: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({q.strip(f'lower({v})')}, {q.lit(present.any_word_pattern(words))}) THEN {q.lit(style)}"
        for style, words in STYLE_WORDS.items()
    )
    return f"CASE {arms} ELSE 'other' END"


@query(
    "s8_style_category",
    f"SELECT p_partkey, variety, {_style_sql('variety')} AS style FROM (SELECT p_partkey, {_VARIETY} AS variety FROM part)",
)
def _(spark, sf):
    named = table(spark, sf, "part").selectExpr("p_partkey", f"{_VARIETY} AS variety")
    return named.select("p_partkey", "variety", present.style_category(F.col("variety")).alias("style"))


_RATING = (
    "CASE WHEN points IS NULL THEN NULL WHEN points >= 95 THEN 5 WHEN points >= 90 THEN 4 "
    "WHEN points >= 87 THEN 3 WHEN points >= 84 THEN 2 ELSE 1 END"
)


@query("s9_rating_bucket", f"SELECT src_row, points, {_RATING} AS rating FROM ({RAW_SQL})")
def _(spark, sf):
    return raw(spark, sf).select("src_row", "points", present.rating_bucket(F.col("points")).alias("rating"))


@query("s10_title_case", f"SELECT doc_id, {q.title_case('text')} AS text FROM documents")
def _(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", present.title_case(F.col("text")).alias("text"))


def _country_sql(c: str) -> str:
    key = q.strip(f"lower({c})")
    arms = " ".join(f"WHEN {key} = {q.lit(k)} THEN {q.lit(v)}" for k, v in COUNTRY_OVERRIDES.items())
    return f"CASE {arms} ELSE {q.title_case(c)} END"


_NATION = "CASE n_nationkey % 5 WHEN 0 THEN ' us' WHEN 1 THEN 'Uk ' WHEN 2 THEN 'UAE' ELSE n_name END"


@query(
    "s11_country_case",
    f"SELECT c_custkey, {_country_sql('country')} AS country FROM (SELECT c_custkey, {_NATION} AS country "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey)",
)
def _(spark, sf):
    nations = F.broadcast(table(spark, sf, "nation").selectExpr("n_nationkey", f"{_NATION} AS country"))
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.select("c_custkey", present.country_case(F.col("country")).alias("country"))


def _sentence_sql(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({c}, '. '), "
        f"lambda s: CASE WHEN substr(s, 1, 1) = 'ß' THEN 'SS' ELSE upper(substr(s, 1, 1)) END || substr(s, 2)), '. ')"
    )


@query("s12_sentence_case", f"SELECT doc_id, {_sentence_sql('lower(text)')} AS text FROM documents")
def _(spark, sf):
    lowered = F.lower("text")
    return spread(table(spark, sf, "documents")).select("doc_id", present.sentence_case(lowered).alias("text"))


def _price_sql(c: str) -> str:
    return f"coalesce(format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT)), '?')"


@query("s13_price_label", f"SELECT src_row, {_price_sql('price')} AS price_label FROM ({RAW_SQL})")
def _(spark, sf):
    return raw(spark, sf).select("src_row", present.price_label(F.col("price")).alias("price_label"))


@query(
    "s13_price_label_large",
    f"SELECT o_orderkey, {_price_sql('o_totalprice')} AS price_label FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", present.price_label(F.col("o_totalprice")).alias("price_label"))


_MATCH = "concat(CAST(round_even({} * 100, 0) AS BIGINT), '%')"


@query(
    "s14_match_label",
    f"SELECT l_orderkey, l_linenumber, {_MATCH.format('l_discount')} AS match_label FROM lineitem",
)
def _(spark, sf):
    label = present.match_label(F.col("l_discount")).alias("match_label")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", label)


@query(
    "s16_presentation_table",
    f"SELECT query_id, position AS rank, item_id, {_style_sql('variety')} AS style, {_RATING} AS rating, "
    f"{q.title_case('title')} AS title, {q.title_case('variety')} AS variety, {_country_sql('country')} AS country, "
    f"{_sentence_sql('description')} AS description, {_price_sql('price')} AS price_label, "
    f"{_MATCH.format('similarity')} AS match_label FROM ({CAT_SQL}) JOIN ({LABEL_TOP_SQL}) USING (item_id)",
)
def _(spark, sf):
    found = label_top(spark, sf).withColumnRenamed("position", "rank")
    return present.present(with_ids(cat(spark, sf).drop("embedding"), found))


_STANDARD = ", ".join(f"({q.lit(v)})" for v in sorted(set(RED_VARIETIES) | set(WHITE_VARIETIES)))


@query(
    "s17_variety_dimension",
    f"SELECT c.variety, d.display, d.value IS NOT NULL AS is_standard, c.row_count FROM ("
    f"SELECT lower(v) AS variety, count(*) AS row_count FROM ("
    f"SELECT CASE WHEN p_size % 2 = 0 THEN 'Pinot Noir' WHEN p_size % 3 = 0 THEN 'White Blend' ELSE p_type END AS v FROM part"
    f") GROUP BY 1) c LEFT JOIN (SELECT value, {q.title_case('value')} AS display FROM (VALUES {_STANDARD}) s(value)) d "
    f"ON d.value = c.variety",
)
def _(spark, sf):
    named = table(spark, sf, "part").selectExpr(
        "lower(CASE WHEN p_size % 2 = 0 THEN 'Pinot Noir' WHEN p_size % 3 = 0 THEN 'White Blend' ELSE p_type END) AS variety"
    )
    counted = named.groupBy("variety").agg(F.count(F.lit(1)).alias("row_count"))
    return present.flag_standard(counted).select("variety", "display", "is_standard", "row_count")
