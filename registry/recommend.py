"""Request parsing, resolution, merging and the full recommendation plans."""

from pyspark.sql import functions as F

from registry import query
from registry import sqltext as q
from registry.bindings import CAT_SQL, REQUEST_SQL, cat, requests, table
from registry.search import ANCHORS_SQL, ENCODER, _TITLE_VALUES, title_requests
from shelfwise.functions import parse
from shelfwise.operators import filters as flt
from shelfwise.operators import resolve
from shelfwise.plans.explore import search_text, similar_items
from shelfwise.plans.recommend import Recommender, numbered
from shelfwise.session import new_path, small_table, spread
from shelfwise.sources import catalogue as files
from shelfwise.vocab import BLEND_WEIGHT, NO_FILTER_VALUES

# The hashed-word encoder scores lower than a language model would, so the
# sort-order phrases need a lower bar here.
THRESHOLD = 0.45

PARTS_SQL = q.request_parts(REQUEST_SQL)


@query("s1_split_query", f"SELECT query_id, identifier, modifier FROM ({PARTS_SQL})")
def _(spark, sf):
    text = F.col("query")
    return requests(spark, sf).select(
        "query_id", parse.identifier(text).alias("identifier"), parse.modifier(text).alias("modifier")
    )


def _number(name: str, rule):
    @query(name, f"SELECT query_id, {rule.__name__} FROM ({PARTS_SQL})")
    def _(spark, sf):
        value = rule(parse.modifier(F.col("query"))).alias(rule.__name__)
        return requests(spark, sf).select("query_id", value)


_number("s2_price_max", parse.price_max)
_number("s3_price_min", parse.price_min)
_number("s4_min_points", parse.min_points)


# Numbers past the largest integer, and a space that is not ASCII.
_POINTS = "CASE query_id % 3 WHEN 0 THEN concat(query_id, '99999999999 points') WHEN 1 THEN concat(query_id, ' points') ELSE concat(query_id, '+ POINTS') END"


@query(
    "s4_min_points_overflow",
    "SELECT query_id, CAST(CASE WHEN query_id % 3 = 0 THEN 2147483647 ELSE query_id END AS INT) AS min_points "
    f"FROM ({REQUEST_SQL})",
)
def _(spark, sf):
    asked = requests(spark, sf).selectExpr("query_id", f"{_POINTS} AS asked")
    return asked.select("query_id", parse.min_points(F.col("asked")).alias("min_points"))


@query("s5_id_wanted", f"SELECT query_id, id_wanted FROM ({PARTS_SQL})")
def _(spark, sf):
    wanted = parse.as_item_id(parse.identifier(F.col("query"))).alias("id_wanted")
    return requests(spark, sf).select("query_id", wanted)


KNOWN_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, {kind} AS value, min(item_id) AS first_id FROM ({CAT_SQL}) WHERE {kind} IS NOT NULL GROUP BY {kind}"
    for kind in ("country", "variety")
)


def detect_sql(parts: str) -> str:
    return f"""
      SELECT query_id, max(value) FILTER (WHERE kind = 'country') AS country,
             max(value) FILTER (WHERE kind = 'variety') AS variety
      FROM (SELECT query_id, kind, value, row_number() OVER (PARTITION BY query_id, kind ORDER BY length(value) DESC, first_id) AS n
            FROM ({parts}) p JOIN ({KNOWN_SQL}) k ON value <> '' AND contains(lower(modifier), lower(value)))
      WHERE n = 1 GROUP BY query_id
    """


@query("d5_known_values", detect_sql(PARTS_SQL))
def _(spark, sf):
    split = parse.split_query(requests(spark, sf))
    return resolve.detect_values(split, resolve.all_known_values(cat(spark, sf)))


@query("g5_longest_value_first", f"SELECT kind, value, first_id, length(value) AS chars FROM ({KNOWN_SQL})")
def _(spark, sf):
    known = resolve.all_known_values(cat(spark, sf)).withColumn("chars", F.length("value").cast("long"))
    return known.orderBy("kind", F.desc("chars"), "first_id")


def classify_sql(parts: str) -> str:
    texts = f"SELECT query_id, nullif(modifier, '') AS text FROM ({parts})"
    return f"""
      SELECT query_id, sort_by, ascending FROM (
        SELECT m.query_id, a.sort_by, a.ascending, list_inner_product(a.vec, m.vec) AS score,
               row_number() OVER (PARTITION BY m.query_id ORDER BY list_inner_product(a.vec, m.vec) DESC, a.pos) AS n
        FROM ({q.encoded(texts, 'query_id')}) m, ({ANCHORS_SQL}) a)
      WHERE n = 1 AND score >= {THRESHOLD}
    """


@query(
    "w5_closest_anchor",
    f"SELECT p.query_id, c.sort_by, c.ascending FROM ({PARTS_SQL}) p LEFT JOIN ({classify_sql(PARTS_SQL)}) c USING (query_id)",
)
def _(spark, sf):
    split = parse.split_query(requests(spark, sf)).withColumn("text", F.nullif("modifier", F.lit("")))
    encoded = ENCODER.encode(split, "text", "modifier_vector")
    return resolve.classify_modifier(encoded, ENCODER, threshold=THRESHOLD).select("query_id", "sort_by", "ascending")


def parsed_sql(source: str) -> str:
    parts = q.request_parts(source)
    return f"""
      SELECT p.query_id, p.identifier, p.modifier, p.id_wanted, p.price_min, p.price_max, p.min_points, d.country, d.variety,
             c.sort_by, c.ascending, CASE WHEN c.sort_by IS NULL THEN nullif(p.modifier, '') END AS semantic_modifier
      FROM ({parts}) p LEFT JOIN ({detect_sql(parts)}) d USING (query_id)
      LEFT JOIN ({classify_sql(parts)}) c USING (query_id)
    """


@query(
    "s6_route_modifier",
    f"SELECT query_id, sort_by, ascending, semantic_modifier FROM ({parsed_sql(REQUEST_SQL)})",
)
def _(spark, sf):
    return _parsed(spark, sf).select("query_id", "sort_by", "ascending", "semantic_modifier")


def _parsed(spark, sf):
    known = resolve.all_known_values(cat(spark, sf))
    return resolve.parse_requests(spread(requests(spark, sf)), known, ENCODER, THRESHOLD)


@query(
    "s7_parse_query",
    f"SELECT query_id, identifier, id_wanted, price_min, price_max, min_points, country, variety, sort_by, ascending, "
    f"semantic_modifier FROM ({parsed_sql(REQUEST_SQL)})",
)
def _(spark, sf):
    return _parsed(spark, sf).select(
        "query_id", "identifier", "id_wanted", "parsed.*", "sort_by", "ascending", "semantic_modifier"
    )


def resolved_sql(parts: str) -> str:
    """``exclude_id`` per request: by id, or else the first title that matches."""
    return f"""
      SELECT p.query_id, p.identifier, coalesce(i.item_id, t.item_id) AS exclude_id FROM ({parts}) p
      LEFT JOIN ({CAT_SQL}) i ON i.item_id = p.id_wanted
      LEFT JOIN (SELECT identifier, min(item_id) AS item_id FROM (SELECT DISTINCT identifier FROM ({parts})) n
                 JOIN ({CAT_SQL}) c ON regexp_matches(c.title, n.identifier, 'i') GROUP BY 1) t ON t.identifier = p.identifier
    """


@query("d4_resolve_identifiers", resolved_sql(PARTS_SQL))
def _(spark, sf):
    split = parse.split_query(requests(spark, sf))
    found = resolve.resolve_items(cat(spark, sf), split, rows=split.count())
    return found.select("query_id", "identifier", "exclude_id")


# Patterns made from every nation's name, so that some need a pattern search.
_PATTERNS = "CASE n_nationkey % 3 WHEN 0 THEN concat('^', substr(lower(n_name), 1, 1)) WHEN 1 THEN lower(substr(n_name, 1, 2)) ELSE concat(substr(n_name, 2, 1), '.+', substr(n_name, 3, 1)) END"


@query(
    "c13_first_title_match",
    f"SELECT identifier, min(item_id) AS item_id FROM (SELECT DISTINCT {_PATTERNS} AS identifier FROM nation) n "
    f"JOIN (SELECT p_partkey AS item_id, p_name AS title FROM part) c ON regexp_matches(c.title, n.identifier, 'i') GROUP BY 1",
)
def _(spark, sf):
    wanted = table(spark, sf, "nation").selectExpr(f"{_PATTERNS} AS identifier")
    titles = table(spark, sf, "part").selectExpr("p_partkey AS item_id", "p_name AS title")
    return resolve.first_title_match(titles, wanted, rows=wanted.count())


@query(
    "c13_first_title_containing",
    "SELECT identifier, min(doc_id) AS item_id FROM (SELECT DISTINCT lower(substr(n_name, 1, 4)) AS identifier FROM nation) n "
    "JOIN documents ON contains(lower(text), identifier) GROUP BY 1",
)
def _(spark, sf):
    wanted = table(spark, sf, "nation").selectExpr("lower(substr(n_name, 1, 4)) AS identifier")
    titles = table(spark, sf, "documents").selectExpr("doc_id AS item_id", "text AS title")
    return resolve.first_title_match(titles, wanted, regex=False, rows=wanted.count())


_FIELDS = ("price_min", "price_max", "variety", "country", "min_points")
_PLACEHOLDERS = ", ".join(q.lit(v) for v in NO_FILTER_VALUES)


def real_value_sql(c: str) -> str:
    return f"CASE WHEN lower({q.strip(c)}) IN ({_PLACEHOLDERS}) THEN NULL ELSE {q.strip(c)} END"


def merged_sql(source: str, parsed: str, partial: bool = False) -> str:
    """The active filter fields per request."""

    def field(f: str) -> str:
        own = f"CASE WHEN r.has_filters THEN r.f_{f} END"
        value = f"coalesce({own}, p.{f})" if partial else f"CASE WHEN r.has_filters THEN r.f_{f} ELSE p.{f} END"
        return f"{real_value_sql(value) if f in ('variety', 'country') else value} AS {f}"

    return (
        f"SELECT r.query_id, {', '.join(field(f) for f in _FIELDS)} FROM ({source}) r JOIN ({parsed}) p USING (query_id)"
    )


@query(
    "c7_normalize_filters",
    f"SELECT query_id, f_price_min AS price_min, f_price_max AS price_max, {real_value_sql('f_variety')} AS variety, "
    f"{real_value_sql('f_country')} AS country, f_min_points AS min_points FROM ({REQUEST_SQL}) WHERE has_filters",
)
def _(spark, sf):
    rows = requests(spark, sf).where("filters is not null")
    return rows.select("query_id", flt.normalize_filters(F.col("filters")).alias("f")).select("query_id", "f.*")


def _merged(spark, sf, partial):
    merged = flt.merge_filters(F.col("parsed"), F.col("filters"), partial)
    active = flt.normalize_filters(merged).alias("f")
    return _parsed(spark, sf).select("query_id", active).select("query_id", "f.*")


@query("c8_merge_filters", merged_sql(REQUEST_SQL, parsed_sql(REQUEST_SQL)))
def _(spark, sf):
    return _merged(spark, sf, partial=False)


@query("c8_merge_filters_partial", merged_sql(REQUEST_SQL, parsed_sql(REQUEST_SQL), partial=True))
def _(spark, sf):
    return _merged(spark, sf, partial=True)


# A workload of requests: query, top_k, filters (price_min, price_max, variety, country, min_points) or None.
REQUESTS = (
    ("cold widget", 5, None),
    ("3 + under 910", 5, None),
    ("11 + low price", 4, None),
    ("Large Bolt + top rated", 6, None),
    ("small widget + expensive premium", 3, None),
    ("cold widget + sweet and promo", 5, None),
    ("99999999999999999999 + de", 5, None),
    ("+ low price", 5, None),
    ("(old|new) g.ar + over 905", 5, None),
    ("text nobody sells + crisp", 7, None),
    ("17 + over 85 points", 5, None),
    ("cold widget + under 1", 5, None),
    ("cold widget + under 905", 5, (None, None, None, "FR ", None)),
    ("small + low price", 5, (901.0, 940.0, " Any ", "any", 82)),
    ("21 + top rated", 8, (None, None, "economy", None, None)),
    ("new + fruity", 5, (None, None, "", None, None)),
)


def _sql_value(v) -> str:
    return "NULL" if v is None else q.lit(v) if isinstance(v, str) else str(v)


def workload_sql() -> str:
    rows = []
    for i, (text, top_k, f) in enumerate(REQUESTS):
        values = f or (None,) * 5
        rows.append(f"({i}, {q.lit(text)}, {top_k}, {str(f is not None).lower()}, {', '.join(map(_sql_value, values))})")
    return (
        "SELECT query_id, query, top_k, has_filters, CAST(f_price_min AS DOUBLE) AS f_price_min, "
        "CAST(f_price_max AS DOUBLE) AS f_price_max, CAST(f_variety AS VARCHAR) AS f_variety, "
        "CAST(f_country AS VARCHAR) AS f_country, CAST(f_min_points AS INT) AS f_min_points FROM (VALUES "
        + ", ".join(rows)
        + ") w(query_id, query, top_k, has_filters, f_price_min, f_price_max, f_variety, f_country, f_min_points)"
    )


def workload(spark):
    kinds = "query_id long, query string, top_k int, has_filters boolean, price_min double, price_max double, variety string, country string, min_points int"
    rows = [(i, text, k, f is not None, *(f or (None,) * 5)) for i, (text, k, f) in enumerate(REQUESTS)]
    fields = F.struct(*_FIELDS)
    return small_table(spark, kinds, rows).select(
        "query_id", "query", "top_k", F.when(F.col("has_filters"), fields).alias("filters")
    )


def recommend_sql() -> str:
    w, blend = workload_sql(), BLEND_WEIGHT
    mixed = f"list_transform(list_zip(base, mod), lambda p: (1 - {blend}::DOUBLE) * p[1] + {blend}::DOUBLE * p[2])"
    value = "CASE then_by WHEN 'price' THEN price WHEN 'points' THEN points ELSE similarity END"
    signed = f"CASE WHEN then_by IS NOT NULL AND ascending THEN -({value}) ELSE {value} END"
    return f"""
      WITH w AS ({w}), parsed AS ({parsed_sql(w)}), active AS ({merged_sql(w, parsed_sql(w))}),
      resolved AS ({resolved_sql(q.request_parts(w))}),
      cat AS ({CAT_SQL}),
      texts AS ({q.encoded(f"SELECT query_id, identifier AS text FROM ({q.request_parts(w)})", 'query_id')}),
      styles AS ({q.encoded(f"SELECT query_id, semantic_modifier AS text FROM ({parsed_sql(w)})", 'query_id')}),
      base AS (
        SELECT w.query_id, w.top_k, p.sort_by AS then_by, p.ascending, r.exclude_id, a.* EXCLUDE (query_id),
               (a.price_min IS NOT NULL OR a.price_max IS NOT NULL OR a.variety IS NOT NULL OR a.country IS NOT NULL
                OR a.min_points IS NOT NULL) AS pool, coalesce(c.embedding, t.vec) AS base, s.vec AS mod
        FROM w JOIN parsed p USING (query_id) JOIN active a USING (query_id) JOIN resolved r USING (query_id)
        LEFT JOIN cat c ON c.item_id = r.exclude_id LEFT JOIN texts t USING (query_id) LEFT JOIN styles s USING (query_id)),
      mixed AS (SELECT * EXCLUDE (base, mod), CASE WHEN mod IS NULL THEN base ELSE {mixed} END AS m, mod IS NOT NULL AS styled FROM base),
      queries AS (SELECT *, CASE WHEN styled THEN {q.unit('m')} ELSE m END AS vec FROM mixed),
      scored AS (
        SELECT s.query_id, s.top_k, s.pool, s.then_by, s.ascending, s.exclude_id, i.item_id, i.title, i.winery, i.variety, i.price,
               i.points, i.country, i.description, round(list_inner_product(s.vec, i.embedding), 12) AS similarity
        FROM queries s, cat i
        WHERE NOT s.pool OR ((s.price_min IS NULL OR i.price >= s.price_min) AND (s.price_max IS NULL OR i.price <= s.price_max)
          AND (s.min_points IS NULL OR i.points >= s.min_points)
          AND (s.variety IS NULL OR lower(trim(i.variety)) = lower(s.variety))
          AND (s.country IS NULL OR lower(trim(i.country)) = lower(s.country)))),
      fetched AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS near FROM scored),
      kept AS (SELECT *, {signed} AS order_value FROM fetched
               WHERE (pool OR near <= greatest(top_k * 5, 20)) AND (exclude_id IS NULL OR item_id <> exclude_id)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY order_value DESC NULLS LAST, similarity DESC, item_id) AS rank FROM kept)
      SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, item_id, title, winery, variety, price, points, country, description,
             round(similarity, 6) AS similarity
      FROM ranked WHERE rank <= top_k
    """


RECOMMEND_SQL = recommend_sql()


def rounded(ranked):
    return ranked.withColumn("similarity", F.round("similarity", 6))


@query("p5_recommend_batch", RECOMMEND_SQL)
def _(spark, sf):
    recommender = Recommender(cat(spark, sf), ENCODER, threshold=THRESHOLD)
    return rounded(recommender.recommend(workload(spark)))


# The same requests as JSON without ids: each still gets its own ranking. The text tells them apart.
@query(
    "a10_requests_without_id",
    f"SELECT w.query, r.rank, r.item_id, r.similarity FROM ({RECOMMEND_SQL}) r JOIN ({workload_sql()}) w USING (query_id)",
)
def _(spark, sf):
    path = new_path(spark, "requests-no-id")
    workload(spark).drop("query_id").write.json(path)
    asked = numbered(files.read_requests(spark, path))
    ranked = Recommender(cat(spark, sf), ENCODER, threshold=THRESHOLD).recommend_keyed(asked)
    return rounded(ranked.join(asked.select("request", "query"), "request").select("query", "rank", "item_id", "similarity"))


_SHOWN = (
    f"SELECT * FROM (SELECT item_id, title, variety, country, points, price, nullif(description, '') AS description FROM ({CAT_SQL})) "
    "ORDER BY md5(concat(item_id, ':42')), item_id"
)


@query(
    "p6_similar_items",
    f"""
      WITH s AS ({_SHOWN}), e AS ({q.encoded(f"SELECT item_id, coalesce(description, '') AS text FROM ({_SHOWN})", 'item_id')}),
      named AS (SELECT t.query_id, min(s.item_id) AS first_id FROM (VALUES {_TITLE_VALUES}) t(query_id, title) JOIN s ON s.title = t.title GROUP BY 1),
      scored AS (SELECT n.query_id, i.item_id, round(list_inner_product(i.vec, x.vec), 12) AS similarity
                 FROM named n JOIN e x ON x.item_id = n.first_id, e i),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS position FROM scored)
      SELECT CAST(query_id AS BIGINT) AS query_id, CAST(position AS INT) AS position, s.*, round_even(similarity, 4) AS similarity
      FROM ranked JOIN s USING (item_id) WHERE position <= 6
    """.replace("s.*", "s.item_id, s.title, s.variety, s.country, s.points, s.price, s.description"),
)
def _(spark, sf):
    return similar_items(cat(spark, sf).drop("embedding"), ENCODER, title_requests(spark))


@query(
    "p7_search_text",
    f"""
      WITH d AS ({q.encoded('SELECT doc_id, text FROM documents', 'doc_id, text')}),
      t AS ({q.encoded('SELECT item_id AS query_id, text FROM benchmark', 'query_id')}),
      r AS (SELECT query_id, doc_id, text, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS position
            FROM (SELECT t.query_id, d.doc_id, d.text, round(list_inner_product(d.vec, t.vec), 12) AS similarity FROM d, t))
      SELECT query_id, CAST(position AS INT) AS position, doc_id AS item_id, substr(text, 1, 20) AS title, text AS description,
             round(similarity, 6) AS similarity FROM r WHERE position <= 5
    """,
)
def _(spark, sf):
    from shelfwise.session import spread

    docs = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("item_id"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("description")
    )
    items = ENCODER.encode(docs, "description", "embedding")
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(search_text(items, ENCODER, texts))
