"""Data-quality reports and column profiles."""

from pyspark.sql import functions as F

from registry import query
from registry import sqltext as q
from registry.bindings import CAT_SQL, RAW_SQL, cat, raw, table
from shelfwise.functions.text import BROKEN, CONTROL, NON_ASCII, ODD_SPACE
from shelfwise.operators import profile
from shelfwise.plans.clean import clean_catalogue
from shelfwise.schemas import CLEAN, RAW

from registry.cleaning import CLEAN_SQL


def _missing_sql(source: str, columns, total: bool = False) -> str:
    lines = [
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS cells FROM t"
        for c in columns
    ]
    body = " UNION ALL ".join(lines)
    if total:
        body += f" UNION ALL SELECT 'TOTAL', CAST(sum(missing) AS BIGINT), CAST(sum(cells) AS BIGINT) FROM ({body})"
    return (
        f"WITH t AS ({source}) SELECT column_name, missing, "
        f"CAST(round_even(missing / cells * 100, 2) AS DOUBLE) AS missing_pct FROM ({body})"
    )


@query("e1_missing_report", _missing_sql(RAW_SQL, RAW.names, total=True))
def _(spark, sf):
    return profile.missing_report(raw(spark, sf), total=True)


@query("e1_missing_report_after_clean", _missing_sql(CLEAN_SQL, CLEAN.names))
def _(spark, sf):
    return profile.missing_report(clean_catalogue(raw(spark, sf, wide=True)))


@query(
    "e1_missing_report_lineitem",
    _missing_sql(
        "SELECT l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity, "
        "nullif(l_returnflag, 'R') AS l_returnflag FROM lineitem",
        ("l_orderkey", "l_quantity", "l_returnflag"),
    ),
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity",
        "nullif(l_returnflag, 'R') AS l_returnflag",
    )
    return profile.missing_report(lines)


@query(
    "e2_missing_total",
    f"SELECT CAST(sum({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in RAW.names)}) AS BIGINT) AS missing FROM ({RAW_SQL})",
)
def _(spark, sf):
    return profile.missing_total(raw(spark, sf))


def _odd_sql(source: str, column: str) -> str:
    classes = {
        "non_ascii": NON_ASCII, "control_chars": CONTROL, "weird_spaces": ODD_SPACE, "unicode_replacement": BROKEN,
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS char_class, count(*) FILTER (WHERE regexp_matches({column}, {q.lit(p)})) AS row_count FROM ({source})"
        for name, p in classes.items()
    )


@query("e3_odd_characters", _odd_sql(RAW_SQL, "description"))
def _(spark, sf):
    return profile.odd_character_report(raw(spark, sf), "description")


@query("e3_odd_characters_pages", _odd_sql("SELECT html FROM pages", "html"))
def _(spark, sf):
    return profile.odd_character_report(table(spark, sf, "pages"), "html")


def _describe_sql(source: str, c: str) -> str:
    stats = (
        ("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", f"round(avg({c}), 4)"), ("std", f"round(stddev_samp({c}), 4)"),
        ("min", f"min({c})"), ("25%", f"round(quantile_cont({c}, 0.25), 6)"),
        ("50%", f"round(quantile_cont({c}, 0.5), 6)"), ("75%", f"round(quantile_cont({c}, 0.75), 6)"), ("max", f"max({c})"),
    )
    lines = " UNION ALL ".join(f"SELECT '{n}' AS stat, CAST({v} AS DOUBLE) AS value FROM t" for n, v in stats)
    return f"WITH t AS ({source}) {lines}"


def _rounded(df):
    moments = F.col("stat").isin("mean", "std")
    return df.select("stat", F.when(moments, F.round("value", 4)).otherwise(F.round("value", 6)).alias("value"))


@query("e5_describe_price", _describe_sql(RAW_SQL, "price"))
def _(spark, sf):
    return _rounded(profile.describe(raw(spark, sf), "price"))


@query("e5_describe_extended_price", _describe_sql("SELECT l_extendedprice FROM lineitem", "l_extendedprice"))
def _(spark, sf):
    return _rounded(profile.describe(table(spark, sf, "lineitem"), "l_extendedprice"))


def _histogram_sql(source: str, c: str, n: int) -> str:
    def edge(i: str) -> str:
        return f"CASE WHEN {i} = {n} THEN hi ELSE lo + {i} * ((hi - lo) / {n}) END"

    return f"""
      WITH t AS (SELECT CAST({c} AS DOUBLE) AS x FROM ({source}) WHERE {c} IS NOT NULL),
      s AS (SELECT min(x) AS lo, max(x) AS hi FROM t),
      e AS (SELECT CAST(i AS BIGINT) AS bin, {edge('i')} AS bin_start, {edge('(i + 1)')} AS bin_end
            FROM s, range({n}) r(i))
      SELECT bin, bin_start, bin_end, count(x) AS row_count FROM e
      LEFT JOIN t ON x >= bin_start AND (x < bin_end OR (bin = {n - 1} AND x <= bin_end))
      GROUP BY bin, bin_start, bin_end
    """


@query("e6_histogram_points", _histogram_sql(RAW_SQL, "points", 20))
def _(spark, sf):
    return profile.histogram(raw(spark, sf), "points", 20)


@query("e6_histogram_price", _histogram_sql(RAW_SQL, "price", 300))
def _(spark, sf):
    return profile.histogram(raw(spark, sf), "price", 300)


@query("e6_histogram_quantity", _histogram_sql("SELECT l_quantity FROM lineitem", "l_quantity", 20))
def _(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_quantity", 20)


@query("e7_max_price", f"SELECT max(price) AS max_price FROM ({RAW_SQL})")
def _(spark, sf):
    return raw(spark, sf).agg(F.max("price").alias("max_price"))


@query("e8_distinct_countries", f"SELECT DISTINCT country FROM ({RAW_SQL})")
def _(spark, sf):
    return profile.distinct_values(raw(spark, sf), "country")


@query("e8_distinct_varieties_known", f"SELECT DISTINCT variety FROM ({CAT_SQL}) WHERE variety IS NOT NULL")
def _(spark, sf):
    return profile.distinct_values(cat(spark, sf), "variety", keep_null=False)


_TYPES = {
    "src_row": "bigint", "points": "int", "price": "double",
}


@query(
    "e9_table_profile",
    f"WITH t AS ({RAW_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{_TYPES.get(c, 'string')}' AS column_type, count({c}) AS non_null, count(*) AS row_count FROM t"
        for c in RAW.names
    ),
)
def _(spark, sf):
    return profile.table_profile(raw(spark, sf))


@query(
    "g6_seeded_sample",
    "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5(concat(doc_id, ':42')), doc_id LIMIT 100",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return profile.sample_rows(docs, 100, key="doc_id")
