"""The catalogue tables, derived from the given tables alike in Spark and in the check SQL.

The given tables hold no missing cells, odd characters or producers with a known
country, so the select lists below put some in. They use only SQL that both
engines read the same way.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.filters import BROADCAST_ROWS
from shelfwise.session import spread

NBSP, ZWSP, BOM, BROKEN, QUOTE, LIGATURE, TAB = " ", "​", "﻿", "�", "’", "ﬁ", "\t"

_ODD = f" a{NBSP}b{TAB}c {ZWSP} d{BROKEN}e{BOM}f It{QUOTE}s {LIGATURE}ne.  "

RAW_SELECT = f"""
SELECT p.p_partkey AS src_row,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE d.lang END AS country,
  CASE WHEN p.p_partkey % 5 = 0 THEN d.text || '{_ODD}' ELSE d.text END AS description,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL WHEN p.p_partkey % 9 = 0 THEN 'nan' ELSE p.p_type END AS designation,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE CAST(80 + p.p_size % 21 AS INT) END AS points,
  CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE p.p_retailprice END AS price,
  CASE WHEN p.p_partkey % 6 = 0 THEN NULL ELSE d.source END AS province,
  CASE WHEN p.p_size % 3 = 0 THEN NULL ELSE concat('  region ', p.p_brand, '{NBSP}') END AS region_1,
  CASE WHEN p.p_partkey % 2 = 0 THEN NULL ELSE p.p_brand END AS region_2,
  CASE WHEN p.p_partkey % 10 = 3 THEN NULL ELSE concat('Taster {TAB} ', p.p_type) END AS taster_name,
  CASE WHEN p.p_partkey % 3 = 1 THEN NULL ELSE concat('@', lower(p.p_type)) END AS taster_twitter_handle,
  CASE WHEN p.p_size = 50 THEN NULL
    WHEN p.p_size % 4 = 0 THEN concat(p.p_name, ' ', p.p_size, ' (', p.p_brand, ')')
    WHEN p.p_size % 9 = 0 THEN concat(p.p_name, ' ', p.p_size, ' ()')
    ELSE concat(p.p_name, ' ', p.p_size) END AS title,
  CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE p.p_type END AS variety,
  CASE WHEN p.p_size = 1 THEN 'Psagot' WHEN p.p_size = 2 THEN 'Büyülübağ' WHEN p.p_size = 3 THEN 'St. Donat'
    WHEN p.p_size = 4 THEN 'BÃ¼yÃ¼lÃ¼baÄŸ' ELSE p.p_brand END AS winery
FROM {{part}} p LEFT JOIN {{documents}} d ON d.doc_id = p.p_partkey
"""

CAT_SELECT = """
SELECT p.p_partkey AS item_id, p.p_name AS title, p.p_brand AS winery, p.p_type AS variety,
  CASE WHEN p.p_partkey % 17 = 5 THEN NULL ELSE p.p_retailprice END AS price,
  CASE WHEN p.p_partkey % 13 = 4 THEN NULL ELSE CAST(80 + p.p_size % 21 AS INT) END AS points,
  d.lang AS country, d.text AS description{embedding}
FROM {part} p JOIN {embeddings} e ON p.p_partkey = e.vec_id JOIN {documents} d ON d.doc_id = p.p_partkey
"""

# Request texts, one per part, that between them use every rule of the grammar.
REQUEST_SELECT = """
SELECT p.p_partkey AS query_id,
  CASE p.p_partkey % 12
    WHEN 0 THEN concat(p.p_name, ' + Under $', p.p_size, '.5')
    WHEN 1 THEN concat(p.p_partkey, ' + over ', p.p_size, ' points')
    WHEN 2 THEN concat(p.p_name, ' +  95+ points')
    WHEN 3 THEN concat(p.p_name, ' + low price')
    WHEN 4 THEN p.p_name
    WHEN 5 THEN concat('  ', p.p_name, '  + top rated + ', p.p_brand)
    WHEN 6 THEN concat(p.p_name, ' + Thunder ', p.p_size)
    WHEN 7 THEN '+ low price'
    WHEN 8 THEN concat(p.p_name, ' + sweet and ', lower(p.p_type))
    WHEN 9 THEN concat('9999999999999999999', p.p_partkey, ' + ', p.p_type, ' from EN')
    WHEN 10 THEN concat(p.p_brand, ' + under ', p.p_size, ' over 3 de')
    ELSE concat(p.p_name, ' + luscious fr wine') END AS query,
  CASE p.p_partkey % 5 WHEN 0 THEN ' Any ' WHEN 1 THEN concat(' ', lower(p.p_type)) WHEN 2 THEN '' ELSE NULL END AS f_variety,
  CASE p.p_partkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN ' EN ' WHEN 2 THEN 'all' ELSE NULL END AS f_country,
  CASE WHEN p.p_partkey % 3 = 0 THEN p.p_retailprice END AS f_price_min,
  CASE WHEN p.p_partkey % 4 = 0 THEN p.p_retailprice + 10 END AS f_price_max,
  CASE WHEN p.p_partkey % 6 = 0 THEN CAST(80 + p.p_size % 21 AS INT) END AS f_min_points,
  p.p_partkey % 2 = 0 AS has_filters
FROM {part} p
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(
    spark: SparkSession, sf_dir: str, select: str, *names: str, wide: bool = False, **texts: str
) -> DataFrame:
    tables = {n: table(spark, sf_dir, n) for n in names}
    if wide:
        tables[names[0]] = spread(tables[names[0]])
    if len(names) > 1 and tables[names[0]].count() > BROADCAST_ROWS:
        # its keys and names compress to little, so by the size of its file it would be sent to every task
        tables[names[0]] = tables[names[0]].hint("merge")
    marks = {n: "{" + n + "}" for n in names}
    return spark.sql(select.format(**marks, **texts), **tables)


def raw(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """The raw reviews; ``wide`` for work that is heavy per row."""
    return _derived(spark, sf_dir, RAW_SELECT, "part", "documents", wide=wide)


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(
        spark, sf_dir, CAT_SELECT, "part", "embeddings", "documents", embedding=", e.embedding"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived requests, with the filter fields as the request's own struct."""
    df = _derived(spark, sf_dir, REQUEST_SELECT, "part")
    filters = F.struct(
        F.col("f_price_min").alias("price_min"), F.col("f_price_max").alias("price_max"),
        F.col("f_variety").alias("variety"), F.col("f_country").alias("country"),
        F.col("f_min_points").alias("min_points"),
    )
    return df.select("query_id", "query", F.when(F.col("has_filters"), filters).alias("filters"))


RAW_SQL = RAW_SELECT.format(part="part", documents="documents")
CAT_SQL = CAT_SELECT.format(
    part="part", embeddings="embeddings", documents="documents",
    embedding=", CAST(e.embedding AS DOUBLE[]) AS embedding",
)
REQUEST_SQL = REQUEST_SELECT.format(part="part")
