"""Declared schemas of the tables that enter and leave the jobs."""

from pyspark.sql import types as T

from shelfwise.vocab import TEXT_COLUMNS


def _fields(*pairs):
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


# The file's own column order; the unnamed first column is the row number.
RAW = _fields(
    ("src_row", T.LongType()), ("country", T.StringType()), ("description", T.StringType()),
    ("designation", T.StringType()), ("points", T.IntegerType()), ("price", T.DoubleType()),
    ("province", T.StringType()), ("region_1", T.StringType()), ("region_2", T.StringType()),
    ("taster_name", T.StringType()), ("taster_twitter_handle", T.StringType()),
    ("title", T.StringType()), ("variety", T.StringType()), ("winery", T.StringType()),
)

CLEAN = _fields(
    ("item_id", T.LongType()), ("country", T.StringType()), ("description", T.StringType()),
    ("points", T.IntegerType()), ("price", T.DoubleType()), ("province", T.StringType()),
    ("region", T.StringType()), ("taster_name", T.StringType()), ("title", T.StringType()),
    ("variety", T.StringType()), ("winery", T.StringType()), ("text_corpus", T.StringType()),
)

VECTORS = _fields(("item_id", T.LongType()), ("embedding", T.ArrayType(T.FloatType())))

FILTERS = _fields(
    ("price_min", T.DoubleType()), ("price_max", T.DoubleType()), ("variety", T.StringType()),
    ("country", T.StringType()), ("min_points", T.IntegerType()),
)

REQUEST = _fields(
    ("query_id", T.LongType()), ("query", T.StringType()), ("top_k", T.IntegerType()),
    ("filters", FILTERS),
)

MANIFEST = _fields(
    ("model_name", T.StringType()), ("num_items", T.LongType()), ("embedding_dim", T.LongType()),
)

assert set(TEXT_COLUMNS) <= set(RAW.names)
