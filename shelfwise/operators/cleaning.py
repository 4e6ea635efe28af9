"""Steps of a catalogue clean: each takes a table and returns a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import text
from shelfwise.session import small_table
from shelfwise.vocab import DEFAULT_VARIETY, TEXT_COLUMNS, UNKNOWN, UNUSED_COLUMNS, WINERY_COUNTRY


def clean_text_columns(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    cleaned = df.withColumns({c: text.clean_text(c) for c in columns})
    return nan_text_to_null(cleaned, [c for c in strings(df) if c not in columns])


def nan_text_to_null(df: DataFrame, columns=None) -> DataFrame:
    columns = strings(df) if columns is None else columns
    return df.withColumns({c: text.nan_to_null(c) for c in columns})


def remove_odd_characters(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: text.remove_odd_characters(c) for c in columns})


def drop_unused(df: DataFrame) -> DataFrame:
    return df.drop(*UNUSED_COLUMNS)


def drop_without_price(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["price"])


def override_country(df: DataFrame) -> DataFrame:
    """The country of a known producer replaces what the file says."""
    rules = small_table(
        df.sparkSession, "winery string, _country string", list(WINERY_COUNTRY.items())
    )
    joined = df.join(F.broadcast(rules), "winery", "left")
    return joined.withColumn("country", F.coalesce("_country", "country")).select(*df.columns)


def fill_variety(df: DataFrame) -> DataFrame:
    return df.na.fill({"variety": DEFAULT_VARIETY})


def fill_region(df: DataFrame, region: str = "region_1") -> DataFrame:
    """A missing region is what the title holds in its first parentheses."""
    title, parens = F.col("title"), r"\((.*?)\)"
    inside = F.when(title.rlike(parens), F.regexp_extract(title, parens, 1))
    return df.withColumn(region, F.coalesce(F.col(region), inside, F.lit(UNKNOWN)))


def fill_province(df: DataFrame, region: str = "region_1") -> DataFrame:
    return df.withColumn("province", F.coalesce("province", region, F.lit(UNKNOWN)))


def fill_taster(df: DataFrame) -> DataFrame:
    return df.na.fill({"taster_name": UNKNOWN})


def add_text_corpus(df: DataFrame, region: str = "region_1") -> DataFrame:
    corpus = text.text_corpus(F.col("description"), F.col("variety"), F.col(region))
    return df.withColumn("text_corpus", corpus)


def lower_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.col(c)) for c in strings(df)})


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
