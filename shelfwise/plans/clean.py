"""Catalogue cleans: from raw reviews to one clean row per item."""

from pyspark.sql import DataFrame

from shelfwise.operators import cleaning as step
from shelfwise.operators.dedup import keep_first
from shelfwise.operators.keys import with_dense_key
from shelfwise.schemas import CLEAN


def clean_catalogue(raw: DataFrame) -> DataFrame:
    """The production clean: first row per title, priced, imputed, with its corpus."""
    df = step.clean_text_columns(raw)
    df = keep_first(df, ["title"])
    df = step.drop_unused(df)
    df = step.drop_without_price(df)
    df = step.override_country(df)
    df = step.fill_taster(step.fill_province(step.fill_region(step.fill_variety(df))))
    df = step.add_text_corpus(df)
    df = with_dense_key(df).drop("src_row").withColumnRenamed("region_1", "region")
    return step.lower_text(df).select(*CLEAN.names)


# Column order of the exploratory clean's output.
EXPLORATORY_COLUMNS = (
    "item_id", "country", "title", "description", "variety", "province", "region", "winery",
    "price", "points", "taster_name",
)


def clean_catalogue_exploratory(raw: DataFrame) -> DataFrame:
    """The exploratory clean: also removes odd characters, keeps no corpus.

    Deduplication on title and text, then on title, keeps what deduplication on
    title alone keeps: the first row of a title is also first of its pair.
    """
    df = step.remove_odd_characters(step.clean_text_columns(raw))
    df = step.drop_unused(df)
    df = keep_first(df, ["title"])
    df = step.drop_without_price(df)
    df = step.fill_variety(step.override_country(df))
    df = df.withColumnRenamed("region_1", "region")
    df = step.fill_taster(step.fill_province(step.fill_region(df, "region"), "region"))
    df = with_dense_key(df)
    return step.lower_text(df).select(*EXPLORATORY_COLUMNS)
