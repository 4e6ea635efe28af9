"""Display columns for result tables."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import strip
from shelfwise.session import small_table
from shelfwise.vocab import (
    COUNTRY_OVERRIDES, RATING_FLOORS, RED_VARIETIES, STYLE_WORDS, WHITE_VARIETIES,
)

_LETTER_RUNS = r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"


def any_word_pattern(words) -> str:
    """A pattern that finds any of ``words`` between word boundaries."""
    alternatives = "|".join(re.sub(r"([.^$*+?{}()\[\]\\|])", r"\\\1", w) for w in words)
    return rf"(^|[^\p{{L}}\p{{N}}_])({alternatives})($|[^\p{{L}}\p{{N}}_])"


def style_category(variety: Column, words: dict = STYLE_WORDS) -> Column:
    """The first style in ``words`` one of whose words occurs in the variety.

    Styles are tested in the order of ``words``; entries count as whole words.
    """
    name = strip(F.lower(variety))
    out = None
    for style, entries in words.items():
        found = name.rlike(any_word_pattern(entries))
        out = F.when(found, style) if out is None else out.when(found, style)
    return out.otherwise("other")


def rating_bucket(points: Column) -> Column:
    """One to five; null when the points are missing or not a number."""
    value = points.try_cast("double")
    out = F.when(value.isNull(), F.lit(None).cast("int")).when(F.isnan(value), 1)
    for floor, bucket in RATING_FLOORS:
        out = out.when(value >= floor, bucket)
    return out.otherwise(1)


def title_case(c: Column) -> Column:
    """A capital after every character that is not a cased letter."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(_LETTER_RUNS), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def country_case(c: Column) -> Column:
    key = strip(F.lower(c))
    out = None
    for short, shown in COUNTRY_OVERRIDES.items():
        out = F.when(key == short, shown) if out is None else out.when(key == short, shown)
    return out.otherwise(title_case(c))


def sentence_case(c: Column) -> Column:
    """A capital at the start and after every full stop with a space."""

    def capital(s: Column) -> Column:
        return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))

    return F.array_join(F.transform(F.split(c, r"\. "), capital), ". ")


def price_label(price: Column) -> Column:
    """Whole units with thousands separators, halves to even; ``?`` if missing."""
    return F.coalesce(F.format_number(F.bround(price, 0), 0), F.lit("?"))


def match_label(similarity: Column) -> Column:
    return F.concat(F.format_number(F.bround(similarity * 100, 0), 0), F.lit("%"))


def present(df, words: dict = STYLE_WORDS):
    """Display form of ranked rows: one projection."""
    return df.select(
        "query_id",
        "rank",
        "item_id",
        style_category(F.col("variety"), words).alias("style"),
        rating_bucket(F.col("points")).alias("rating"),
        title_case(F.col("title")).alias("title"),
        title_case(F.col("variety")).alias("variety"),
        country_case(F.col("country")).alias("country"),
        sentence_case(F.col("description")).alias("description"),
        price_label(F.col("price")).alias("price_label"),
        match_label(F.col("similarity")).alias("match_label"),
    )


def standard_varieties(spark):
    """The filter dimension: each offered grape name and how it is shown."""
    names = sorted(set(RED_VARIETIES) | set(WHITE_VARIETIES))
    values = small_table(spark, "value string", [(name,) for name in names])
    return values.select("value", title_case(F.col("value")).alias("display"))


def flag_standard(df, column: str = "variety"):
    """Add ``display`` and ``is_standard`` by the filter dimension."""
    offered = F.broadcast(standard_varieties(df.sparkSession))
    joined = df.join(offered, F.col(column) == F.col("value"), "left")
    return joined.withColumn("is_standard", F.col("value").isNotNull()).drop("value")
