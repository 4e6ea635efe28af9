"""Search-box text: ``identifier + property``, as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import SPACE, strip

MOST_POINTS = 2**31 - 1


def _parts(query: Column) -> Column:
    return F.transform(F.split(query, r"\+"), strip)


def identifier(query: Column) -> Column:
    """What stands before the first ``+``."""
    return _parts(query)[0]


def modifier(query: Column) -> Column:
    """All that follows the first ``+``, joined by spaces."""
    parts = _parts(query)
    return strip(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " "))


def _number(c: Column, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast(kind)


def price_max(c: Column) -> Column:
    return _number(c, r"(?i)under \$?([0-9]+(\.[0-9]+)?)", "double")


def price_min(c: Column) -> Column:
    return _number(c, r"(?i)over \$?([0-9]+(\.[0-9]+)?)", "double")


def min_points(c: Column) -> Column:
    """Whole points; a number past the largest integer stays a bound that nothing meets."""
    digits = F.nullif(F.regexp_extract(c, r"(?i)([0-9]+)\+?" + SPACE + "*points", 1), F.lit(""))
    return F.when(digits.isNotNull(), F.coalesce(digits.try_cast("int"), F.lit(MOST_POINTS)))


def as_item_id(c: Column) -> Column:
    """The number, when the text is digits only and fits a long."""
    return F.when(c.rlike("^[0-9]+$"), c).try_cast("long")


def split_query(df: DataFrame, query: str = "query") -> DataFrame:
    """Add ``identifier``, ``modifier`` and the numeric constraints."""
    q = F.col(query)
    texts = df.withColumns({"identifier": identifier(q), "modifier": modifier(q)})
    m = F.col("modifier")
    return texts.withColumns(
        {
            "price_min": price_min(m),
            "price_max": price_max(m),
            "min_points": min_points(m),
            "id_wanted": as_item_id(F.col("identifier")),
        }
    )
