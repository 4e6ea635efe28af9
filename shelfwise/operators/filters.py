"""Hard filters: constant ones for one table, per-request ones for a batch."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import strip
from shelfwise.schemas import FILTERS
from shelfwise.session import checkpointed
from shelfwise.vocab import NO_FILTER_VALUES

ID_SPAN = "id_span"
ITEMS_PER_SPAN = 1 << 18
VALUE_KEYS = {"variety": "variety_key", "country": "country_key"}  # stored in the form that filters compare
ROW_BYTES = 100  # of a request, an id or a short result; vectors are given their own width
BROADCAST_BYTES = 20_000_000  # of a side that is sent to every task
BROADCAST_ROWS = BROADCAST_BYTES // ROW_BYTES
FILTER_BITS = 24  # of the bit map that keeps unwanted items out of a shuffle: 2 MB, whatever the input


def same_text(c: Column, wanted: Column) -> Column:
    return strip_lower(c) == F.lower(wanted)


def strip_lower(c: Column) -> Column:
    return F.lower(strip(c))


def real_value(c: Column) -> Column:
    """The trimmed text, or missing for a placeholder such as ``Any``."""
    return F.when(strip_lower(c).isin(*NO_FILTER_VALUES), None).otherwise(strip(c))


def apply_filters(
    df: DataFrame, price_min=None, price_max=None, variety=None, country=None, min_points=None
) -> DataFrame:
    """Rows that meet every given constraint; a row with the value missing fails."""
    if price_min is not None:
        df = df.where(F.col("price") >= price_min)
    if price_max is not None:
        df = df.where(F.col("price") <= price_max)
    for name, value in (("variety", variety), ("country", country)):
        if value is not None and value.strip().lower() not in NO_FILTER_VALUES:
            df = df.where(same_text(F.col(name), F.lit(value.strip())))
    if min_points is not None:
        df = df.where(F.col("points") >= min_points)
    return df


def normalize_filters(filters: Column) -> Column:
    """The filter struct with placeholders turned into missing fields."""
    return F.struct(
        filters["price_min"].alias("price_min"),
        filters["price_max"].alias("price_max"),
        real_value(filters["variety"]).alias("variety"),
        real_value(filters["country"]).alias("country"),
        filters["min_points"].alias("min_points"),
    )


def merge_filters(parsed: Column, requested: Column, partial: bool = False) -> Column:
    """Filters of the request text and of the request itself as one struct.

    A request that carries a filter object overrides every parsed field, also
    those it leaves empty. With ``partial`` only the fields it sets override.
    """

    def field(name: str) -> Column:
        if partial:
            return F.coalesce(requested[name], parsed[name])
        return F.when(requested.isNotNull(), requested[name]).otherwise(parsed[name])

    return F.struct(*[field(f.name).cast(f.dataType).alias(f.name) for f in FILTERS])


def any_filter(filters: Column) -> Column:
    return reduce(lambda a, b: a | b, [filters[f.name].isNotNull() for f in FILTERS])


def exclude_item(df: DataFrame, item_id) -> DataFrame:
    """Everything but the given item; nothing is left out when it is missing."""
    wanted = item_id if isinstance(item_id, Column) else F.lit(item_id)
    return df.where(wanted.isNull() | (F.col("item_id") != wanted))


def with_missing(df: DataFrame, columns) -> DataFrame:
    """Rows where any of ``columns`` is missing."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def values_where(df: DataFrame, column: str, value, wanted: str) -> DataFrame:
    """Distinct values of ``wanted`` among rows whose ``column`` equals ``value``."""
    return df.where(F.col(column) == value).select(wanted).distinct()


def by_id(df: DataFrame, item_id: int) -> DataFrame:
    """The item with this id; no row when there is none."""
    return df.where(F.col("item_id") == item_id)


def look_up(df: DataFrame, wanted: DataFrame, rows: int | None = None) -> DataFrame:
    """One line per wanted ``item_id``, with a null ``item`` when it does not exist.

    The wanted ids, ``rows`` of them at most, cut the catalogue down first, so
    that it is not shuffled to be looked into.
    """
    rows = wanted.count() if rows is None else rows
    item = F.struct(*[F.col(c) for c in item_columns(df) if c != "item_id"]).alias("item")
    kept = [c for c in ("item_id", ID_SPAN) if c in df.columns]
    ids = wanted.select("item_id").where("item_id is not null").distinct()
    found = with_ids(df.select(*kept, item), ids, rows)
    return wanted.join(bounded_broadcast(found, rows), "item_id", "left")


def bounded_broadcast(df: DataFrame, rows: int | None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Hint a broadcast only for a side known to be short, by its rows and what one has at most."""
    return F.broadcast(df) if rows is not None and rows * row_bytes <= BROADCAST_BYTES else df


def member_filter(wanted: DataFrame, key: str):
    """A test for a column that all values of ``key`` pass and few others do.

    A bit map of fixed size over hashes of the values, planned as a scalar
    subquery and looked into without leaving the JVM. With four million values
    about a fifth of the others pass; it spares rows a shuffle and decides nothing.
    """
    def place(c: Column) -> Column:
        return F.xxhash64(c).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))

    words = wanted.select(place(F.col(key)).alias("place")).groupBy(F.shiftright("place", 6).alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")
    )
    all_words = wanted.sparkSession.range(1 << (FILTER_BITS - 6)).join(words, "id", "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    bits = all_words.agg(F.transform(listed, lambda w: w["bits"]).alias("bits")).scalar()

    def passes(c: Column) -> Column:
        word = F.get(bits, F.shiftright(place(c), 6).cast("int"))
        return F.getbit(word, place(c).bitwiseAND(F.lit(63)).cast("int")) == 1

    return passes


def with_value_keys(df: DataFrame) -> DataFrame:
    """Add the text columns that filters test, in the form in which they are compared, so that a scan can be cut by them."""
    return df.withColumns({key: strip_lower(F.col(name)) for name, key in VALUE_KEYS.items() if name in df.columns})


def item_columns(df: DataFrame) -> list[str]:
    """The columns of stored items that belong to the items, not to how they are stored."""
    return [c for c in df.columns if c != ID_SPAN and c not in VALUE_KEYS.values()]


def with_id_span(df: DataFrame) -> DataFrame:
    """Add the span of ids an item lies in, the partition column of stored items."""
    return df.withColumn(ID_SPAN, F.floor(F.col("item_id") / ITEMS_PER_SPAN).cast("int"))


def with_ids(items: DataFrame, wanted: DataFrame, rows: int | None = None) -> DataFrame:
    """The items joined to a table of ``item_id``, ``rows`` of them at most, if known.

    Where the items are stored by span, only the spans of wanted ids are read.
    A wanted side too long to be sent to every task is written once; items go
    into the join's shuffle only where a bit map of the wanted ids lets them.
    """
    if rows is None or rows * ROW_BYTES > BROADCAST_BYTES:
        wanted = checkpointed(wanted)
        near = items.where(member_filter(wanted, "item_id")(F.col("item_id"))).drop(ID_SPAN)
        return near.join(wanted, "item_id")
    if ID_SPAN not in items.columns:
        return items.join(bounded_broadcast(wanted, rows), "item_id")
    # Ids start at 0. The comparison marks the short side as one worth pruning by.
    spanned = with_id_span(wanted.where("item_id >= 0"))
    joined = items.join(bounded_broadcast(spanned, rows), [ID_SPAN, "item_id"])
    return joined.drop(ID_SPAN)


def first_with_title(df: DataFrame, titles: DataFrame, rows: int | None = None) -> DataFrame:
    """The first item that carries each of ``titles`` exactly; ``rows`` is their number, if known."""
    wanted = bounded_broadcast(titles.select("title").distinct(), rows)
    firsts = df.select("title", "item_id").join(wanted, "title", "left_semi")
    return firsts.groupBy("title").agg(F.min("item_id").alias("item_id"))
