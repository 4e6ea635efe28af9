"""Hand a small bounded table to every task along with its own rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_BITS = 33  # monotonically_increasing_id counts a partition's rows in these bits


def packed(df: DataFrame) -> Column:
    """All rows of a small table as one array, planned as a scalar subquery.

    The caller bounds the row count.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.collect_list(row).alias("packed")).scalar()


def on_first_row(payload: Column) -> Column:
    """``payload`` on the first row of each partition, null on all others.

    A task reads it once from there, instead of once per row.
    """
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)) == 0
    return F.when(first, payload)
