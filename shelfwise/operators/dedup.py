"""First-row-wins deduplication and duplicate reports."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys, order: str = "src_row") -> DataFrame:
    """One row per key, the earliest by ``order``; missing keys count as equal.

    Catalyst turns the ``= 1`` into a per-task group limit ahead of the shuffle,
    so a key that holds a third of the rows sends one row per task.
    """
    first = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def duplicate_members(df: DataFrame, keys) -> DataFrame:
    """Every row whose key occurs more than once.

    Counts are combined before the shuffle; the rows then meet only the
    repeated keys, in a semi join whose hot partitions AQE can split.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = counts.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(repeated, same, "left_semi")


def duplicates_removed(df: DataFrame, keys) -> DataFrame:
    """One row: rows before and after deduplication on ``keys``, and the difference."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("rows_removed"),
    )
