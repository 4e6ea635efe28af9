"""Dense surrogate keys in source order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import new_path

KEY_SPAN = 1 << 20
NULL_PARTS = 1 << 12  # stretches that rows without an order value are dealt to


def with_dense_key(
    df: DataFrame, order: str = "src_row", key: str = "item_id", span: int = KEY_SPAN
) -> DataFrame:
    """Number the rows 0..n-1 by ``order``, which must be unique; rows without it come last.

    The rows are computed once, into the shared folder. They are cut into fixed
    spans of the order column, so no task numbers more than ``span`` rows and a
    recomputed task numbers them alike; rows without an order value are cut by
    a hash of all their cells. Only the span sizes, one row per span, are summed
    in one place.
    """
    hashed = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    missing = F.col(order).isNull()
    spanned = df.withColumns({
        "_last": missing,
        "_span": F.when(missing, F.pmod(hashed, F.lit(NULL_PARTS))).otherwise(F.floor(F.col(order) / span)),
        "_tie": F.when(missing, hashed),
    })
    path = new_path(df.sparkSession, "keyed")
    spanned.write.parquet(path)
    spanned = df.sparkSession.read.schema(spanned.schema).parquet(path)
    spans = ["_last", "_span"]
    sizes = spanned.groupBy(*spans).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(*spans).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*spans, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*spans).orderBy(order, "_tie")
    numbered = spanned.withColumn("_nth", F.row_number().over(within) - 1)
    keyed = numbered.join(starts, spans)
    return keyed.select((F.col("_start") + F.col("_nth")).alias(key), *df.columns)
