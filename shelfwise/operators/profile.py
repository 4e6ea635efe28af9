"""Data-quality reports and column profiles, each from combined partial counts."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import ODD_CLASSES
from shelfwise.session import checkpointed, small_table


def _long_form(df: DataFrame, rows: list[Column]) -> DataFrame:
    """One aggregate row, laid out as one line per struct in ``rows``."""
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def missing_report(df: DataFrame, total: bool = False) -> DataFrame:
    """Missing cells per column and their share in per cent; optionally a TOTAL line."""
    n = F.count(F.lit(1))

    def line(name: str, missing: Column, cells: Column) -> Column:
        share = F.when(cells > 0, F.bround(missing / cells * 100, 2))
        return F.struct(
            F.lit(name).alias("column_name"), missing.alias("missing"), share.alias("missing_pct")
        )

    counts = [(c, F.count_if(F.col(c).isNull())) for c in df.columns]
    lines = [line(c, m, n) for c, m in counts]
    if total:
        everything = sum((m for _, m in counts), F.lit(0))
        lines.append(line("TOTAL", everything, n * len(counts)))
    return _long_form(df, lines)


def missing_total(df: DataFrame) -> DataFrame:
    """One row: missing cells over all columns."""
    per_row = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("missing"))


def odd_character_report(df: DataFrame, column: str) -> DataFrame:
    """Rows of ``column`` that hold characters of each odd class."""
    return _long_form(
        df,
        [
            F.struct(
                F.lit(name).alias("char_class"), F.count_if(F.col(column).rlike(p)).alias("row_count")
            )
            for name, p in ODD_CLASSES.items()
        ],
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Type, non-missing count and row count for every column."""
    return _long_form(
        df,
        [
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.count(F.col(f.name)).alias("non_null"),
                F.count(F.lit(1)).alias("row_count"),
            )
            for f in df.schema
        ],
    )


def distinct_values(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    values = df.select(column)
    return (values if keep_null else values.where(F.col(column).isNotNull())).distinct()


def _count_reached(cuts: list[float], v: Column) -> Column:
    """How many of the ``2**bits - 1`` ascending cuts are at most ``v``, by bisection."""
    sizes = []
    while len(cuts) >> len(sizes):
        sizes.insert(0, 1 << len(sizes))
    array = F.expr("array(" + ", ".join(f"{c!r}D" for c in cuts) + ")")
    steps = F.expr("array(" + ", ".join(map(str, sizes)) + ")")
    return F.aggregate(
        steps, F.lit(0), lambda n, step: F.when(F.get(array, n + step - 1) <= v, n + step).otherwise(n)
    )


SORTED_VALUES = 1 << 20  # distinct values of a range that one task sorts


def _narrowed(values: DataFrame, ranks: list[int], bits: int, most: int) -> list[tuple[list[float], int, list[int], bool]]:
    """Ranges that hold the wanted ranks, each as its cuts so far: ``(low, high)`` and the rows before it, with its ranks.

    A round cuts every range that has more than ``most`` distinct values, by
    their approximate quantiles, and counts the parts in one job; it goes on with
    the parts that hold a wanted rank. The driver sees the cuts and counts alone.
    """
    size = values.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct")).first()
    waiting, done = [(-math.inf, math.inf, 0, sorted(ranks), size["distinct"])], []
    shares = ", ".join(f"{i / 2**bits}D" for i in range(1, 2**bits))
    while waiting:
        going = [r for r in waiting if r[4] > most]
        done += [r[:4] for r in waiting if r[4] <= most]
        waiting = []
        if not going:
            break
        # a range is (low, high]; NaN counts as the largest number
        part = F.coalesce(*[F.when(_within(low, high), i) for i, (low, high, *_) in enumerate(going)])
        parts = values.select("v", "n", part.alias("part")).where("part IS NOT NULL")
        found = parts.groupBy("part").agg(F.expr(f"percentile_approx(v, array({shares}))").alias("cuts")).collect()
        cuts = {r.part: [c for c in dict.fromkeys(r.cuts) if math.isfinite(c)] for r in found}
        place = F.coalesce(*[F.when(F.col("part") == i, _count_reached(c, F.col("v"))) for i, c in cuts.items() if c], F.lit(0))
        counts = parts.withColumn("place", place).groupBy("part", "place").agg(
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"), F.min("v").alias("least"), F.max("v").alias("most")
        ).orderBy("part", "place").collect()
        for i, (low, _, before, wanted, distinct) in enumerate(going):
            for c in (c for c in counts if c.part == i):
                held = [r for r in wanted if before <= r < before + c.rows]
                if held:
                    # one value can't be cut again, and a range that was not cut is not tried for ever
                    waiting.append((low, c.most, before, held, 1 if c.least == c.most else min(c.distinct, distinct - 1)))
                before, low = before + c.rows, c.most
    return done


def _within(low: float, high: float) -> Column:
    upto = F.lit(True) if high == math.inf or math.isnan(high) else F.col("v") <= F.lit(high)
    return upto if low == -math.inf else (F.col("v") > F.lit(low)) & upto


def exact_quantiles(df: DataFrame, column: str, probs, bits: int = 8, most: int = SORTED_VALUES) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per probability.

    Equal values are counted before the shuffle, and the counts are written to
    the shared folder. They are cut into ranges of like size, again and again
    where a range has more than ``most`` distinct values, and only the ranges that
    hold a wanted rank are sorted, each in its own task, which is never given more.
    """
    spark = df.sparkSession
    values = checkpointed(
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    )
    total = values.agg(F.sum("n")).first()[0]
    result = "prob double, value double"
    if total is None:
        return small_table(spark, result, [(float(p), None) for p in probs])

    asked = [(float(p), p * (total - 1)) for p in probs]
    near = sorted({r for _, at in asked for r in (math.floor(at), math.ceil(at))})
    ranges = _narrowed(values, near, bits, most)
    wanted = [
        (i, before, p, at - math.floor(at), rank)
        for i, (_, _, before, ranks) in enumerate(ranges) for p, at in asked
        for rank in sorted({math.floor(at), math.ceil(at)}) if rank in ranks
    ]
    ranks = small_table(spark, "bucket int, start long, prob double, part double, rank long", wanted)
    in_order = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    bucket = F.coalesce(*[F.when(_within(low, high), i) for i, (low, high, *_) in enumerate(ranges)])
    summed = values.withColumn("bucket", bucket).where("bucket IS NOT NULL").withColumn("upto", F.sum("n").over(in_order))
    picked = summed.join(F.broadcast(ranks), "bucket").where(
        "start + upto - n <= rank and rank < start + upto"
    )
    low, high = F.min("v"), F.max("v")
    between = F.when(low == high, low).otherwise(low + (high - low) * F.col("part"))
    return picked.groupBy("prob", "part").agg(between.alias("value")).select(
        "prob", "value"
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one line each."""
    x = F.col(column).cast("double")
    moments = [
        ("count", F.count(x).cast("double")), ("mean", F.avg(x)), ("std", F.stddev_samp(x)),
        ("min", F.min(x)), ("max", F.max(x)),
    ]
    lines = _long_form(
        df, [F.struct(F.lit(n).alias("stat"), v.alias("value")) for n, v in moments]
    )
    name = F.concat((F.col("prob") * 100).cast("int").cast("string"), F.lit("%"))
    quartiles = exact_quantiles(df, column, (0.25, 0.5, 0.75)).select(name.alias("stat"), "value")
    return lines.unionByName(quartiles)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the full range, empty ones included, the last one closed."""
    x = F.col(column).cast("double")
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).select(
        F.when(F.col("s.lo") == F.col("s.hi"), F.struct(
            (F.col("s.lo") - 0.5).alias("lo"), (F.col("s.hi") + 0.5).alias("hi")))
        .otherwise(F.col("s")).alias("s")
    ).scalar()

    def edge(i: Column) -> Column:
        step = (F.col("s.hi") - F.col("s.lo")) / bins
        return F.when(i == bins, F.col("s.hi")).otherwise(F.col("s.lo") + i * step)

    near = F.least(
        F.floor((F.col("x") - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo")) * bins), F.lit(bins - 1)
    )
    placed = (
        df.select(x.alias("x")).where("x is not null").withColumn("s", span).withColumn("i", near)
        .select(
            F.when(F.col("x") < edge(F.col("i")), F.col("i") - 1)
            .when((F.col("i") < bins - 1) & (F.col("x") >= edge(F.col("i") + 1)), F.col("i") + 1)
            .otherwise(F.col("i")).alias("bin")
        )
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin").withColumn("s", span)
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("bin_start"),
        edge(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("row_count"),
    )


def sample_rows(df: DataFrame, size: int, seed: int = 42, key: str = "item_id") -> DataFrame:
    """Exactly ``size`` rows, the same ones however the table is partitioned."""
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(draw, key).limit(size)
