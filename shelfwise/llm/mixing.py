"""Mix sources to target weights along a low-discrepancy schedule.

The mix is a sequence of slots of equal length in words. Slot i has the point
frac(i * golden ratio); the source whose stretch of the cumulative targets
holds the point fills the slot, with its next block of words. A source's
documents stand in an order given by a hash, cut into blocks of the same
length, and its slots go round its blocks, three times at most. A source's slots
end where its target is reached, within a block if need be; what the schedule is
short of, a few slots, closes the mix.

Defined results: a null text has no words and takes nothing; a null source is a
source, the last one; repeated rows are rows of their own; a null doc_id is a
value like any other; an empty table gives no rows. The order hangs on
doc_id and text alone, so reruns agree. Every source's words come to its target,
rounded, whatever the length of a block.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 64  # of any input; slots are made and ranked by all tasks
POINT_BITS = 32
GOLDEN = 2654435769  # 2^32 over the golden ratio
BIN_BITS, CELL_BITS, SPAN = 12, 12, 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """Each row's words and its place in the shuffled order."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    place = F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", "source", words.alias("size"), place.alias("place"))


def source_targets(rows: DataFrame, weights=WEIGHTS, most=MOST_TIMES) -> DataFrame:
    """One row per source: its number ``sid`` by code point, size, target and stretch of points.

    Filling from the source that stops first, the level is what is left over the
    weights that are left; a source whose stop is under the level gets its stop.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", weight)
        .withColumn("stop", F.col("source_size") * most)
    )
    filling = Window.orderBy(F.col("stop") / F.col("weight"), "sid")
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("weight").over(onward)
    levelled = ranked.withColumn("level", level).withColumn("open", F.col("stop") / F.col("weight") > F.col("level"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    target = F.when(F.col("open"), F.col("weight") * final).otherwise(F.col("stop")).cast("double")
    cumulative = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    share = F.try_divide(F.coalesce(F.sum("target").over(cumulative), F.lit(0.0)), F.sum("target").over(whole))
    low = F.floor(share * float(1 << POINT_BITS)).cast("bigint")
    return (
        levelled.withColumn("target", target).withColumn("low", F.coalesce(low, F.lit(0)))
        .withColumn("high", F.lead("low", 1, 1 << POINT_BITS).over(Window.orderBy("sid")))
        .select("source", "sid", "source_size", "target", "low", "high")
    )


def slot_schedule(spark: SparkSession, targets: DataFrame, total: int, length: int = BLOCK_WORDS) -> DataFrame:
    """One row per slot that is filled: ``slot, sid, block, turn`` and ``part``, how many words of the block it takes."""
    n_slots = -(-total // length)
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"),
        (F.col("id") % (1 << (POINT_BITS - 1)) * GOLDEN).bitwiseAND(F.lit((1 << POINT_BITS) - 1)).alias("point"),
    ).withColumn("bin", F.shiftright("point", POINT_BITS - BIN_BITS))
    # a source's last slot: whole turns over its blocks, then ``rest`` words of one more
    words, size = F.round("target").cast("bigint"), F.col("source_size")
    rest = F.col("words") % size
    sources = targets.where("source_size > 0").withColumn("words", words).select(
        "sid", "low", "high", "source_size", F.ceil(size / length).cast("bigint").alias("blocks"),
        F.floor(F.col("words") / size).alias("turns"), rest.alias("rest"),
    ).withColumn("needed", F.col("turns") * F.col("blocks") + F.ceil(F.col("rest") / length))
    stretches = sources.where("high > low").select(
        "sid", "low", "high",
        F.explode(F.sequence(
            F.shiftright("low", POINT_BITS - BIN_BITS), F.shiftright(F.col("high") - 1, POINT_BITS - BIN_BITS)
        )).alias("bin"),
    )
    dealt = (
        slots.join(stretches, "bin").where("point >= low and point < high")
        .select("slot", "sid", F.floor(F.col("slot") / SPAN).alias("span"))
    )
    counts = dealt.groupBy("sid", "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("sid", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("sid", "span").orderBy("slot")) - 1
    ranked = dealt.withColumn("nth", nth).join(starts, ["sid", "span"]).select(
        "slot", "sid", (F.col("start") + F.col("nth")).alias("rank")
    )
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    short = sources.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < needed")
    closing = short.select("sid", F.explode(F.sequence("have", F.col("needed") - 1)).alias("rank")).select(
        (F.lit(n_slots) + F.xxhash64("rank", "sid").bitwiseAND(F.lit((1 << 62) - 1))).alias("slot"), "sid", "rank"
    )
    filled = ranked.unionByName(closing).join(
        sources.select("sid", "source_size", "blocks", "turns", "rest", "needed"), "sid"
    ).where("rank < needed").withColumn("block", F.col("rank") % F.col("blocks")).withColumn(
        "turn", F.floor(F.col("rank") / F.col("blocks"))
    )
    held = F.least(F.lit(length), F.col("source_size") - F.col("block") * length)
    part = F.when(F.col("turn") < F.col("turns"), held).otherwise(F.least(held, F.col("rest") - F.col("block") * length))
    return filled.select("slot", "sid", "block", "turn", part.alias("part"))


def placed(rows: DataFrame) -> DataFrame:
    """Where each row's words start in its source's shuffled stream.

    The order is cut into 4,096 cells; a task sums the rows of one cell of one source.
    """
    celled = rows.withColumn("cell", F.shiftrightunsigned("place", 64 - CELL_BITS))
    sums = celled.groupBy("sid", "cell").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"))
    within = Window.partitionBy("sid", "cell").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("size").over(within), F.lit(0))
    return celled.withColumn("inner", inner).join(starts, ["sid", "cell"]).withColumn("start", F.col("cell_start") + F.col("inner"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most=MOST_TIMES, length: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken``, words throughout."""
    spark = docs.sparkSession
    rows = stored(sized(docs), "mix-sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = stored(source_targets(rows, weights, most), "mix-targets")
    # a block's slots take all of it but for one at most, the source's last, which takes ``least`` words
    turns = slot_schedule(spark, targets, total, length).groupBy("sid", "block").agg(
        F.count(F.lit(1)).alias("turns"), F.min("part").alias("least"), F.max("part").alias("all")
    )
    mine, theirs = rows.alias("r"), targets.select("source", "sid", "source_size", "target").alias("t")
    known = mine.join(theirs, F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", "size", "place", "sid", "source_size", "target"
    )
    end = F.col("start") + F.col("size")
    cut = placed(known.where("size > 0")).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((end - 1) / length)))
    )
    first = F.col("block") * length

    def inside(words: Column) -> Column:
        """The row's words among the first ones of the block."""
        return F.greatest(F.least(end, first + words) - F.greatest(F.col("start"), first), F.lit(0))

    often = F.coalesce((F.col("turns") - 1) * inside(F.col("all")) + inside(F.col("least")), F.lit(0))
    taken = (
        cut.join(turns, ["sid", "block"], "left")
        .groupBy("sid", "start", "doc_id", "size", "source_size", "target").agg(F.sum(often).alias("taken"))
    )
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    empty = known.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    return taken.select(columns).unionByName(empty.select(columns))
