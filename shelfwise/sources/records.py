"""CSV records with line breaks in quoted cells, read by as many tasks as a file has splits.

Lines are read as text, which Spark can split. Whether a line starts a record
hangs on how many quotes stand before it in its file, and only their parity
matters. A task cannot know the parity that its split starts with, so it works
out the record of each line for both; the parities of the splits are then summed
along each file, which picks one. Lines that are a record of their own, nearly
all, stay where they are; only those of longer records are shuffled together.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.filters import bounded_broadcast
from shelfwise.session import new_path

_LINES = "file string, start bigint, id bigint, odd boolean, value string, after int, of0 bigint, of1 bigint"
BLOCK_ROW_BYTES = 300


def _numbered(batches):
    """Adds the parity of quotes up to the end of each line, and the first line of its record if its split starts
    outside (``of0``) or inside (``of1``) a quoted cell; -1 for a record that starts before the split."""
    block, parity, last = None, 0, [-1, -1]
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        ids = batch.column("id").to_numpy()
        odd = batch.column("odd").to_numpy(zero_copy_only=False).astype(np.int64)
        after, of = np.zeros(len(ids), np.int32), np.full((2, len(ids)), -1, np.int64)
        keys = list(zip(files, starts))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if keys[a] != block:
                block, parity, last = keys[a], 0, [-1, -1]
            upto = (parity + np.cumsum(odd[a:b])) % 2
            before = (upto - odd[a:b]) % 2
            for p in (0, 1):
                opens = np.where((before + p) % 2 == 0, ids[a:b], -1)
                of[p, a:b] = np.maximum.accumulate(np.maximum(opens, last[p]))
                last[p] = int(of[p, b - 1])
            after[a:b], parity = upto, int(upto[-1])
        columns = [batch.column(c) for c in ("file", "start", "id", "odd", "value")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(after), pa.array(of[0]), pa.array(of[1])],
            ["file", "start", "id", "odd", "value", "after", "of0", "of1"],
        )


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, record, is_first``: each record's text, numbered in file order; blank lines between records are left out.

    Quotes are doubled within a quoted cell, as in RFC 4180; a cell that is not quoted holds none. The lines
    are written once to the shared folder, so that all steps see the same splits.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), (quotes % 2 == 1).alias("odd"), "value",
    ).mapInArrow(_numbered, _LINES)
    held = new_path(spark, "csv-lines")
    lines.write.option("compression", "zstd").parquet(held)
    lines = spark.read.schema(lines.schema).parquet(held)

    blank = F.trim("value", F.lit(" \t\r")) == ""
    end = F.max_by(F.struct("after", "of0", "of1"), "id").alias("end")
    first = F.min(F.when(~blank, F.col("id"))).alias("first")
    along = Window.partitionBy("file").orderBy("start")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("end.after").over(earlier), F.lit(0)) % 2
    open_ = F.when(
        (F.col("inside") + F.col("end.after")) % 2 == 1, F.nullif(F.when(F.col("inside") == 0, F.col("end.of0")).otherwise(F.col("end.of1")), F.lit(-1))
    )
    splits = (
        lines.groupBy("file", "start").agg(end, first).withColumn("inside", inside).withColumn("open", open_)
        .select(
            "file", "start", "inside", F.last("open", ignorenulls=True).over(earlier).alias("goes_on"),
            F.min("first").over(Window.partitionBy("file")).alias("first"),
        )
    )
    told = lines.join(bounded_broadcast(splits, splits.count(), BLOCK_ROW_BYTES), ["file", "start"])
    own = F.when(F.col("inside") == 0, F.col("of0")).otherwise(F.col("of1"))
    of = told.withColumn("row", F.when(own == -1, F.col("goes_on")).otherwise(own))
    alone = (F.col("row") == F.col("id")) & ~F.col("odd")
    single = of.where(alone & ~blank).select("file", "row", F.col("value").alias("record"), "first")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: x["value"])
    several = of.where(~alone).groupBy("file", "row", "first").agg(F.array_join(parts, "\n").alias("record"))
    return single.unionByName(several).select(
        "file", "row", F.regexp_replace("record", r"\r$", "").alias("record"), (F.col("row") == F.col("first")).alias("is_first")
    )
