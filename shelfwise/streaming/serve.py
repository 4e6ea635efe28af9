"""Continuous recommendation: a stream of request files against a stored catalogue."""

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans.recommend import Recommender
from shelfwise.session import checkpointed, scratch
from shelfwise.sources.catalogue import accepted, rejected, request_lines


def request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of request files as they come, good and bad; see ``request_lines``."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return request_lines(reader.text(path))


def serve(recommender: Recommender, requests: DataFrame, out: str, progress: str, rejects: str | None = None):
    """Answer each micro-batch into its own folder; a retried batch overwrites itself.

    ``progress`` is the folder of the stream's offsets. Lines that are no request
    go to the folder ``rejects``, by batch, if one is named. Intermediate tables are
    removed with their batch. The query stops when all requests on hand are
    answered; start it again for later ones.
    """

    def answer(batch: DataFrame, batch_id: int):
        with scratch(batch.sparkSession):
            rows = checkpointed(batch)
            if rejects is not None:
                rejected(rows).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
            ranked = recommender.recommend(accepted(rows))
            ranked.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
