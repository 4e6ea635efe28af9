"""Build and load what the recommender serves from."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators.filters import ID_SPAN, VALUE_KEYS, with_id_span, with_value_keys
from shelfwise.operators.resolve import all_known_values
from shelfwise.plans.recommend import Recommender
from shelfwise.sources import catalogue as files


def encode_catalogue(catalogue: DataFrame, encoder, text: str = "text_corpus") -> DataFrame:
    """``item_id`` and the vector of each item's text."""
    return encoder.encode(catalogue, text, "embedding").select("item_id", "embedding")


def build_model(catalogue: DataFrame, encoder, directory: str, model_name: str) -> None:
    """Write the catalogue, its vectors, both in one table, and the manifest.

    The joint table is what a request batch scans. It is stored by spans of ids,
    so that looking up a few items reads a few spans, and within a span by
    variety, country and price, so that a batch that bounds them skips pages. Each part is read back from
    what was written, so the texts are encoded once.
    """
    spark = catalogue.sparkSession
    files.write_catalogue(catalogue, f"{directory}/catalogue")
    stored = files.read_catalogue(spark, f"{directory}/catalogue")
    encoded = encoder.encode(stored, "text_corpus", "embedding")
    build_items(encoded, directory, model_name)


def build_items(items: DataFrame, directory: str, model_name: str = "given") -> None:
    """Write what serving needs from a catalogue that has its vectors: items by span, vectors, manifest, known values."""
    spark = items.sparkSession
    joint = with_value_keys(with_id_span(items.withColumn("embedding", items["embedding"].cast("array<float>"))))
    clustered = [c for c in (*VALUE_KEYS.values(), "price", "item_id") if c in joint.columns]
    by_span = joint.hint("rebalance", ID_SPAN).sortWithinPartitions(ID_SPAN, *clustered)  # a span of wide rows is written by several tasks
    by_span.write.mode("overwrite").partitionBy(ID_SPAN).parquet(f"{directory}/items")
    stored = files.read_catalogue(spark, f"{directory}/items")
    files.write_vectors(stored, f"{directory}/vectors")
    files.write_manifest(files.manifest(stored, model_name), f"{directory}/manifest")
    all_known_values(stored).write.mode("overwrite").parquet(f"{directory}/known_values")


@dataclass
class Artifacts:
    catalogue: DataFrame
    vectors: DataFrame
    items: DataFrame
    known: DataFrame
    manifest: DataFrame

    def recommender(self, encoder, **settings) -> Recommender:
        return Recommender(self.items, encoder, known=self.known, **settings)


def load_model(spark: SparkSession, directory: str) -> Artifacts:
    """The written parts as lazy tables."""
    return Artifacts(
        catalogue=files.read_catalogue(spark, f"{directory}/catalogue"),
        vectors=files.read_vectors(spark, f"{directory}/vectors"),
        items=spark.read.parquet(f"{directory}/items"),
        known=spark.read.parquet(f"{directory}/known_values"),
        manifest=files.read_manifest(spark, f"{directory}/manifest"),
    )


