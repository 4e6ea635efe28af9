"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

A stage is written as Parquet to the shared folder and read back as the next
one's ``docs``, so a lost executor costs its tasks only.
"""

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.common import stored, table
from shelfwise.llm.decontaminate import keep_clean
from shelfwise.llm.langid import keep_identified
from shelfwise.llm.lines import dedup_lines
from shelfwise.llm.mixing import mix_sources
from shelfwise.llm.simhash import keep_first


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the others go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line repeats, within one edit."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash; groups that share an id all keep theirs."""
    return keep_first(docs, one_per_id=False)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontaminate", decontaminate), ("mix", mix),
]

#: The first stage compresses texts, which SQL can't; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
