"""Language identification by compression.

Each language has a zstandard dictionary of raw text. A text, in lower case, is encoded with
every dictionary, in chunks so that a long text leans on it throughout, and gets
the language that makes it smallest. It is rejected when the runner-up's size is
nearly as small.

Learned from a bounded sample: ``SAMPLE_ROWS`` labelled rows per language, the
first ``EXCERPT`` characters of each, ``DICTIONARY`` bytes in all per language.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; so is every text when no language was learned; equal sizes go to
the first language by code point; a null doc_id is not held out and never
learned from; repeated rows get equal rows.
"""

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SAMPLE_ROWS, EXCERPT, DICTIONARY, CHUNK, LEVEL = 200, 2000, 32 << 10, 4096, 6
LEAST_MARGIN = 0.004
UNKNOWN = "und"


def remainder() -> Column:
    """The fold of a row: crc32 of its id's text, modulo 3."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def learn(labelled: DataFrame, sample_rows=SAMPLE_ROWS, excerpt=EXCERPT, dictionary=DICTIONARY) -> dict[str, bytes]:
    """A dictionary per language from ``doc_id, text, lang``; rows with a null in text or lang teach nothing."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "excerpt")
    rows = (
        labelled.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
        .select("doc_id", "lang", F.substring(F.lower("text"), 1, excerpt).alias("excerpt"))
        .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample_rows)
        .select("lang", "nth", "excerpt").collect()
    )
    texts: dict[str, bytes] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.nth)):
        held = texts.get(row.lang, b"")
        if len(held) < dictionary:
            texts[row.lang] = held + row.excerpt.encode() + b"\n"
    return {lang: text[:dictionary] for lang, text in texts.items()}


def chunks(text: bytes, size: int = CHUNK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def identifier(dictionaries: dict[str, bytes], level: int = LEVEL):
    """A column function: text to ``(lang, score)``; the score is the relative margin over the runner-up."""
    languages = sorted(dictionaries)

    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for lang in languages:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(
                dict_data=raw, level=level, write_checksum=False, write_content_size=False, write_dict_id=False
            ))
        for texts in batches:
            found, scores = [], []
            for text in texts:
                if not coders or text is None or not any(map(str.isalpha, text)):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                parts = chunks(text.lower().encode())
                sizes = [sum(len(c.compress(p)) for p in parts) for c in coders]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
                found.append(languages[best])
                scores.append(min(1.0, (rest - sizes[best]) / rest))
            yield pd.DataFrame({"lang": found, "score": scores})

    # the annotations are given as such, for tasks load this function without its module
    identify.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(identify, "lang string, score double")


def trained(docs: DataFrame):
    return identifier(learn(docs.where(remainder() != 1)))


def identify_language(docs: DataFrame, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score, rejected``."""
    found = trained(docs)(F.col("text"))
    return docs.select("doc_id", found.alias("found")).select(
        "doc_id", F.coalesce(F.col("doc_id").isNotNull() & (remainder() == 1), F.lit(False)).alias("held_out"),
        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        ((F.col("found.lang") == UNKNOWN) | (F.col("found.score") < least_margin)).alias("rejected"),
    )


def keep_identified(docs: DataFrame, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is not rejected."""
    names = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].alias("text"))
    judged = row.withColumn("found", trained(docs)(F.col("text")))
    good = (F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= least_margin)
    return judged.where(good).select("row.*")
