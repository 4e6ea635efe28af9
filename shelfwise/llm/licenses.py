"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a window of words, each overlapping the next by half, of the whole
text whatever its line breaks (``whole_texts``), or of a single line. It meets a
template when it holds at least ``THRESHOLD`` of the template's distinct words.
Windows follow the templates: 64 words for templates of up to 32, and for longer
ones twice the next power of two, so that every template lies whole in some
window. Templates of one such size class are searched for together.

Words of the templates are ordered by their frequency in all texts, rarest
first. With n words in a template and ``need`` of them wanted, a block that meets
it shares one of the first n - need + 1 words; only those are joined on. The
length filter drops blocks with fewer than ``need`` template words, the
positional filter those whose words after the shared one are too few. What is
left is verified.

Base labels come from phrases whose words stand consecutively, across lines too.

Defined results: a null text is an empty one, with no words; repeated rows get
equal rows; a null doc_id is a value like any other; with equal frequencies
words are ordered by code point; an empty table gives no rows.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import row_key
from shelfwise.session import small_table

THRESHOLD, STRIDE = 0.8, 32
BLOCK = 2 * STRIDE
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # of lower-cased text
RAW_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(low: Column) -> Column:
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def word_ranks(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The place of each template word by its frequency in all texts; one row per template word is gathered."""
    counts = dict(
        docs.select(F.explode(F.split(lowered(F.col("text")), SEPARATORS)).alias("word"))
        .where(F.col("word").isin(vocabulary)).groupBy("word").count().collect()
    )
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def mentions(low: Column, words) -> Column:
    """Whether any of ``words`` is in the text at all, also inside longer words."""
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def stride_of(template: str) -> int:
    """Half the window that a template is looked for in: at least its length, and ``STRIDE``, a power of two."""
    stride = STRIDE
    while stride < len(template.split()):
        stride *= 2
    return stride


def template_matches(
    docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, whole_texts: bool = False
) -> DataFrame:
    """Every block that meets a template: ``key, line, block, template, label, containment``.

    Blocks are cut from whole texts, as line 0, or line by line; they are numbered within a size class.
    """
    ranks = word_ranks(docs, sorted({w for _, text in templates for w in text.split()}))
    found = None
    for stride in sorted({stride_of(text) for _, text in templates}):
        own = {i: template for i, template in enumerate(templates) if stride_of(template[1]) == stride}
        matches = _class_matches(docs, own, ranks, stride, threshold, whole_texts)
        found = matches if found is None else found.unionByName(matches)
    return found


def _class_matches(
    docs: DataFrame, templates: dict[int, tuple[str, str]], ranks: dict[str, int], stride: int, threshold: float, whole_texts: bool
) -> DataFrame:
    """The matches of templates, by their number, that share a window of twice ``stride`` words."""
    spark = docs.sparkSession
    ordered = {i: sorted({ranks[w] for w in text.split()}) for i, (_, text) in templates.items()}
    least = min(needed(len(t), threshold) for t in ordered.values())
    index = [
        (rank, i, place, len(t), needed(len(t), threshold))
        for i, t in ordered.items() for place, rank in enumerate(t[: len(t) - needed(len(t), threshold) + 1])
    ]
    by_rank = {r: w for w, r in ranks.items()}
    prefixes = small_table(spark, "rank int, template int, place int, n int, need int", index)
    bodies = small_table(
        spark, "template int, label string, ranks array<int>", [(i, templates[i][0], t) for i, t in ordered.items()]
    )
    ranked = F.create_map(*[F.lit(x) for pair in sorted(ranks.items()) for x in pair])

    low = lowered(F.col("text"))
    rare = sorted({by_rank[row[0]] for row in index})
    texts = docs.where(mentions(F.lower("text"), rare)).select(row_key().alias("key"), low.alias("low"))
    if whole_texts:
        lines = texts.select("key", F.lit(0).alias("line"), "low")
    else:
        lines = texts.select("key", F.posexplode(F.split("low", "\n")).alias("line", "low")).where(mentions(F.col("low"), rare))

    def rank_of(w):  # the set is hashed, the map is not
        return F.when(w.isin(list(ranks)), F.element_at(F.lit(ranked), w))

    lines = lines.select("key", "line", F.transform(words_of(F.col("low")), rank_of).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - stride - 1, F.lit(0)), F.lit(stride))
    blocks = (
        lines.select("key", "line", "words", F.explode(starts).alias("start"))
        .select("key", "line", (F.col("start") / stride).cast("int").alias("block"), F.slice("words", F.col("start") + 1, 2 * stride).alias("words"))
        .select("key", "line", "block", F.array_sort(F.array_distinct(F.array_compact("words"))).alias("held"))
        .where(F.size("held") >= least)
    )
    probes = blocks.select(
        "key", "line", "block", "held", F.posexplode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("at", "rank")
    )
    after = F.least(F.col("n") - F.col("place") - 1, F.size("held") - F.col("at") - 1)
    candidates = (
        probes.join(F.broadcast(prefixes), "rank")
        .where((F.size("held") >= F.col("need")) & (F.least(F.col("place"), F.col("at")) + 1 + after >= F.col("need")))
        .select("key", "line", "block", "held", "template", "need", "n").distinct()
    )
    overlap = F.size(F.array_intersect("held", "ranks"))
    return (
        candidates.join(F.broadcast(bodies), "template").withColumn("overlap", overlap).where("overlap >= need")
        .select("key", "line", "block", "template", "label", (F.col("overlap") / F.col("n")).alias("containment"))
    )


def phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def stands(i):
        good = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            good = good & (F.get(words, i + k) == part)
        return F.coalesce(good, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), stands)


def phrases_found(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """Per row: ``key, doc_id, n_words, base`` with ``base`` the places and labels of its phrases."""
    low = F.lower("text")
    possible = F.lit(False)
    for phrase in phrases:
        every = F.lit(True)
        for part in phrase.split():
            every = every & low.contains(part)
        possible = possible | every
    read = docs.select(
        row_key().alias("key"), "doc_id", F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("bigint").alias("n_words"),
        F.when(possible, words_of(lowered(F.col("text")))).alias("words"),
    )
    places = [phrase_starts(F.col("words"), p).alias(f"p{i}") for i, p in enumerate(phrases)]
    found = read.select("key", "doc_id", "n_words", F.when(F.col("words").isNotNull(), F.struct(*places)).alias("f"))
    every = F.concat(*[F.col(f"f.p{i}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"f.p{i}") > 0, label) for i, label in enumerate(phrases.values())]))
    return found.select(
        "key", "doc_id", "n_words", F.coalesce(F.size(every), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.coalesce(F.array_distinct(labels), F.array().cast("array<string>")).alias("base"),
    )


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, whole_texts: bool = False
) -> DataFrame:
    """Per row: its phrases, the labels of phrases and templates, and the best containment as score."""
    matches = template_matches(docs, templates, threshold, whole_texts).groupBy("key").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )

    def joined(labels):
        return F.concat_ws(",", F.array_sort(labels))

    none = F.array().cast("array<string>")
    return phrases_found(docs).join(matches, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.array_union("base", F.coalesce("more", none))).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
