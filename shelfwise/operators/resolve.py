"""From search text to items, known values and sort orders."""

import math
import re
import re._parser as sre
import sys
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import parse
from shelfwise.functions.vectors import inner_product
from shelfwise.operators.automaton import Needles
from shelfwise.operators.filters import bounded_broadcast, with_ids
from shelfwise.operators.payload import on_first_row, packed
from shelfwise.session import checkpointed, small_table
from shelfwise.vocab import ANCHOR_THRESHOLD, ANCHORS

# The pattern code travels with the tasks, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 3
NEEDLE_BYTES = 8 << 20  # known values or identifiers that every task is sent at once
PATTERNS = 1 << 14  # compiled patterns that a task keeps, of those that only some titles are tested against
REGEX_SIGNS = r"[\\^$.|?*+()\[\]{}]"


def _grams(c: Column) -> Column:
    """All runs of one to three characters of the text, each once."""
    runs = [
        F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)
    ]
    return F.array_distinct(F.concat(*runs))


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs where ``text`` contains ``needle``, ignoring case; empty needles never match.

    An equi-join on the first three characters of the needle finds the pairs
    that can match, so no text meets every needle.
    """
    keyed_texts = texts.withColumn("_gram", F.explode(_grams(F.lower(text))))
    low = F.lower(needle)
    keyed_needles = needles.where(F.length(needle) > 0).withColumn("_gram", F.substring(low, 1, GRAM))
    joined = keyed_texts.join(keyed_needles, "_gram")
    return joined.where(F.contains(F.lower(text), low)).drop("_gram")


def known_values(catalogue: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, each with the first item that has it."""
    return (
        catalogue.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value")).agg(F.min("item_id").alias("first_id"))
    )


def detect_values(requests: DataFrame, known: DataFrame, word_bounds: bool = False) -> DataFrame:
    """The longest known country and variety named in each modifier text.

    ``known`` has ``kind`` (country or variety), ``value`` and ``first_id``;
    among values of one length the first in the catalogue wins. The test is
    plain containment; ``word_bounds`` asks for whole words.

    The known values go to every task by their first characters, which finds all
    of them in one walk over a text; no text is shuffled. Values too many for that are
    joined on their first characters.
    """
    named = known.where(F.length("value") > 0)
    if (named.agg(F.sum(F.octet_length("value"))).first()[0] or 0) <= NEEDLE_BYTES:
        return _detected(requests, named, word_bounds)
    pairs = contains_join(requests.select("query_id", "modifier"), "modifier", named, "value")
    if word_bounds:
        edge = r"[^\p{L}\p{N}_]"
        quoted = F.concat(F.lit(rf"(^|{edge})\Q"), F.lower("value"), F.lit(rf"\E($|{edge})"))
        pairs = pairs.where(F.rlike(F.lower("modifier"), quoted))
    longest = F.struct(F.length("value"), -F.col("first_id"))

    def best(kind: str) -> Column:
        value = F.when(F.col("kind") == kind, F.col("value"))
        return F.max_by(value, F.when(F.col("kind") == kind, longest)).alias(kind)

    slim = pairs.select("query_id", "kind", "value", "first_id")
    return slim.groupBy("query_id").agg(best("country"), best("variety"))


def _detected(requests: DataFrame, known: DataFrame, word_bounds: bool) -> DataFrame:
    payload = packed(known.select("kind", "value", F.lower("value").alias("low"), F.length("value").alias("size"), "first_id"))
    rows = requests.where("modifier is not null").select(
        "query_id", F.lower("modifier").alias("low"), on_first_row(payload).alias("known")
    )
    kind = requests.schema["query_id"].dataType.simpleString()

    def run(batches):
        finder = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if finder is None:
                values = {}
                for v in batch.column("known").slice(0, 1).flatten().to_pylist():
                    values.setdefault(v["low"], []).append(v)
                finder = Needles(values)
            texts = batch.column("low").to_pylist()
            found = {"country": [], "variety": []}
            for text in texts:
                hits = finder.found(text)
                if word_bounds:
                    hits = [h for h in hits if re.search(rf"(?<!\w){re.escape(h)}(?!\w)", text)]
                named = [v for h in hits for v in values[h]]
                for column, best in found.items():
                    of_kind = [v for v in named if v["kind"] == column]
                    best.append(max(of_kind, key=lambda v: (v["size"], -v["first_id"]), default={"value": None})["value"])
            columns = [batch.column("query_id"), *[pa.array(c, pa.string()) for c in found.values()]]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", *found])

    return rows.mapInArrow(run, f"query_id {kind}, country string, variety string").where(
        "country is not null or variety is not null"
    )


def all_known_values(catalogue: DataFrame) -> DataFrame:
    kinds = [
        known_values(catalogue, kind).select(F.lit(kind).alias("kind"), "value", "first_id")
        for kind in ("country", "variety")
    ]
    return kinds[0].unionAll(kinds[1])


def anchor_table(spark, encoder) -> DataFrame:
    """The four anchor phrases with their vectors."""
    schema = "position int, phrase string, sort_by string, ascending boolean"
    rows = [(i, *anchor) for i, anchor in enumerate(ANCHORS)]
    return encoder.encode(small_table(spark, schema, rows), "phrase", "vector")


def classify_modifier(
    df: DataFrame, encoder, vector: str = "modifier_vector", threshold: float = ANCHOR_THRESHOLD
) -> DataFrame:
    """Add ``sort_by`` and ``ascending`` of the closest anchor that is close enough.

    The anchors are encoded once and reach the rows as a four-element constant.
    """
    anchors = anchor_table(df.sparkSession, encoder)
    score = F.transform(
        F.col("_anchors"),
        lambda a: F.struct(
            inner_product(a["vector"], F.col(vector)).alias("score"),
            (-a["position"]).alias("earlier"),
            a["sort_by"].alias("sort_by"),
            a["ascending"].alias("ascending"),
        ),
    )
    best = df.withColumn("_anchors", packed(anchors)).withColumn("_best", F.array_max(score))
    close = F.col("_best.score") >= threshold
    return best.withColumns(
        {
            "sort_by": F.when(close, F.col("_best.sort_by")),
            "ascending": F.when(close, F.col("_best.ascending")),
        }
    ).drop("_anchors", "_best")


def first_title_match(
    catalogue: DataFrame, wanted: DataFrame, regex: bool = True, rows: int | None = None
) -> DataFrame:
    """For each ``identifier``, the first item whose title matches it, ignoring case.

    Identifiers are patterns unless ``regex`` is off; one that is no valid
    pattern is taken literally. From every pattern a set of texts is derived of
    which each match holds one, as from ``(merlot|malbec) 20\\d\\d`` both names;
    a plain text is its own. All of these are looked for together, so a title is walked
    over once and tested only against the identifiers it can match. Patterns
    without such texts are run on all titles. A task keeps the lowest item per
    identifier and stops testing what cannot be lower. Identifiers go to the
    tasks ``NEEDLE_BYTES`` at a time; ``rows`` is a bound on their number, if known.
    """
    titles = catalogue.where("title is not null").select("item_id", "title")
    wanted = wanted.select("identifier").where("identifier is not null").distinct()
    empty = F.col("identifier") == ""
    is_pattern = (F.col("identifier").rlike(REGEX_SIGNS) | empty) if regex else empty
    needs = checkpointed(wanted.select(
        "identifier", F.lower("identifier").alias("low"), is_pattern.alias("is_pattern"),
        F.when(is_pattern, required_texts(F.col("identifier"))).otherwise(F.array(folded_text(F.col("identifier")))).alias("texts"),
    ))
    size = needs.agg(F.sum(F.octet_length("identifier") + 16)).first()[0]
    if size is None:
        return needs.select("identifier", F.lit(None).cast("long").alias("item_id"))
    passes = 1 if size <= NEEDLE_BYTES else math.ceil(1.5 * size / NEEDLE_BYTES)
    slot = F.pmod(F.xxhash64("identifier"), F.lit(passes))
    if passes > 1:
        titles = checkpointed(titles)
    parts = [_lowest_matches(titles, needs.where(slot == i) if passes > 1 else needs) for i in range(passes)]
    found = reduce(DataFrame.unionAll, parts)
    return found.groupBy("identifier").agg(F.min("item_id").alias("item_id"))


def compiled(pattern: str) -> re.Pattern:
    """The pattern, ignoring case; one that is not valid stands for itself."""
    try:
        return re.compile(pattern, re.IGNORECASE)
    except re.error:
        return re.compile(re.escape(pattern), re.IGNORECASE)


def folded_text(c: Column) -> Column:
    """Letters that a pattern takes for an ASCII one when it ignores case, as that one."""
    return F.lower(F.translate(c, "\u017f\u0130\u0131\u212a", "siik"))


def any_of(tokens) -> list[str] | None:
    """Texts of two ASCII characters or more, lower-cased, one of which every match of parsed ``tokens`` holds."""
    found, runs = [], [""]

    def walk(sequence):
        for op, value in sequence:
            if op is sre.LITERAL and value < 128:
                runs[-1] += chr(value).lower()
            elif op is sre.SUBPATTERN:
                walk(value[3])
            elif op is not sre.AT:
                runs.append("")
                if op is sre.BRANCH:
                    found.append([any_of(branch) for branch in value[1]])
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
                    found.append([any_of(value[2])])

    walk(tokens)
    sets = [[r] for r in runs if len(r) > 1] + [sum(f, []) for f in found if None not in f]
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def required_texts(c: Column) -> Column:
    def find(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else any_of(sre.parse(compiled(p).pattern, re.IGNORECASE)))

    return F.pandas_udf(find, "array<string>")(c)


class _Needs:
    """The identifiers that titles are tested against, by number; what can be left in Arrow's columns is.

    Of a plain text only the key it is found by is held, of a pattern the
    compiled form while it is in use.
    """

    def __init__(self, needs: pa.StructArray):
        self.identifiers = needs.field("identifier")
        self.is_pattern = needs.field("is_pattern").to_numpy(zero_copy_only=False)
        texts = needs.field("texts")
        self.always = [n for n, missing in enumerate(texts.is_null().to_pylist()) if missing]
        self.by_text, self.lows = {}, {}
        of = pc.list_parent_indices(texts).to_pylist()
        for n, text in zip(of, pc.list_flatten(texts).to_pylist()):
            have = self.by_text.get(text)
            if isinstance(have, list):
                have.append(n)
            else:
                self.by_text[text] = n if have is None else [have, n]
        lows = needs.field("low").take(pa.array(of, pa.int64()))
        other = pc.fill_null(pc.not_equal(pc.list_flatten(texts), lows), True).to_numpy(zero_copy_only=False)
        for at in other.nonzero()[0].tolist():
            if not self.is_pattern[of[at]]:
                self.lows[of[at]] = lows[at].as_py()
        self.finder = Needles(self.by_text)
        self.pattern = lru_cache(PATTERNS)(self._compiled)
        self.kept = {n: self._compiled(n) for n in self.always}

    def _compiled(self, n: int):
        return compiled(self.identifiers[n].as_py())

    def candidates(self, folded: str):
        """Identifiers that a title may match, with the text it holds of them."""
        for text in self.finder.found(folded):
            of = self.by_text[text]
            for n in of if isinstance(of, list) else (of,):
                yield n, text
        for n in self.always:
            yield n, ""

    def meets(self, n: int, text: str, title: str, low: str) -> bool:
        if not self.is_pattern[n]:
            return self.lows.get(n, text) in low
        return (self.kept.get(n) or self.pattern(n)).search(title) is not None


def _lowest_matches(titles: DataFrame, needs: DataFrame) -> DataFrame:
    """Per task, the lowest item whose title each identifier matches."""
    payload = packed(needs)
    rows = titles.where(F.size(payload) > 0).select(
        "item_id", "title", F.lower("title").alias("low"), folded_text(F.col("title")).alias("folded"),
        on_first_row(payload).alias("needs"),
    )

    def run(batches):
        needs, lowest = None, {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if needs is None:
                needs = _Needs(batch.column("needs").slice(0, 1).flatten())
            ordered = batch.select(["item_id", "title", "low", "folded"]).sort_by("item_id")
            for item, title, low, folded in zip(*[c.to_pylist() for c in ordered.columns]):
                for n, text in needs.candidates(folded):
                    if item < lowest.get(n, item + 1) and needs.meets(n, text, title, low):
                        lowest[n] = item
        if needs is not None:
            yield pa.RecordBatch.from_arrays(
                [needs.identifiers.take(pa.array(list(lowest), pa.int64())), pa.array(list(lowest.values()), pa.int64())],
                names=["identifier", "item_id"],
            )

    return rows.mapInArrow(run, "identifier string, item_id long")


def resolve_items(
    catalogue: DataFrame, requests: DataFrame, regex: bool = True, rows: int | None = None
) -> DataFrame:
    """Add ``exclude_id``: the item each identifier names, by id or else by title.

    Titles are searched only for requests that no id answers.
    """
    ids = requests.select(F.col("id_wanted").alias("item_id")).where("item_id is not null").distinct()
    by_id = with_ids(catalogue, ids, rows).select(F.col("item_id").alias("_by_id"))
    tried = checkpointed(requests.join(bounded_broadcast(by_id, rows), F.col("id_wanted") == F.col("_by_id"), "left"))
    open_ = tried.where("_by_id is null")
    by_title = first_title_match(catalogue, open_, regex, rows).withColumnRenamed("item_id", "_by_title")
    return (
        tried.join(bounded_broadcast(by_title, rows), "identifier", "left")
        .withColumn("exclude_id", F.coalesce("_by_id", "_by_title"))
        .drop("_by_id", "_by_title")
    )


def parse_requests(
    requests: DataFrame, known: DataFrame, encoder, threshold: float = ANCHOR_THRESHOLD
) -> DataFrame:
    """The full reading of each query text.

    Adds ``identifier``, ``id_wanted``, ``parsed`` (a filter struct), ``sort_by``,
    ``ascending``, ``semantic_modifier`` and its vector.
    """
    split = parse.split_query(requests)
    named = detect_values(split.where("modifier <> ''"), known)
    joined = split.join(named, "query_id", "left")
    text = joined.withColumn("_text", F.nullif("modifier", F.lit("")))
    encoded = encoder.encode(text, "_text", "modifier_vector")
    sorted_ = classify_modifier(encoded, encoder, threshold=threshold)
    style = F.when(F.col("sort_by").isNull(), F.col("_text"))
    parsed = F.struct("price_min", "price_max", "variety", "country", "min_points").alias("parsed")
    return sorted_.select(
        *requests.columns, "identifier", "id_wanted", parsed, "sort_by", "ascending",
        style.alias("semantic_modifier"),
        F.when(F.col("sort_by").isNull(), F.col("modifier_vector")).alias("modifier_vector"),
    )
