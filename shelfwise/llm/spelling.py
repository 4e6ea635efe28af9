"""Spelling variants: words one edit apart, and the commonest spelling that each leads to.

A word's letters, as a multiset, are a binary vector with one place for the first,
second, ... copy of each letter. One inserted or deleted letter changes one place,
one replaced letter two. PartEnum: the letters are dealt to ``groups`` groups, and
a word emits, for every choice of two groups left out, a signature of what it has
in the others (of one group left out, for words that differ in length). Two vectors
at distance two or less agree on some signature, exactly. A signature also holds
the first or the last half of the word, since one edit leaves one of them as it is;
without it, words of the same syllables in another order would all meet. Words that
share a signature are joined, and the edit is verified in the join, so pairs that
are not near are never written.

Defined results: a null text has no words; a null doc_id is written as nothing
before the colon; repeated rows count once each; a word without near words has null
``form`` and ``form_n`` and itself as ``root``; an empty table gives no rows.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored

LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_LENGTH, LEAST_COUNT, TIMES, NOISE, GROUPS = 6, 5, 5, 199, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted_words(docs: DataFrame, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, noise=NOISE) -> DataFrame:
    """``word, n``: the runs of letters in lower case, those that ``noise`` picks without one letter.

    Equal words are combined before the shuffle, so a word that fills a third of the text is one row a task.
    """
    # a run found this way is maximal: a shorter one never starts the search anew within itself and succeeds
    runs = F.regexp_extract_all(docs["text"], F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run"))
    key = F.concat(F.coalesce(F.col("id"), F.lit("")), F.lit(":"), F.col("run"))
    at = (F.col("hash") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (
        docs.select(docs["doc_id"].cast("string").alias("id"), F.explode(runs).alias("run"))
        .withColumn("run", run).withColumn("hash", F.crc32(key))
        .select(F.when(F.col("hash") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    )


def signatures(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``word, n, replaced, key``: one row per signature; ``replaced`` marks those for words of one length.

    A word stands among those of its own length as the shorter one of a pair, and
    of one letter less as the longer one.
    """
    letters = F.array_sort(F.split("word", ""))
    in_group = lambda g: F.array_join(F.filter(letters, lambda x: F.ascii(x) % groups == g), "")
    parts = words.select("word", "n", F.length("word").alias("size"), *[in_group(g).alias(f"g{g}") for g in range(groups)])
    have = lambda out: [F.col(f"g{g}") for g in range(groups) if g not in out]

    def keys(replaced: bool, out: tuple, size: Column, first: Column) -> list[Column]:
        halves = (F.substring("word", F.lit(1), first), F.substring("word", F.col("size") - (size - first) + 1, size))
        return [
            F.xxhash64(F.lit(replaced), F.lit(repr(out)), size, F.lit(k), half, *have(out)) for k, half in enumerate(halves)
        ]

    half = lambda size: F.ceil(size / 2).cast("int")
    size = F.col("size")
    same = [k for out in combinations(range(groups), 2) for k in keys(True, out, size, half(size))]
    other = [k for g in range(groups) for s in (size, size - 1) for k in keys(False, (g,), s, half(s))]
    marked = [F.struct(F.lit(replaced).alias("replaced"), k.alias("key")) for replaced, ks in ((True, same), (False, other)) for k in ks]
    return parts.select("word", "n", F.inline(F.array(*marked)))


def near_pairs(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``word, n, other, other_n``: each pair of words that are one edit apart, once, the lesser word first.

    The signatures are written first, so that the join on a hot one can be split.
    """
    held = stored(signatures(words, groups), "spelling-signatures")
    a, b = held.alias("a"), held.alias("b")
    met = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word"))
        & (F.col("a.replaced") | (F.length("a.word") != F.length("b.word")))
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    found = a.join(b, met).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))
    return found.dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of forms from each word ends.

    Every step doubles the length that is followed. A form has several times the count of its word, so chains are short.
    """
    ends = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = stored(ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "spelling-roots")
        if ends.where("next IS NOT NULL").isEmpty():
            return ends.drop("next")
        ends = ends.drop("next")


def group_spellings(docs: DataFrame, groups: int = GROUPS, times: int = TIMES, **counting) -> DataFrame:
    """Per word: ``word, form, root, n, n_near, form_n``."""
    words = stored(counted_words(docs, **counting), "spelling-words")
    pair = near_pairs(words, groups)
    side = lambda word, form, n: F.struct(F.col(word).alias("word"), F.col(form).alias("form"), (-F.col(n)).alias("rank"))
    sides = pair.select(F.inline(F.array(side("word", "other", "other_n"), side("other", "word", "n"))))
    best = F.min(F.struct("rank", "form"))
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    much = F.col("n") * times <= -F.col("best.rank")
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(much, F.col("best.form")).alias("form"), F.when(much, -F.col("best.rank")).alias("form_n"),
    ), "spelling-forms")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
