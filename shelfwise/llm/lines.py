"""Line dedup: a deletion-neighbourhood join over whole tables.

A line is removed when an earlier line, anywhere, lies within ``EDIT_BOUND`` = 1
edits (a character inserted, deleted or replaced). Earlier means a smaller
doc_id, or the same document and a smaller line number; lines are judged on the
input, so a removed line still removes later ones. Short lines are judged like
long ones; only blank lines, of no characters or of spaces alone, are left alone.

1. Equal lines are combined before they are shuffled, each to its first place.
2. Two lines within one edit share the part before or the part after a cut near
   their middle. Distinct lines that share neither with another are done.
3. The others emit a hash of every variant with one character left out, and of
   the whole line. Lines within one edit meet: with the same variant left by the
   same place (replaced), or one being the variant of the other (inserted).
4. In each meeting the earliest line is the one the others are held against, and
   the edit distance to it is verified.

Defined results: a null text has no lines and stays null; a null doc_id comes
before all others; repeated rows are one document and get equal rows; rows that
repeat an id with other texts are ordered by a hash of the text; an empty table
gives no rows; a text whose lines all go becomes the empty text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import row_key, stored

MIN_CHARS = 1  # no line that is not blank is left out
BLANKS = " \t\r\f\v"
EDIT_BOUND = 1


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key, doc_id, pos, line`` and two hashes that stand for the line."""
    return (
        docs.select(row_key().alias("key"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where((F.length("line") >= min_chars) & (F.trim("line", F.lit(BLANKS)) != ""))
        .select("key", "doc_id", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
    )


def _cut(length: Column) -> Column:
    """Where a line is cut; lines of almost the same length are cut alike but at multiples of 16, and short ones."""
    return F.when(length < 16, F.shiftright(length, 1)).otherwise(F.shiftleft(F.shiftright(length, 4), 3))


def _halves(line: Column) -> Column:
    """Hashes of the parts of which two lines within one edit share one.

    The longer of the two, by a character, may have it before the cut or after.
    """
    n = F.length(line)
    a, b = _cut(n), _cut(n - 1)

    def before(cut):
        return F.xxhash64(F.lit(0), cut, F.substring(line, F.lit(1), cut))

    def after(cut, skip):
        return F.xxhash64(F.lit(1), cut, F.substring(line, cut + 1 + skip, n))

    return F.array_distinct(F.array(before(a), before(b), after(a, 0), after(b, 1)))


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(x))


def variants(line: Column) -> Column:
    """``(place, variant)`` for each left-out character, and for the whole line with place -1.

    A string is hashed as the xor of a hash per character and place, so a
    variant is the xor of what stands before the gap, in place, and of what
    stands after it, one place to the left. Running xors are taken in blocks of
    the root of the length, so a long line costs its length to the power 1.5.
    """

    def hashed(shift):
        return lambda c, i: F.xxhash64(i - shift, c)

    chars = F.split(line, "")

    def emit(s):
        # s: stay, move (hashes in place and one to the left), step = stay ^ move, size = block length
        count = F.ceil(F.size(s["step"]) / s["size"]).cast("int")
        sums = F.transform(
            F.sequence(F.lit(0), count - 1), lambda b: _xor(F.slice(s["step"], b * s["size"] + 1, s["size"]))
        )

        def all_of(t):
            def variant(moved, i):
                block = F.floor(i / s["size"]).cast("int")
                inner = _xor(F.slice(s["step"], block * s["size"] + 1, i % s["size"]))
                before = F.get(t["before"], block).bitwiseXOR(inner)
                return F.struct(i.alias("place"), t["all_moved"].bitwiseXOR(moved).bitwiseXOR(before).alias("variant"))

            whole = F.struct(F.lit(-1).alias("place"), _xor(s["stay"]).alias("variant"))
            return F.concat(F.array(whole), F.transform(s["move"], variant))

        running = F.transform(sums, lambda _, b: _xor(F.slice(sums, F.lit(1), b)))
        return _with(F.struct(running.alias("before"), _xor(s["move"]).alias("all_moved")), all_of)

    def hashes(c):
        stay, move = F.transform(c, hashed(0)), F.transform(c, hashed(1))
        step = F.zip_with(stay, move, lambda x, y: x.bitwiseXOR(y))
        size = F.ceil(F.sqrt(F.size(c))).cast("int")
        return _with(F.struct(stay.alias("stay"), move.alias("move"), step.alias("step"), size.alias("size")), emit)

    return _with(chars, hashes)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each distinct line's first place and number of places; combined before the shuffle."""
    place = F.struct("doc_id", "key", "pos")
    return lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))


def _candidates(lines: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another one."""
    halves = lines.select("h1", "h2", F.explode(_halves(F.col("line"))).alias("half"))
    shared = (
        halves.select("half", "h1").groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
        .where("a <> b").select("half")
    )
    shared = stored(shared, "lines-halves")
    return halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()


def _near(candidates: DataFrame) -> DataFrame:
    """Distinct lines (``h1, h2, first, line``) that an earlier one lies within an edit of: ``h1, h2``."""
    emitted = candidates.select("h1", F.explode(variants(F.col("line"))).alias("v")).select("h1", "v.place", "v.variant")
    group = Window.partitionBy("variant")
    met = stored(
        emitted.withColumn("a", F.min("h1").over(group)).withColumn("b", F.max("h1").over(group)).where("a <> b")
        .select("variant", "place", "h1"), "lines-met",
    )
    rows = met.join(candidates, "h1").select("variant", "place", "h1", "h2", "first", "line")
    me = F.struct("first", "line", "h1")
    earliest = rows.groupBy("variant", "place").agg(F.min(me).alias("other"))
    # the same variant from the same place: a replaced character
    replaced = rows.where("place >= 0").join(earliest, ["variant", "place"])
    # a whole line that is another's variant: an inserted or deleted character, either may be first
    by_variant = rows.where("place >= 0").groupBy("variant").agg(F.min(me).alias("other"))
    shorter = rows.where("place < 0").join(by_variant, "variant")
    longer = rows.where("place >= 0").join(earliest.where("place < 0").drop("place"), "variant")
    columns = ["h1", "h2", "first", "line", "other"]
    pairs = replaced.select(columns).unionByName(shorter.select(columns)).unionByName(longer.select(columns))
    good = (F.col("other.first") < F.col("first")) & (F.levenshtein("line", "other.line", EDIT_BOUND) >= 0)
    return pairs.where(good).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document with any: ``key`` and the numbers of its lines to remove, ``gone``."""
    lines = lines_of(docs, min_chars)
    distinct = stored(distinct_lines(lines), "lines-distinct")
    wanted = stored(
        _candidates(lines).join(distinct, ["h1", "h2"]).select("h1", "h2", "first", F.col("first.key").alias("key"))
        .groupBy("key").agg(F.collect_set(F.struct("h1", "h2", "first")).alias("wanted")), "lines-wanted",
    )
    texts = docs.select(row_key().alias("key"), "text").join(wanted, "key").dropDuplicates(["key"])
    candidates = stored(
        texts.select(F.explode("wanted").alias("w"), F.split("text", "\n").alias("lines"))
        .select("w.h1", "w.h2", "w.first", F.get("lines", F.col("w.first.pos")).alias("line")), "lines-candidates",
    )
    near = _near(candidates).withColumn("near", F.lit(True))
    judged = stored(  # apart from the next join, which can then split a line that is everywhere
        distinct.join(near, ["h1", "h2"], "left").where("n > 1 OR near")
        .select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-judged",
    )
    place = F.struct("doc_id", "key", "pos")
    gone = lines.select("h1", "h2", "key", "doc_id", "pos").join(judged, ["h1", "h2"]).where(
        F.col("near") | (place != F.col("first"))
    )
    return gone.groupBy("key").agg(F.collect_set("pos").alias("gone"))


def _kept(text: Column, gone: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``, all columns as they are, with repeated lines gone from ``text``."""
    gone = removed_lines(docs, min_chars).select(F.col("key").alias("_key"), F.col("gone").alias("_gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key().alias("_key"))
    joined = rows.join(gone, "_key", "left")
    return joined.select(*[
        (_kept(F.col("_row.text"), F.col("_gone")) if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns
    ])


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_removed`` and the SHA-256 of the text that stays."""
    gone = removed_lines(docs, min_chars)
    joined = docs.select(row_key().alias("key"), "doc_id", "text").join(gone, "key", "left")
    return joined.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.sha2(_kept(F.coalesce("text", F.lit("")), F.col("gone")), 256).alias("kept_sha256"),
    )
