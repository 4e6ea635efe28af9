"""Documents with every odd case, and helpers for comparing with plain Python."""

import random

from shelfwise.session import small_table

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside
CLASHES = ("key", "row", "pos", "hash", "fp", "line", "found", "size", "anchor", "_row", "_key", "root", "gone")


def odd_rows(seed: int = 0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}x" for i in range(40)] + ["Über", "ñandú", "the", "of"]

    def prose(n, lines=1):
        words = [rnd.choice(vocabulary) for _ in range(n)]
        cut = sorted(rnd.sample(range(1, n), lines - 1)) if lines > 1 else []
        return "\n".join(" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, n]))

    shared = prose(60)
    rows = [(i, prose(rnd.randint(3, 120), rnd.randint(1, 3)), "en", f"s{i % 3}") for i in range(30)]
    rows += [
        (100, None, "en", "s0"), (101, "", None, "s1"), (102, "   \t ", "de", None), (103, "\n\n\n", "de", None),
        (104, "x", "fr", "s9"), (None, prose(50), "en", "s0"), (None, None, None, None),
        (105, prose(20) + "\n" + shared, "en", "s1"), (106, shared, "en", "s1"), (107, shared, "en", "s2"),
        (108, prose(5) + " " + shared + " " + prose(9), "en", "s0"), (108, "another text for the same id " + prose(30), "en", "s0"),
        (109, prose(4000, 40), "en", "s0"), (110, (prose(25) + "\n") * 6, "en", "s0"), (111, "word " * 300, "en", "s1"),
    ]
    rows += [rows[5], rows[38], rows[30]]  # repeated rows
    rnd.shuffle(rows)
    return [(i, t, la, so, None if t is None else len(t)) for i, t, la, so in rows]


def odd_docs(spark, seed: int = 0, clashes: bool = True):
    df = small_table(spark, KINDS, odd_rows(seed))
    return df.selectExpr("*", *[f"'c' AS {c}" for c in CLASHES]) if clashes else df


def no_docs(spark):
    return spark.createDataFrame([], KINDS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
