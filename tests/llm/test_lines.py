import hashlib
import random

import pytest
from cases import no_docs, odd_docs, odd_rows, rows_of
from pyspark.sql import functions as F

from shelfwise.llm import lines
from shelfwise.session import small_table


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, min_chars=lines.MIN_CHARS):
    """Per row its text without the lines that an earlier line is within one edit of. Ids must tell texts apart."""
    docs = {}
    for i, text, *_ in rows:
        docs[(i is not None, i or 0)] = text
    places = [(d, p, l) for d in sorted(docs) for p, l in enumerate((docs[d] or "").split("\n")) if len(l) >= min_chars]
    gone = set()
    for n, (d, p, l) in enumerate(places):
        if any(abs(len(l) - len(m)) <= 1 and (l == m or edits(l, m) <= 1) for _, _, m in places[:n]):
            gone.add((d, p))
    out = []
    for i, text, *_ in rows:
        d = (i is not None, i or 0)
        split = (text or "").split("\n") if text is not None else []
        kept = "\n".join(l for p, l in enumerate(split) if (d, p) not in gone)
        n = sum((d, p) in gone for p in range(len(split)))
        out.append((i, len(split), n, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def near_rows():
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abc ñ") for _ in range(n)) for n in (15, 16, 17, 31, 32, 33, 48, 64, 200)]
    made = list(base)
    for line in base:
        for _ in range(5):
            at, c = rnd.randrange(len(line)), rnd.choice("abcz€")
            made += [line[:at] + c + line[at + 1 :], line[:at] + line[at + 1 :], line[:at] + c + line[at:]]
            made.append(line[:at] + "qq" + line[at + 2 :])
    rnd.shuffle(made)
    return [(i, "\n".join(made[i * 4 : i * 4 + 4]), "en", "s", 1) for i in range(len(made) // 4 + 1)]


@pytest.mark.parametrize("make", [near_rows, lambda: [r for r in odd_rows() if r[0] not in (None, 108)]])
def test_report_matches_brute_force(spark, make):
    rows = make()
    df = small_table(spark, "doc_id long, text string, lang string, source string, n_chars long", rows)
    assert rows_of(lines.line_report(df)) == brute(rows)


def test_odd_cases_and_columns(spark):
    docs = odd_docs(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert lines.dedup_lines(no_docs(spark)).count() == 0 and lines.line_report(no_docs(spark)).count() == 0


def test_variant_hashes(spark):
    texts = ["abcdefghij" * 3, "ñandú nandú", "x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    got = {r.line: dict(r.v) for r in df.select("line", F.map_from_entries(lines.variants(F.col("line"))).alias("v")).collect()}
    shorter = [(t, i, t[:i] + t[i + 1 :]) for t in texts for i in range(len(t))]
    whole = {
        r.line: dict(r.v)[-1] for r in spark.createDataFrame([(s,) for _, _, s in shorter], "line string")
        .select("line", F.map_from_entries(lines.variants(F.col("line"))).alias("v")).collect()
    }
    for t, i, s in shorter:
        assert got[t][i] == whole[s]


def test_short_lines_are_judged(spark):
    rows = [
        (1, "Les.\nx\n\n  \nAnd ornd."), (2, "Les.\nWh the.\n\n  \nWh the"), (3, "And ornd.\ny\nLes\n\t\nSomething longer than all"),
    ]
    got = {r.doc_id: r.text for r in lines.dedup_lines(small_table(spark, "doc_id long, text string", rows)).collect()}
    assert got == {1: "Les.\nx\n\n  \nAnd ornd.", 2: "Wh the.\n\n  ", 3: "\t\nSomething longer than all"}


def test_short_lines_match_brute_force(spark):
    rnd = random.Random(8)
    made = ["".join(rnd.choice("abñ€") for _ in range(rnd.randint(1, 18))) for _ in range(160)]
    rows = [(i, "\n".join(made[i * 4 : i * 4 + 4])) for i in range(40)]
    assert rows_of(lines.line_report(small_table(spark, "doc_id long, text string", rows))) == brute(rows, 1)
