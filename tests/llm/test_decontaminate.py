import math
import random
import re

from cases import no_docs, odd_docs, rows_of

from shelfwise.llm import decontaminate
from shelfwise.session import small_table


def sets(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, items):
    out = set()
    for i, text in docs:
        held = sets(text)
        for j, item in items:
            want = sets(item)
            n = len(want & held)
            if want and n >= math.ceil(0.8 * len(want) - 1e-9):
                out.add((i, j, n, len(want), n / len(want)))
    return sorted(out, key=repr)


def passages(seed):
    rnd = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(300)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, prose(n)) for i, n in enumerate([4, 5, 6, 9, 10, 14, 15, 16, 24, 31, 32, 60, 100])]
    docs = []
    for i in range(80):
        text = prose(rnd.randrange(400))
        _, item = rnd.choice(items)
        part = list(item)
        for _ in range(rnd.randrange(3)):
            part[rnd.randrange(len(part))] = "changed"
        at = rnd.randrange(len(text) + 1)
        docs.append((i, " ".join(text[:at] + (part if i % 3 else []) + text[at:])))
    items = [(i, ", ".join(words).upper()) for i, words in items]
    return docs, [*items, (50, items[4][1]), (51, None), (52, ""), (None, items[8][1])]


def test_pairs_match_brute_force(spark):
    docs, items = passages(1)
    d = small_table(spark, "doc_id long, text string", docs)
    i = small_table(spark, "item_id long, text string", items)
    assert rows_of(decontaminate.contaminated(d, i).drop("key")) == brute(docs, items)


def test_odd_cases(spark):
    docs = odd_docs(spark)
    items = docs.selectExpr("doc_id AS item_id", "text", "'c' AS n", "'c' AS hashes").where("doc_id IN (3, 106, 107, 104)")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(decontaminate.contaminated(docs, items).drop("key").distinct()) == want
    kept = decontaminate.keep_clean(docs, items)
    bad = {(i, t) for i, t in rows if brute([(i, t)], [(r.item_id, r.text) for r in items.collect()])}
    assert kept.columns == docs.columns and kept.count() == sum((i, t) not in bad for i, t in rows)
    none = no_docs(spark)
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, none.selectExpr("doc_id AS item_id", "text")).count() == 0
