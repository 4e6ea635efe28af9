import random
from collections import Counter

import numpy as np
from cases import no_docs, odd_docs, rows_of

from shelfwise.llm import quality
from shelfwise.session import small_table

SPACE = "\x20\t\n\x0b\x0c\r"


def split(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]


def brute(text):
    text = text or ""
    words = split(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [line for line in text.split("\n") if split(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
    )


def test_counts_match_brute_force(spark):
    docs = odd_docs(spark)
    labels = small_table(spark, "doc_id long, quality int", [(1, 0), (2, 1), (None, 0), (3, None)])
    got = quality.judge_quality(docs, labels)
    want = []
    for r in docs.collect():
        n = brute(r.text)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        want.append((r.doc_id, *n, failed))
    assert rows_of(got.drop("kept", "rule")) == sorted(want, key=repr)
    assert got.where("kept AND base_failed").count() == 0
    assert quality.judge_quality(no_docs(spark), labels).count() == 0
    assert quality.judge_quality(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_odd_bytes():
    texts = ["a\x0bb\x0cc\rd", "ñ€😀 x\xa0y", "a\n a\na\n\n", " ".join("abcdefgh") * 3 + "\n", "#" * 9 + " <b> 5%"]
    found = quality.counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(int(found[n][i]) for n in names) == brute(t)


def test_learned_rules_find_planted_ones():
    rnd = np.random.default_rng(1)
    x, y, noise = rnd.random(3000), rnd.random(3000), rnd.random(3000)
    bad = (x > 0.8) | ((y < 0.3) & (x < 0.4))
    noise[::50] = np.nan
    rules = quality.learn_rules({"x": x, "y": y, "z": noise}, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality._covered(rule, {"x": x, "y": y, "z": noise}, 3000)
    assert (hit & ~bad).sum() < 30 and (bad & ~hit).sum() < 60


def test_rules_and_expression_agree(spark):
    rnd = random.Random(2)
    values = [(float("nan"),) if i % 9 == 0 else (rnd.random(),) for i in range(50)]
    rules = [[quality.Term("a", True, 0.8)], [quality.Term("a", False, 0.3)]]
    df = small_table(spark, "f_a double", [(None if np.isnan(v) else v,) for (v,) in values])
    got = [r[0] for r in df.select(quality.verdict(rules)).collect()]
    assert got == [0 if np.isnan(v) else 1 if v >= 0.8 else 2 if v < 0.3 else 0 for (v,) in values]
