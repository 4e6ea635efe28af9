"""Spelling groups against a plain version that compares all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest
from cases import no_docs, odd_docs, rows_of

from shelfwise.llm import queries, spelling
from shelfwise.llm.common import table
from shelfwise.session import small_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOWN = str.maketrans(spelling.UPPER, spelling.UPPER.lower())


def plain_words(docs, least_length, least_count, noise):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(DOWN)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(docs, times=5, groups=None, least_length=6, least_count=5, noise=199):
    words = plain_words(docs, least_length, least_count, noise)
    near = {w: [] for w in words}
    held = sorted(words)
    for i, a in enumerate(held):
        for b in held[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(rows, key=repr)


def check(df, **how):
    want = plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], **how)
    assert rows_of(spelling.group_spellings(df, **how)) == want
    return want


def test_query_is_the_operator(spark):
    got = queries.op13_spelling(spark, "/root/testdata/sf0.001")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == plain([(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()])


def test_odd_documents(spark):
    check(odd_docs(spark), least_length=2, least_count=1)
    assert rows_of(spelling.group_spellings(no_docs(spark))) == []
    assert rows_of(spelling.group_spellings(odd_docs(spark).where("text IS NULL"))) == []


@pytest.mark.parametrize("groups", [3, 4, 6])
def test_edits_ties_and_chains(spark, groups):
    rnd = random.Random(groups)
    letters = "abcdeéÿ"
    seeds = ["".join(rnd.choices(letters, k=rnd.randint(6, 9))) for _ in range(15)]

    def edited(w):
        i, how = rnd.randrange(len(w)), rnd.randrange(4)
        c = rnd.choice(letters)
        return [w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], "".join(rnd.sample(w, len(w)))][how]

    words, level = [w for w in seeds for _ in range(150)], seeds
    for times in (25, 5, 1):
        level = [edited(w) for w in level for _ in range(2)]
        words += [w for w in level for _ in range(times)]
    rnd.shuffle(words)
    docs = [(i, " ".join(words[i::7]), "c") for i in range(7)] + [(None, "ABCDEF ABCDEÉ " * 3, "c")]
    df = small_table(spark, "doc_id long, text string, word string", docs)
    want = check(df, groups=groups, least_count=1) if groups == 4 else None
    got = rows_of(spelling.group_spellings(df, groups=groups, least_count=1))
    want = want or plain([(i, t) for i, t, _ in docs], least_count=1)
    assert got == want
    assert any(form and root != form for _, form, root, *_ in want)  # a chain


def test_noise_deletes_a_letter(spark):
    docs = [(i, "exemplary Straße") for i in range(3000)]
    want = check(small_table(spark, "doc_id long, text string", docs), least_count=1)
    assert len(want) > 5
