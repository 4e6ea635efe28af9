import hashlib
import random
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from cases import KINDS, no_docs, odd_docs, odd_rows

from shelfwise.llm import repeats, substrings, suffixes
from shelfwise.session import small_table


def order_of(rows):
    """Distinct documents in order; ids must tell texts apart."""
    return sorted({(i is not None, i or 0, t) for i, t, *_ in rows if t is not None})


def brute_words(rows, window=20):
    seen, gone = set(), defaultdict(set)
    for known, i, text in order_of(rows):
        words = text.encode().split()
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if key in seen:
                gone[known, i] |= set(range(at, at + window))
            seen.add(key)
    out = []
    for i, text, *_ in rows:
        words, bad = (text or "").encode().split(), gone[i is not None, i or 0]
        kept = b" ".join(w for k, w in enumerate(words) if k not in bad)
        out.append((i, len(words), len(words) - sum(k not in bad for k in range(len(words))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, length=400):
    places = defaultdict(list)
    for known, i, text in order_of(rows):
        data = text.encode()
        for at in range(len(data) - length + 1):
            places[data[at : at + length]].append(((known, i), at))
    gone = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for doc, at in found:
                gone[doc] |= set(range(at, at + length))
    out = []
    for i, text, *_ in rows:
        data, bad = (text or "").encode(), gone[i is not None, i or 0]
        kept = bytes(b for k, b in enumerate(data) if k not in bad)
        spans = sum(k in bad and k - 1 not in bad for k in range(len(data)))
        out.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def copies(seed):
    """Documents that share passages, with changed words and with different text on either side."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["ü", "the", "of"]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = [prose(n) for n in (19, 20, 21, 45, 90, 160, 300)]
    rows = []
    for i in range(90):
        words = prose(rnd.randrange(40))
        for _ in range(rnd.randrange(4)):
            part = list(rnd.choice(shared))
            if rnd.random() < 0.4:
                part[rnd.randrange(len(part))] = "changed"
            words += part + prose(rnd.randrange(30))
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(words), "en", "s", 1))
    rows += [(200, "a b " * 700, "en", "s", 1), (201, "a b " * 150 + "c " + "a b " * 150, "en", "s", 1)]
    rows += [(202, "x" * 1500, "en", "s", 1), (203, "\0" * 450 + "x" * 450 + "\0" * 449, "en", "s", 1), (204, "", "en", "s", 1)]
    return rows + rows[3:6]


CASES = [copies(1), copies(2), [r for r in odd_rows() if r[0] != 108]]


def result(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("most", [2000, 2])
def test_words(spark, rows, most):
    docs = small_table(spark, KINDS, rows)
    got = substrings.dedup_substrings(docs, replace(substrings.WORDS, most=most))
    assert result(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows)
    for r in got.collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("most", [2000, 2])
def test_bytes(spark, rows, most):
    docs = small_table(spark, KINDS, rows)
    got = suffixes.dedup_suffixes(docs, replace(suffixes.BYTES, most=most))
    assert result(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows)


def test_odd_tables(spark):
    docs = odd_docs(spark)
    for made in (substrings.dedup_substrings, suffixes.dedup_suffixes):
        assert made(docs).count() == docs.count()
        assert made(docs).where("doc_id IS NULL").count() == 2
        assert made(no_docs(spark)).count() == 0
        assert made(docs.where("text IS NULL")).where("n_removed = 0").count() == docs.where("text IS NULL").count()


@pytest.mark.parametrize("words", [True, False])
def test_pieces_hold_every_window_once(words):
    rnd = random.Random(7)
    spec = repeats.Windows(length=20, gram=5, words=words, most=10)
    texts = [b" ".join(rnd.choice([b"a", b"b", b"cc"]) for _ in range(rnd.randrange(60))) for _ in range(30)] + [b"", b"  "]
    doc, at, more, anchor, _ = repeats.pieces_of(texts, spec)
    got = sorted((d, w) for d, a, m in zip(doc.tolist(), at.tolist(), more.tolist()) for w in range(a, a + m + 1))
    held = [t.split() if words else t for t in texts]
    assert got == [(d, w) for d, h in enumerate(held) for w in range(len(h) - 19)]
    by = {}
    for d, a, m, x in zip(doc.tolist(), at.tolist(), more.tolist(), anchor.tolist()):
        for w in range(a, a + m + 1):
            assert by.setdefault(tuple(held[d][w : w + 20]), x) == x  # equal windows, equal anchors


def test_automaton_matches():
    rnd = random.Random(3)
    for _ in range(40):
        shard = substrings.Automaton()
        texts = [[rnd.choice("ab") for _ in range(rnd.randrange(15))] for _ in range(4)]
        for t in texts[:-1]:
            shard.add(t)
        joined = {tuple(t[i:j]) for t in texts[:-1] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        last = texts[-1]
        want = [max([0, *(n for n in range(1, i + 2) if tuple(last[i + 1 - n : i + 1]) in joined)]) for i in range(len(last))]
        assert list(shard.matches(last)) == want


def test_suffix_array_and_maximal_repeats():
    rnd = random.Random(5)
    for _ in range(150):
        pieces = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(2, 6))]
        least = rnd.choice([2, 3, 5, 9])
        places = defaultdict(list)
        for p, text in enumerate(pieces):
            for i in range(len(text)):
                for n in range(least, len(text) - i + 1):
                    places[text[i : i + n]].append((p, i))
        want = set()
        for s, found in places.items():
            lefts = {pieces[p][i - 1] if i else (p, i) for p, i in found}
            rights = {pieces[p][i + len(s)] if i + len(s) < len(pieces[p]) else (p, i) for p, i in found}
            if len(found) > 1 and len(lefts) > 1 and len(rights) > 1:
                want.add((len(s), tuple(sorted(found))))
        got = {(n, tuple(sorted(at))) for n, at in suffixes.repeats_in(pieces, least)}
        assert got == want
    order, common = suffixes.enhanced_suffix_array(np.zeros(5, np.int64) + 1, 0, 8)
    assert order.tolist() == [4, 3, 2, 1, 0] and common.tolist() == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("most", [2000, 3])
def test_groups_list_every_place(spark, most):
    rows = CASES[0]
    docs = small_table(spark, KINDS, rows)
    found = suffixes.repeat_groups(docs, replace(suffixes.BYTES, most=most)).collect()
    texts = {i: t.encode() for _, i, t in order_of(rows)}
    groups = defaultdict(set)
    for r in found:
        groups[r.group, r.length].add((r.doc_id, r.at))
    assert len(found) == sum(map(len, groups.values())) and groups
    strings = set()
    for (_, length), places in groups.items():
        i, at = min(places)
        string = texts[i][at : at + length]
        every = {(i, k) for i, t in texts.items() for k in range(len(t) - length + 1) if t.startswith(string, k)}
        assert len(string) == length >= 400 and places == every
        strings.add(string)
    assert len(strings) == len(groups)
    assert most < 2000 or any(length > 400 for _, length in groups)
    gone = defaultdict(set)
    for (_, length), places in groups.items():
        for i, at in places:
            gone[i] |= set(range(at, at + length))
    want = {r[0]: r[2] for r in brute_bytes(rows)}
    assert {i: len(gone[i]) for i in texts} == {i: want[i] for i in texts}


def test_no_groups(spark):
    assert suffixes.repeat_groups(no_docs(spark)).count() == 0
