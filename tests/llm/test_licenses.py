import re

from cases import no_docs, odd_docs, rows_of

from shelfwise.llm import licenses
from shelfwise.session import small_table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

TEXTS = [
    "Licensed under CC BY-NC 4.0.", "All rights\nreserved.", "ALL RIGHTS RESERVED all rights reserved",
    "x cc-by y CC_BY z", "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.", "the released mit work under a license of its own",
    "general public licenses", "cc " * 70 + "by", "", None, "İ all rights reserved é", "K CC by",
    ("filler words go here and there " * 30) + "permission is hereby granted free of charge to any person "
    "obtaining a copy of this software" + " and more of the same" * 40,
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "redistribution use source binary forms permitted",
]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower), [WORD.findall(line) for line in lower.split("\n")]


def brute(doc_id, text):
    every, lines = words(text)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        found = [i for i in range(len(every)) if every[i : i + len(parts)] == parts]
        starts += found
        labels |= {label} if found else set()
    more, best = set(labels), 0.0
    for line in lines:
        for at in range(0, max(len(line) - licenses.STRIDE, 1), licenses.STRIDE):
            block = set(line[at : at + licenses.BLOCK])
            for label, template in licenses.TEMPLATES:
                want = set(template.split())
                share = len(want & block) / len(want)
                if share >= licenses.THRESHOLD - 1e-12:
                    more.add(label)
                    best = max(best, share)
    return (
        doc_id, len(every), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(sorted(more)), best,
    )


def test_scan_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = rows_of(licenses.scan_licenses(small_table(spark, "doc_id long, text string", rows)))
    assert got == sorted((brute(*r) for r in rows), key=repr)


def test_odd_cases(spark):
    docs = odd_docs(spark)
    want = sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert rows_of(licenses.scan_licenses(docs)) == want
    assert licenses.scan_licenses(no_docs(spark)).count() == 0


def whole_brute(doc_id, text):
    every, _ = words(text)
    return brute(doc_id, text)[:-2] + brute(doc_id, " ".join(every))[-2:]


def test_wrapped_headers(spark):
    wrapped = TEXTS + [
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
        "you can redistribute it and/or modify\nit under the terms of the GNU General Public License",
        "\n".join(("filler words go here and there " * 30 + licenses.TEMPLATES[8][1] + " and more of the same" * 9).split()),
    ]
    rows = [(i, t) for i, t in enumerate(wrapped)]
    got = rows_of(licenses.scan_licenses(small_table(spark, "doc_id long, text string", rows), whole_texts=True))
    assert got == sorted((whole_brute(*r) for r in rows), key=repr)
    found = {r[0]: r[-2:] for r in got}
    assert [found[len(TEXTS) + k] for k in range(3)] == [("bsd", 1.0), ("gpl", 1.0), ("mit", 1.0)]


def test_long_templates_lie_whole_in_some_window(spark):
    long = {n: " ".join(f"t{n}w{i}" for i in range(n)) for n in (20, 33, 40, 64, 65, 300)}
    templates = [(f"l{n}", text) for n, text in long.items()]
    assert [licenses.stride_of(t) for t in long.values()] == [32, 64, 64, 64, 128, 512]
    rows = []
    for n, text in long.items():
        for before in (0, 1, 31, 33, 63, 100, 127, 500):
            rows.append((len(rows), " ".join(["other"] * before + [text] + ["words"] * (before % 7)).replace(" ", "\n"), f"l{n}", 1.0))
        parts = text.split()
        rows.append((len(rows), " ".join(parts[: -(-4 * n // 5)]), f"l{n}", -(-4 * n // 5) / n))
        rows.append((len(rows), " ".join(parts[: 4 * n // 5 - 1]), "", 0.0))
    docs = small_table(spark, "doc_id long, text string", [r[:2] for r in rows])
    found = licenses.scan_licenses(docs, templates, whole_texts=True).select("doc_id", "labels", "score")
    assert rows_of(found) == sorted([(i, label, score) for i, _, label, score in rows], key=repr)
