"""Results that SQL can't express, row by row against plain Python over whole tables."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
import zstandard
from cases import odd_docs
from test_mixing import plain_targets
from test_quality import brute, split

from shelfwise.llm import langid, mixing, quality
from shelfwise.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def spark_hash(*values) -> int:
    """Spark's hash of a row, unsigned: each value's is the seed of the next, and a null leaves it."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed=seed).intdigest()
    return seed


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def test_predictions_and_scores(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    by = defaultdict(list)
    for i, text, lang in rows:
        if text and lang is not None and not held(i):
            by[lang].append((signed(spark_hash(i)), text.lower()[:2000]))
    coders = []
    for lang in sorted(by):
        raw = b"".join(t.encode() + b"\n" for _, t in sorted(by[lang])[:200])[: 32 << 10]
        shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=6)
        coders.append((lang, zstandard.ZstdCompressor(
            dict_data=shared, level=6, write_checksum=False, write_content_size=False, write_dict_id=False)))
    want = []
    for i, text, _ in rows:
        lang, score = "und", 0.0
        if text and any(c.isalpha() for c in text):
            data = text.lower().encode()
            sizes = sorted((sum(len(c.compress(data[k : k + 4096])) for k in range(0, len(data), 4096)), name) for name, c in coders)
            lang, score = sizes[0][1], 1 - sizes[0][0] / sizes[1][0]
        want.append((i, held(i), lang, pytest.approx(score, abs=1e-12), lang == "und" or score < langid.LEAST_MARGIN))
    got = sorted(tuple(r) for r in langid.identify_language(docs).collect())
    assert got == sorted(want, key=lambda r: r[0]) and len({r[2] for r in got}) > 3


def walked(docs):
    """Each source's words in hashed order, gone round until its target is taken."""
    streams, sizes = defaultdict(list), Counter()
    for at, r in enumerate(docs):
        n = len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
        sizes[r.source] += n
        streams[r.source].append((spark_hash("mix", r.doc_id, r.text), at, n))
    targets, taken = plain_targets(sizes), Counter()
    for source, rows in streams.items():
        left = int(targets[source] + 0.5) if sizes[source] else 0
        while left:
            for _, at, n in sorted(rows):
                taken[at] += min(n, left)
                left -= min(n, left)
    return taken


@pytest.mark.parametrize("odd", [False, True])
def test_words_taken_of_each_document(spark, odd):
    docs = odd_docs(spark, clashes=False) if odd else table(spark, SF_DIR, "documents")
    rows = docs.collect()
    taken = walked(rows)
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = sorted((repr(r.doc_id), count(r.text), taken[at]) for at, r in enumerate(rows))
    got = sorted((repr(r.doc_id), r["size"], r.taken) for r in mixing.mix_sources(docs).collect())
    assert got == want


def test_kept_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))  # fewer labels give no rules
    rules = quality.learn_from(docs, labels)
    assert rules
    want = []
    for r in docs.collect():
        text = r.text or ""
        words, chars, symbols, repeated_lines, repeated = brute(text)
        lines = sum(bool(split(line)) for line in text.split("\n"))
        inside = lambda s: sum(c in s for c in text)  # noqa: B023, E731
        share = lambda a, b: a / b if b else None
        x = {
            "words": float(words), "word_length": share(chars, words), "symbols_per_word": share(symbols, words),
            "dup_line_share": share(repeated_lines, lines), "repeat_share": share(repeated, words),
            "words_per_line": share(words, lines), "digit_share": share(inside("0123456789"), chars),
            "upper_share": share(inside("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars),
            "distinct_share": share(len(set(split(text))), words), "marks_per_word": share(inside(".!?,;:"), words),
        }
        holds = lambda t: x[t.feature] is not None and (x[t.feature] >= t.bound) == t.above  # noqa: B023, E731
        rule = next((i for i, terms in enumerate(rules, 1) if all(map(holds, terms))), 0)
        failed = words < 20 or 100 * repeated > 30 * words
        want.append((r.doc_id, failed, not failed and rule == 0, rule))
    got = quality.judge_quality(docs, labels).select("doc_id", "base_failed", "kept", "rule").collect()
    assert sorted(map(tuple, got)) == sorted(want)
