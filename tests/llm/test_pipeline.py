"""The pipeline against a plain version of each stage, and what it needs to be left out."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import zstandard
from cases import no_docs, odd_docs
from test_decontaminate import brute as plain_items
from test_mixing import check as check_mix
from test_simhash import plain_components, plain_fingerprint

from shelfwise.llm import langid, lines
from shelfwise.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[i:] == long[i + 1 :] if len(a) != len(b) else short[i + 1 :] == long[i + 1 :]


def plain_language(docs, dictionaries):
    coders = {
        lang: zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=langid.LEVEL,
            write_content_size=False, write_dict_id=False,
        ) for lang, raw in dictionaries.items()
    }
    kept = []
    for doc in docs:
        text = (doc["text"] or "").lower().encode()
        if not any(c.isalpha() for c in doc["text"] or ""):
            continue
        sizes = sorted(
            sum(len(c.compress(text[i : i + langid.CHUNK])) for i in range(0, len(text), langid.CHUNK)) for c in coders.values()
        )
        if (sizes[1] - sizes[0]) / sizes[1] >= langid.LEAST_MARGIN:
            kept.append(doc)
    return kept


def plain_lines(docs):
    seen, out = [], []
    for doc in sorted(docs, key=lambda d: d["doc_id"]):
        kept = []
        for line in doc["text"].split("\n"):
            if len(line) >= lines.MIN_CHARS:
                if not any(within_one(line, other) for other in seen):
                    kept.append(line)
                seen.append(line)
            else:
                kept.append(line)
        out.append(doc | {"text": "\n".join(kept)})
    return out


def plain_near(docs):
    prints = [(d["doc_id"], plain_fingerprint(d["text"])) for d in docs]
    least = plain_components(prints)
    return [d for d, (i, f) in zip(docs, prints) if least[f] == i]


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda d: d["doc_id"])


def test_stages_match_plain_versions(spark):
    docs = table(spark, SF_DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix"]

    identified = stages["language_id"](spark, docs, SF_DIR)
    dictionaries = langid.learn(docs.where(langid.remainder() != 1))
    want = plain_language(rows(docs), dictionaries)
    assert rows(identified) == want and identified.columns == docs.columns and len(want) > 180

    slim = stages["line_dedup"](spark, identified, SF_DIR)
    want = plain_lines(want)
    assert rows(slim) == want and slim.columns == docs.columns

    unique = stages["near_dedup"](spark, slim, SF_DIR)
    want = plain_near(want)
    assert rows(unique) == want and unique.columns == docs.columns

    clean = stages["decontaminate"](spark, unique, SF_DIR)
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    want = [d for d in want if not plain_items([(d["doc_id"], d["text"])], items)]
    assert rows(clean) == want and clean.columns == docs.columns

    mixed = stages["mix"](spark, clean, SF_DIR)
    assert rows(mixed) == sorted((r.asDict() for r in check_mix(clean)), key=lambda d: d["doc_id"])
    assert rows(corpus_pipeline.run(spark, SF_DIR)) == rows(mixed)


def test_odd_and_empty_documents(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count()


def test_the_rest_works_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'p5_recommend_batch' in n and not any(k.startswith('op') for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": ""})
