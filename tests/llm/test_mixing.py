import re

import pytest
from cases import no_docs, odd_docs, rows_of

from shelfwise.llm import mixing
from shelfwise.llm.common import table
from shelfwise.session import small_table

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes):
    """Share out, stop the sources that pass three times their size, share the rest again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n])
    names += [None] if None in sizes else []
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * sizes[n]}
        if not over:
            return target | share
        for n in over:
            target[n] = 3.0 * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def check(docs, **how):
    rows = docs.collect()
    got = mixing.mix_sources(docs, **how).collect()
    count = lambda t: len(WORD.findall(t or ""))
    sizes, by = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    target = plain_targets(sizes)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"]) for r in got) == sorted(
        (r.doc_id is not None, r.doc_id or 0, count(r.text)) for r in rows
    )
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        source = next(s for s in sizes if sizes[s] == r.source_size and abs(target[s] - r.target) <= 1e-6 * (1 + r.target))
        by[source] = by.get(source, 0) + r.taken
    for s in sizes:
        assert abs(by.get(s, 0) - target[s]) <= 0.51
    return got


def test_odd_cases(spark):
    docs = odd_docs(spark)
    assert rows_of(mixing.mix_sources(docs)) == sorted(map(tuple, check(docs)), key=repr)
    assert mixing.mix_sources(no_docs(spark)).count() == 0
    nothing = docs.where("text IS NULL")
    assert {r.taken for r in mixing.mix_sources(nothing).collect()} == {0}


def test_given_documents(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents"))


@pytest.mark.parametrize("small", [1, 40])
def test_hot_and_tiny_sources(spark, small):
    rows = [(i, "w " * 900, "b") for i in range(200)] + [(1000 + i, "v " * 30, "a") for i in range(small)]
    rows += [(2000, "u " * 500, None), (2001, "", "c")]
    check(small_table(spark, "doc_id long, text string, source string", rows))


@pytest.mark.parametrize("length", [16, 64, 2400])
def test_tiny_sources_beside_a_huge_one(spark, length):
    rows = [(i, "w " * 3000, "huge") for i in range(200)]
    rows += [(1000 + 20 * s + d, "v " * n, f"tiny{s:02d}") for s in range(20) for d, n in enumerate((5, 15 + s, 300 * (s % 3)))]
    got = check(small_table(spark, "doc_id long, text string, source string", rows), length=length)
    assert all(r.taken == 3 * r["size"] for r in got if r.doc_id >= 1000)


def test_turns_of_a_block_differ_by_one(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = mixing.sized(docs)
    total = rows.groupBy().sum("size").first()[0]
    schedule = mixing.slot_schedule(spark, mixing.source_targets(rows), total).collect()
    assert len({r.slot for r in schedule}) == len(schedule)
    turns = {}
    for r in schedule:
        turns.setdefault(r.sid, {}).setdefault(r.block, []).append(r.turn)
    for blocks in turns.values():
        assert all(sorted(t) == list(range(len(t))) for t in blocks.values())
        assert max(map(len, blocks.values())) - min(map(len, blocks.values())) <= 1
