import random

import numpy as np
import xxhash
from cases import no_docs, odd_docs, odd_rows, rows_of

from shelfwise.llm import simhash
from shelfwise.llm.graph import components
from shelfwise.session import small_table


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    words = [w.encode() for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """Fingerprint to the least doc_id reachable."""
    values = sorted({f for _, f in prints})
    label = {f: f for f in values}
    moved = True
    while moved:
        moved = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    ids = {}
    for i, f in prints:
        ids.setdefault(label[f], set()).add(i)
    return {f: min((i for i in ids[label[f]] if i is not None), default=None) for f in values}


def test_odd_documents(spark):
    rows = odd_rows()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    least = plain_components(prints)
    want = sorted(((i, f"{f:016x}", least[f]) for i, f in prints), key=repr)
    assert rows_of(simhash.near_duplicates(odd_docs(spark))) == want
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def close_values(seed):
    rnd = random.Random(seed)
    values = set()
    for _ in range(40):
        v = rnd.getrandbits(64)
        values.add(v)
        for _ in range(rnd.randrange(12)):
            for bit in rnd.sample(range(64), rnd.randrange(6)):
                v ^= 1 << bit
            values.add(v)
    return sorted(values)


def test_links_connect_all_within_the_radius(spark):
    for seed, radius in ((1, 3), (2, 2), (3, 0)):
        values = close_values(seed)
        signed = np.array(values, np.uint64).view(np.int64).tolist()
        fps = spark.createDataFrame([(v,) for v in signed], "fp long")
        found = components(simhash.links(fps, radius)).collect()
        root = {r.node: r.root for r in found}
        got = {}
        for v, s in zip(values, signed):
            got.setdefault(root.get(s, s), set()).add(v)
        least = plain_components([(i, v) for i, v in enumerate(values)], radius)
        want = {}
        for v in values:
            want.setdefault(least[v], set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_bit_sliced_distances():
    rnd = np.random.default_rng(3)
    left = rnd.integers(0, 1 << 63, 1000, dtype=np.uint64)
    right = left.copy()
    for i in range(1000):
        for bit in rnd.choice(64, rnd.integers(0, 7), replace=False):
            right[i] ^= np.uint64(1) << np.uint64(bit)
    for radius in (0, 1, 2, 3):
        want = [(int(a) ^ int(b)).bit_count() <= radius for a, b in zip(left, right)]
        assert simhash.within(left, right, radius).tolist() == want


def test_keep_first_keeps_one_of_each_component(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs)
    assert kept.count() == found.select("component_id").distinct().count()
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found.collect()}
    assert simhash.keep_first(no_docs(spark)).count() == 0


def test_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(2000, 2300)] + [(5000, 5000)]
    rnd = random.Random(5)
    rnd.shuffle(chain)
    root = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {root[i] for i in range(61)} == {0} and {root[i] for i in range(2000, 2300)} == {1000}


def test_large_files_are_filed_again():
    rnd = np.random.default_rng(9)
    free = simhash._free_bits(5)
    assert len(free) + sum(high - low for low, high in list(simhash.combinations(simhash.RANGES, 3))[5]) == 64
    values = np.zeros(5000, np.uint64)
    for bit in free:
        values |= rnd.integers(0, 2, 5000, dtype=np.uint64) << np.uint64(bit)
    for i in range(1, 5000, 3):
        values[i] = values[i - 1]
        for bit in rnd.choice(free, rnd.integers(1, 5), replace=False):
            values[i] ^= np.uint64(1) << np.uint64(bit)
    values = np.unique(values)
    pairs = {
        tuple(sorted(p)) for a, b in simhash._within_file(values, free, 3, np.arange(len(values)))
        for p in zip(a.tolist(), b.tolist())
    }
    want = set()
    for step in range(1, len(values)):
        near = np.bitwise_count(values[:-step] ^ values[step:]) <= 3
        want |= {(int(i), int(i) + step) for i in np.flatnonzero(near)}
    assert pairs == want and len(want) > 1000


def test_one_row_of_each_group_whatever_the_ids(spark):
    a, b, c, d = ("alpha beta gamma delta " * 5, "one two three four five " * 5, "rot blau gelb braun weiss " * 5, "uno dos tres " * 5)
    prints = [plain_fingerprint(t) for t in (a, b, c, d)]
    assert all((x ^ y).bit_count() > 3 for i, x in enumerate(prints) for y in prints[:i])
    rows = [(None, a), (None, b), (None, a), (1, c), (None, c), (3, d), (5, d), (5, b + "x"), (5, a + a)]
    docs = small_table(spark, "doc_id long, text string", rows)
    roots = plain_components(list(enumerate(plain_fingerprint(t) for _, t in rows)))
    groups = {}
    for i, t in rows:
        groups.setdefault(roots[plain_fingerprint(t)], set()).add((i, t))
    kept = [tuple(r) for r in simhash.keep_first(docs, one_per_id=False).collect()]
    assert len(kept) == len(set(kept)) == len(groups)
    for group in groups.values():
        least = min((i for i, _ in group if i is not None), default=None)
        assert len(group & set(kept)) == 1 and next(iter(group & set(kept)))[0] == least


def test_an_id_in_two_groups_keeps_the_row_of_its_own_group(spark):
    d = "uno dos tres " * 5
    others = [f"text{i} " + " ".join(f"{w}{i}" for w in ("other", "words", "here", "and", "more")) * 3 for i in range(8)]
    prints = [plain_fingerprint(t) for t in (d, *others)]
    assert all((x ^ y).bit_count() > 3 for i, x in enumerate(prints) for y in prints[:i])
    rows = [(3, d)] + [row for i, t in enumerate(others, 10) for row in ((i, t), (i, d))]  # either text may have the lesser hash
    docs = small_table(spark, "doc_id long, text string", rows)
    kept = sorted(tuple(r) for r in simhash.keep_first(docs).collect())
    assert kept == [(3, d)] + list(enumerate(others, 10))
