"""The trie against a plain one of dictionaries; parentheses against a stack."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import rows_of

from shelfwise.llm import queries, trie
from shelfwise.llm.common import table
from shelfwise.session import small_table

KINDS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, every=5, most=9):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        donor = c - (c % every if c >= 0 else -(-c % every))
        whole[c] = tuple(turns.get(donor, [])[:h] + turns[c][h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, held in members.items():
        gain = (len(held) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += gain
    out = []
    for p, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if whole[c] == p)))
        out.append((
            min(held), len(p), min(members[p[:-1]]) if p else None, len(held), children[p], leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def odd_rows(seed, n=60):
    rnd = random.Random(seed)
    texts = ["", "a", "é🙂", "b", None, "long " * 40]
    rows = []
    for c in rnd.sample(range(-20, 3 * n), n):
        first = rnd.choice([["hi"], ["hi"], rnd.choices(texts, k=2), []])
        body = first + rnd.choices(texts, k=rnd.choice([0, 1, 3, 12]))
        rows += [(c, i, rnd.choice(["user", "user", None]), t) for i, t in enumerate(body)]
    rows += [(7, None, "user", "b"), (7, None, "user", "a"), (None, 1, "user", "a"), (8, 1, "x", "tie"), (8, 1, "x", "ait")]
    rows += rows[3:6]
    rnd.shuffle(rows)
    return rows


def got(spark, rows, parts=7, **how):
    df = small_table(spark, KINDS, rows).selectExpr("*", "1 AS n", "'c' AS path", "2 AS code", "3 AS first")
    return rows_of(trie.prefix_trie(trie.rebuilt(df.repartition(parts)), **how))


def in_rounds(rows, shard):
    """The shards and rounds of the operator without Spark, the rows of a round cut anywhere."""
    rnd, convs = random.Random(shard), {}
    for conv, _, role, text in rows:
        convs.setdefault(conv, []).append(hashlib.md5(f"{role}:{text}".encode()).digest() + len((text or "").encode()).to_bytes(8, "big"))
    paths = {}
    for conv, codes in convs.items():
        paths.setdefault(b"".join(codes), []).append(conv)
    items = [
        (path, len(path) // trie.WIDTH, {
            "n": [len(ids)], "first": [min(ids)], "ends": [hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()],
        }) for path, ids in sorted(paths.items())
    ]
    nodes, names, first, last = [], {}, True, False
    while not last:
        last = not first and len(items) <= 8
        cuts = [0] if last else [0, *sorted(rnd.sample(range(1, len(items)), min(len(items) - 1, len(items) // 9))), ]
        left = []
        for a, b in zip(cuts, [*cuts[1:], len(items)]):
            for batch in trie.shards(iter(items[a:b]), shard, last, not first):
                for row in batch.to_pylist():
                    node = row.pop("node")
                    if node is None:
                        left.append((row.pop("path"), 0, row))
                    else:
                        nodes.append(node)
                        if node["key"]:
                            names[node["key"]] = node["conv_id"]
        items, first = sorted(left, key=lambda x: x[0]), False
    for node in nodes:
        if node["parent_key"]:
            node["parent_conv_id"] = names[node["parent_key"]]
    return sorted((tuple(node[c] for c in COLUMNS) for node in nodes), key=repr)


@pytest.mark.parametrize("shard", [1, 7, 40, 400])
def test_shards_of_any_size_merge(shard):
    for seed in range(40):
        rows = [(c, t, r or "", x or "") for c, t, r, x in odd_rows(seed, 5 + 3 * seed) if c is not None and t is not None]
        rows = sorted({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
        assert in_rounds(rows, shard) == plain(rows, every=1)


def test_odd_cases(spark):
    rows = odd_rows(0)
    assert got(spark, rows) == plain(rows)


def test_query_is_the_operator(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations")
    found = queries.op12_prefix_trie(spark, "/root/testdata/sf0.01")
    assert found.columns == COLUMNS
    want = plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert rows_of(found) == want
    assert rows_of(trie.prefix_trie(trie.rebuilt(df), shard_turns=300)) == want


def test_copies_long_conversations_and_none(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 10_000, 2) for t in range(2)]  # a conversation that thousands copy
    rows += [(20_000 + c, t, "user", f"t{t}" if t < 140 - c else f"{c}") for c in range(5) for t in range(150)]
    assert got(spark, rows, shard_turns=200) == plain(rows)
    assert got(spark, []) == []


def test_parentheses_match_a_stack():
    rnd = random.Random(3)
    for size in (1, 5, 63, 64, 200, 3000):
        for deep in (0.5, 0.9):
            bits, open_ = [], 0
            for _ in range(size):
                up = not open_ or rnd.random() < deep
                bits.append(int(up))
                open_ += 1 if up else -1
            bits = [1, *bits, *[0] * open_, 0]
            stack, want = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            tree = trie.Parentheses(np.array(bits, np.int8))
            opens = np.flatnonzero(tree.bits)
            assert tree.findclose(opens).tolist() == [want[i] for i in opens.tolist()]
            assert tree.leaf_pairs().tolist() == [want[i] == i + 1 for i in opens.tolist()]
