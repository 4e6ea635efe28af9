"""Column rules against the same rules in plain Python, on generated texts."""

import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.functions import parse, text, vectors
from shelfwise.operators.resolve import contains_join
from shelfwise.session import small_table

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
SPACES = "".join(chr(i) for i in range(1, 0x3100) if chr(i).isspace())
TEXT = st.text(
    st.one_of(st.sampled_from(SPACES + "ab é日ßK.+$5"), st.characters(min_codepoint=1, max_codepoint=0x2FFF)), max_size=30
)
REQUEST = st.text(st.sampled_from("ab +$.059 \t"), max_size=12)
PIECES = st.lists(st.one_of(REQUEST, st.sampled_from(["under 30", "OVER $4.5", "95+ points", "90  points", "+", "under $"])), max_size=4)


def column(spark, values, **changes):
    rows = small_table(spark, "i long, x string", list(enumerate(values)))
    columns = [c.alias(n) for n, c in changes.items()]
    return rows.select("i", *columns).orderBy("i").collect()


@SLOW
@given(values=st.lists(TEXT, min_size=20, max_size=60))
def test_space_rules(spark, values):
    got = column(spark, values, one=text.collapse_space("x"), ends=text.strip(F.col("x")), odd=text.remove_odd_characters("x"))
    for value, row in zip(values, got):
        assert row.one == re.sub(r"\s+", " ", value).strip()
        assert row.ends == value.strip()
        bare = re.sub(r"[\x00-\x1F\x7F  -‏    　]", " ", value)
        assert row.odd == re.sub(r"\s+", " ", re.sub("[�﻿]", "", bare)).strip()


@SLOW
@given(values=st.lists(TEXT, min_size=20, max_size=60))
def test_encoding_repair_undoes_a_wrong_decode(spark, values):
    got = column(spark, [v.encode().decode("latin-1") for v in values], fixed=text.repair_encoding("x"))
    for value, row in zip(values, got):
        assert row.fixed == value


@SLOW
@given(values=st.lists(PIECES.map(" ".join), min_size=20, max_size=60))
def test_request_rules(spark, values):
    q = F.col("x")
    mod = parse.modifier(q)
    got = column(
        spark, values, name=parse.identifier(q), mod=mod, most=parse.price_max(mod), least=parse.price_min(mod),
        points=parse.min_points(mod), wanted=parse.as_item_id(parse.identifier(q)),
    )
    for value, row in zip(values, got):
        parts = [p.strip() for p in value.split("+")]
        modifier = " ".join(parts[1:]).strip()
        most = re.search(r"under \$?([0-9]+(\.[0-9]+)?)", modifier, re.I)
        least = re.search(r"over \$?([0-9]+(\.[0-9]+)?)", modifier, re.I)
        points = re.search(r"([0-9]+)\+?\s*points", modifier, re.I)
        assert (row.name, row.mod) == (parts[0], modifier)
        assert row.most == (float(most[1]) if most else None)
        assert row.least == (float(least[1]) if least else None)
        assert row.points == (int(points[1]) if points and int(points[1]) < 2**31 else None)
        assert row.wanted == (int(parts[0]) if re.fullmatch("[0-9]+", parts[0]) else None)


@SLOW
@given(
    texts=st.lists(st.text("abcé ", max_size=12), min_size=5, max_size=15),
    needles=st.lists(st.text("abcÉ ", max_size=5), min_size=1, max_size=15, unique=True),
)
def test_contains_join_finds_what_containment_finds(spark, texts, needles):
    left = small_table(spark, "t long, text string", list(enumerate(texts)))
    right = small_table(spark, "n long, needle string", list(enumerate(needles)))
    got = sorted((r.t, r.n) for r in contains_join(left, "text", right, "needle").collect())
    want = sorted(
        (t, n) for t, a in enumerate(texts) for n, b in enumerate(needles) if b and b.lower() in a.lower()
    )
    assert got == want


NUMBERS = st.lists(st.floats(-5, 5), min_size=3, max_size=3)


@SLOW
@given(pairs=st.lists(st.tuples(NUMBERS, NUMBERS), min_size=10, max_size=30))
def test_vector_rules(spark, pairs):
    rows = small_table(spark, "i long, a array<double>, b array<double>", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    a, b = F.col("a"), F.col("b")
    got = rows.select(
        "i", vectors.inner_product(a, b).alias("dot"), vectors.l2_normalize(a).alias("unit"),
        vectors.blend(a, b, 0.35).alias("mix"), vectors.cosine(a, b).alias("cos"),
    ).orderBy("i").collect()

    def unit(v):
        length = np.sqrt(np.sum(v * v))
        return v / length if length > 0 else v

    for (x, y), row in zip(pairs, got):
        x, y = np.array(x), np.array(y)
        assert np.isclose(row.dot, x @ y) and np.allclose(row.unit, unit(x))
        assert np.allclose(row.mix, unit(0.65 * x + 0.35 * y), atol=1e-6)
        assert np.isclose(row.cos, unit(x) @ unit(y) if x.any() and y.any() else 0.0, atol=1e-6)
