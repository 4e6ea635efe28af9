import pytest
from pyspark.sql import functions as F

from shelfwise.functions import present
from shelfwise.session import small_table


def shown(spark, kind, values, change):
    rows = small_table(spark, f"i long, x {kind}", list(enumerate(values)))
    return [r.y for r in rows.select("i", change(F.col("x")).alias("y")).orderBy("i").collect()]


NAMES = ["nero d'avola", "müller-thurgau", "o'neill's 2nd", "日a b", "straße ßa", "école élan", ""]


def test_title_case(spark):
    assert shown(spark, "string", NAMES + [None], present.title_case) == [n.title() for n in NAMES] + [None]


def test_country_case(spark):
    values = [" us", "UK", "new zealand", "", None]
    assert shown(spark, "string", values, present.country_case) == ["US", "UK", "New Zealand", "", None]


def test_sentence_case(spark):
    texts = ["crisp. dry. élan", "no stop", "a.b. c", "", "x. . y"]
    want = ["Crisp. Dry. Élan", "No stop", "A.b. C", "", "X. . Y"]
    assert shown(spark, "string", texts, present.sentence_case) == want


def test_rating(spark):
    values = [100.0, 95.0, 94.9, 90.0, 87.0, 86.9, 84.0, 0.0, float("nan"), None]
    assert shown(spark, "double", values, present.rating_bucket) == [5, 5, 4, 4, 3, 2, 2, 1, 1, None]
    assert shown(spark, "string", ["91", "x"], present.rating_bucket) == [4, None]


def test_labels(spark):
    prices = [2.5, 3.5, 1234.5, 1234567.0, 0.4, None]
    want = ["2", "4", "1,234", "1,234,567", "0", "?"]
    assert shown(spark, "double", prices, present.price_label) == want
    assert shown(spark, "double", [0.994, 0.005, -0.2, 1.0], present.match_label) == ["99%", "0%", "-20%", "100%"]


@pytest.mark.parametrize(
    "variety, style",
    [("Champagne Blend", "sparkling"), ("Pinot Noir Rosé", "rosé"), ("rosenheim", "other"), ("Pinot Noir", "red"),
     ("noirette", "other"), ("gamay", "red"), ("Barbera d'Alba", "red"), ("albariño", "white"), ("pinot meunier", "red"),
     ("mourvèdre", "red"), ("Müller-Thurgau", "white"), ("Malvasia Nera", "red"), ("malvasia", "white"), ("Gros Manseng", "white"),
     ("Feteasca Neagra", "red"), ("feteasca", "white"), ("Tinta del Toro", "red"), ("Loureiro-Arinto", "white"), ("White Port", "red"), (" White Blend ", "white"), ("sauvignon blanc-syrah", "red"), ("", "other"), (None, "other")],
)
def test_style(spark, variety, style):
    assert shown(spark, "string", [variety], present.style_category) == [style]


def test_style_words_are_a_parameter(spark):
    words = {"red": ["st. laurent", "g-s-m"], "white": ["müller-thurgau"]}
    change = lambda c: present.style_category(c, words)
    assert shown(spark, "string", ["St. Laurent", "stx laurent", "Müller-Thurgau"], change) == ["red", "other", "white"]


def test_filter_dimension(spark):
    rows = present.standard_varieties(spark).orderBy("value").collect()
    assert len(rows) == 25 and rows[0].display == "Cabernet Franc"
    flagged = present.flag_standard(small_table(spark, "variety string", [("merlot",), ("port",)])).collect()
    assert {r.variety: (r.is_standard, r.display) for r in flagged} == {"merlot": (True, "Merlot"), "port": (False, None)}
