import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelfwise.functions.vectors import l2_normalize  # noqa: E402
from shelfwise.operators.encode import LookupEncoder  # noqa: E402
from shelfwise.schemas import RAW  # noqa: E402
from shelfwise.session import local_session, small_table  # noqa: E402
from shelfwise.vocab import ANCHORS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_reviews(spark):
    """Ciders: two rows of one title and text, a title whose first row has no price, and holes in most columns."""
    rows = [
        (10, "Ireland", "Sharp, oaky.", "Keg", 84, 12.0, "Munster", "Cork", None, "Niamh", "@n", "Harbour Hill Dry 2017", "Cider", "Harbour Hill"),
        (11, "Ireland", "Sharp, oaky.", None, 85, 13.0, "Munster", "Cork", "Youghal", "Niamh", "@n", "Harbour Hill Dry 2017", "Cider", "Harbour Hill"),
        (12, "France", "Keeved, sweet.", None, 91, None, "Normandy", "Pays d'Auge", None, None, None, "Old Orchard 2018", "Cider", "Old Orchard"),
        (13, "France", "A second look.", None, 90, 30.0, "Normandy", "Pays d'Auge", None, None, None, "Old Orchard 2018", "Cider", "Old Orchard"),
        (14, None, "Pear and thyme.", None, 89, 22.0, "Herefordshire", None, None, "Owen", None, "Millstone Perry", "Perry", "Millstone"),
        (15, "Wales", "Plain.", None, None, 18.0, None, None, None, None, None, "Plum Lane (Gwent)", None, "Plum Lane"),
    ]
    return small_table(spark, RAW, rows)


@pytest.fixture(scope="session")
def catalogue(spark):
    kinds = (
        "item_id long, title string, description string, text_corpus string, variety string, country string, "
        "region string, price double, points int, taster_name string"
    )
    shelf = [
        ("Harbour Hill Dry Cider", "cider", "ireland", 12.0, 84), ("Old Orchard Keeved Cider", "cider", "france", 30.0, 91),
        ("Millstone Perry 2018", "perry", "wales", 22.0, 89), ("Bog Myrtle Mead", "mead", "ireland", 45.0, 93),
        ("Plum Lane Jerkum", "plum", "wales", 18.0, None),
    ]
    rows = [
        (i, title, f"about {title}", f"all of {title}", variety, country, "", price, points, "unknown")
        for i, (title, variety, country, price, points) in enumerate(shelf)
    ]
    return small_table(spark, kinds, rows)


# Five directions: one for each sort phrase, and a last one that no sort phrase has.
VECTORS = ([0, 0, 0, 0, 1], [0, 0, 0, 3, 4], [0, 0, 4, 0, 3], [0, 1, 0, 0, 0], [0, 0, 3, 4, 0])


@pytest.fixture(scope="session")
def items(spark, catalogue):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(VECTORS)]
    table = small_table(spark, "item_id long, embedding array<double>", rows)
    return catalogue.join(table.withColumn("embedding", l2_normalize(table["embedding"])), "item_id")


@pytest.fixture(scope="session")
def encoder(spark):
    known = [(phrase, [float(i == k) for k in range(5)]) for i, (phrase, _, _) in enumerate(ANCHORS)]
    known += [
        ("a bargain", [4.0, 0.0, 0.0, 0.0, 1.0]), ("the dearest", [0.0, 1.0, 0.0, 0.0, 0.0]),
        ("pears", [0.0, 0.0, 0.4, 0.0, 1.0]), ("plums", [0.0, 0.0, 0.4, 0.4, 0.9]),
    ]
    return LookupEncoder(small_table(spark, "text string, vector array<double>", known), [0.0, 0.0, 0.0, 0.0, 1.0])
