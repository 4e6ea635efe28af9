"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector is left as it is."""

    def scaled(v: Column) -> Column:
        return let(
            norm(v),
            lambda length: F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v),
        )

    return let(a.cast("array<double>"), scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine for vectors of any length; zero when either has no direction."""
    return let(
        norm(a) * norm(b),
        lambda lengths: F.when(lengths > 0, inner_product(a, b) / lengths).otherwise(0.0),
    )


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def distance_to_similarity(distance: Column, digits: int = 4) -> Column:
    return F.bround(F.lit(1.0) - distance, digits)


def blend(base: Column, modifier: Column, weight: float) -> Column:
    """``base`` pulled toward ``modifier`` by ``weight``, back at unit length."""
    mixed = F.zip_with(
        base.cast("array<double>"),
        modifier.cast("array<double>"),
        lambda x, y: F.lit(1.0 - weight) * x + F.lit(weight) * y,
    )
    return l2_normalize(mixed)
