"""Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is otherwise evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]
