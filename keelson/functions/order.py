"""Program-order stamps ``t4.t8.t9``: int vectors, compared element by element, a prefix first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST = "t0", "t999"


def parse_stamp(t: Column) -> Column:
    """Array of ints, or null if a part is not ``t`` and digits."""
    return F.when(F.rlike(t, F.lit(r"^t\d+(\.t\d+)*$")), F.transform(F.split(t, r"\."), lambda x: F.substring(x, F.lit(2), F.length(x)).cast("int")))


def less(a: Column, b: Column) -> Column:
    """An unreadable right side is never greater; an unreadable left side comes first."""
    x, y = parse_stamp(a), parse_stamp(b)
    return F.when(y.isNull(), F.lit(False)).when(x.isNull(), F.lit(True)).otherwise(x < y)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def equal(a: Column, b: Column) -> Column:
    return a == b


def before_or_equal(a: Column, b: Column) -> Column:
    return less(a, b) | equal(a, b)


def after_or_equal(a: Column, b: Column) -> Column:
    return greater(a, b) | equal(a, b)
