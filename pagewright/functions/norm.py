"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: the characters that count as white space.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Outer white space of every kind removed (Spark's trim takes blanks only)."""
    return F.btrim(c, F.lit(WHITE))


def feature_key(c: Column | str) -> Column:
    """Features are compared without letter case and outer white space."""
    return F.lower(strip(c))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once, however often f names it; keeps plans from growing with every nesting."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
