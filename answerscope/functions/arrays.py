"""Helpers on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_at_special(tokens: Column, special: Sequence[int]) -> Column:
    """Tokens before the first negative or special one."""
    stop = F.array_position(F.transform(tokens, lambda t: (t < 0) | t.isin(list(special))), True)
    return F.when(stop > 0, F.slice(tokens, F.lit(1), (stop - 1).cast("int"))).otherwise(tokens)


def leading_count(tokens: Column, blank: Sequence[int]) -> Column:
    """Number of leading tokens that belong to ``blank``."""
    first = F.array_position(F.transform(tokens, lambda t: ~t.isin(list(blank))), True)
    return F.when(first > 0, first - 1).otherwise(F.size(tokens)).cast("int")


def last_n(values: Column, n: int) -> Column:
    """The last ``n`` elements, or all of a shorter array."""
    size = F.size(values)
    return F.slice(values, F.greatest(size - n + 1, F.lit(1)), F.least(size, F.lit(n)))


def position_range(values: Column, start: int, length: int) -> Column:
    """``length`` elements from 0-based ``start``."""
    return F.slice(values, start + 1, length)
