"""Column-against-constant conditions and their conjunction. SQL NULL rules hold."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def gt(column: str, value) -> Column:
    return F.col(column) > F.lit(value)


def lt(column: str, value) -> Column:
    return F.col(column) < F.lit(value)


def eq(column: str, value) -> Column:
    return F.col(column) == F.lit(value)


def char_prefix_eq(column: str, value: str) -> Column:
    """CHAR equality over the length of the constant; `startswith` reaches the Parquet scan."""
    return F.col(column).startswith(value)


def char_prefix_gt(column: str, value: str) -> Column:
    """CHAR order over the bytes of the constant's length."""
    return F.substring(F.encode(column, "UTF-8"), 1, len(value.encode())) > F.encode(F.lit(value), "UTF-8")


def char_prefix_lt(column: str, value: str) -> Column:
    return F.substring(F.encode(column, "UTF-8"), 1, len(value.encode())) < F.encode(F.lit(value), "UTF-8")


def like(column: str, pattern: str) -> Column:
    return F.col(column).like(pattern)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))
