"""Selection, projection, distinct, grouping and inner equi-joins as DataFrame functions.

All follow SQL: full-value equality, set semantics of distinct, one row of a global aggregate over no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rill.functions.predicates import all_of


def select(df: DataFrame, conditions: Sequence[Column] = ()) -> DataFrame:
    return df.where(all_of(conditions))


def select_project(df: DataFrame, conditions: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    return select(df, conditions).select(*columns)


def select_distinct(df: DataFrame, conditions: Sequence[Column] = ()) -> DataFrame:
    return select(df, conditions).distinct()


def select_project_distinct(df: DataFrame, conditions: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    return select_project(df, conditions, columns).distinct()


def group_by(
    df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column],
    conditions: Sequence[Column] = (), carried: Sequence[str] = (),
) -> DataFrame:
    """Grouped aggregates; `carried` columns depend on the keys, and any value of the group is taken."""
    kept = {c: F.any_value(c) for c in carried}
    return select(df, conditions).groupBy(*keys).agg(*(v.alias(k) for k, v in {**kept, **aggregates}.items()))


def group_all(df: DataFrame, aggregates: dict[str, Column], conditions: Sequence[Column] = ()) -> DataFrame:
    return select(df, conditions).agg(*(v.alias(k) for k, v in aggregates.items()))


def equi_join(
    left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]],
    left_columns: Sequence[str], right_columns: Sequence[str],
    left_conditions: Sequence[Column] = (), right_conditions: Sequence[Column] = (),
) -> DataFrame:
    """Inner join on one or more key pairs, one-sided filters first; output is left then right columns.

    Catalyst picks the strategy: it broadcasts a side only below the size threshold, and adaptive execution
    splits skewed partitions of a sort-merge join.
    """
    a, b = select(left, left_conditions).alias("a"), select(right, right_conditions).alias("b")
    on = all_of(F.col(f"a.{x}") == F.col(f"b.{y}") for x, y in keys)
    return a.join(b, on, "inner").select(*(F.col(f"a.{c}") for c in left_columns), *(F.col(f"b.{c}") for c in right_columns))


def top_n(df: DataFrame, order: Sequence[str | Column], n: int = 25) -> DataFrame:
    """First rows of an order; give a total order for a stable result."""
    return df.orderBy(*order).limit(n)


def sort_by(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*order)


def merge_inputs(*frames: DataFrame) -> DataFrame:
    """All rows of several inputs, columns matched by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
