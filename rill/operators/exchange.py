"""Explicit placements of rows. Plans rarely need them: joins and aggregates bring their own exchanges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_id(keys: Sequence[str], shards: int) -> Column:
    """Sum of integer keys modulo the number of shards, never negative."""
    return F.pmod(reduce(add, (F.col(k) for k in keys)), F.lit(shards))


def hash_shard(df: DataFrame, keys: Sequence[str], shards: int) -> DataFrame:
    return df.repartition(shards, *keys)


def round_robin(df: DataFrame, shards: int) -> DataFrame:
    return df.repartition(shards)


def range_split(df: DataFrame, keys: Sequence[str], shards: int) -> DataFrame:
    return df.repartitionByRange(shards, *keys)


def content_hash(*columns: str) -> Column:
    """64-bit hash that only Spark computes; the fast one."""
    return F.xxhash64(*columns)


def content_digest(*columns: str) -> Column:
    """The first 60 bits of the MD5 digest of the values as text, which any engine can repeat; nulls count as empty."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
