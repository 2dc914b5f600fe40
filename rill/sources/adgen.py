"""Seeded synthetic ad events, as a batch or from Spark's rate source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "view", "purchase")


#: Two multipliers of Lehmer's generator modulo the prime 2^31 - 1.
MODULUS, FIRST, SECOND = 2_147_483_647, 48_271, 69_621


def draw(index: Column, salt: int, n: int, seed: int) -> Column:
    """A number from 0 to n - 1 of an index, by integer arithmetic that any engine can repeat."""
    once = ((F.pmod(index, F.lit(MODULUS)) + F.lit(1)) * FIRST + F.lit(seed * 1_000 + salt)) % MODULUS
    return F.shiftright(once * SECOND % MODULUS, 4) % n


def _event(index: Column, second: Column, ads: int, seed: int) -> list[Column]:
    """Within a second times fall from .999 to .000; type and ad are uniform."""
    return [
        (second * 1000 + 999 - index % 1000).alias("event_time"),
        F.element_at(F.array(*map(F.lit, EVENT_TYPES)), (draw(index, 1, 3, seed) + 1).cast("int")).alias("event_type"),
        draw(index, 2, ads, seed).alias("ad_id"),
    ]


def generate_events(
    spark: SparkSession, seconds: int, per_second: int, start: int = 0, ads: int = 1000, seed: int = 7
) -> DataFrame:
    """`seconds * per_second` events from second `start`; equal arguments give equal rows."""
    rows = spark.range(seconds * per_second)
    second = F.floor(F.col("id") / per_second) + start
    return rows.select(*_event(F.col("id"), second, ads, seed))


def stream_events(spark: SparkSession, per_second: int, ads: int = 1000, seed: int = 7) -> DataFrame:
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(*_event(F.col("value"), F.unix_seconds("timestamp"), ads, seed))
