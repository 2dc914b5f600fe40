"""Windows closed by counted marks: a window is complete when its marks add up to one whole.

Messages are counted on the unfiltered stream, so a message whose events are all filtered out still counts.
Incomplete windows, usually the first and the last, are withheld.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_units(events: DataFrame, denominator: int, *message_keys: str) -> DataFrame:
    """A row for each window's message: `num`/`den` of completeness and its number of events."""
    units = events.groupBy("wid", *message_keys).agg(F.count(F.lit(1)).alias("n"))
    return units.select("wid", "n", F.lit(1).alias("num"), F.lit(denominator).alias("den"))


def complete_windows(units: DataFrame) -> DataFrame:
    done = units.groupBy("wid").agg(F.sum("n").alias("cnt"), F.sum("num").alias("num"), F.max("den").alias("den"))
    return done.where(F.col("num") >= F.col("den")).select("wid", "cnt")
