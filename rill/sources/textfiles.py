"""Line-based side inputs of the ad pipeline, and tab-separated dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ids(spark: SparkSession, path: str, name: str = "ad_id") -> DataFrame:
    """One id a line."""
    return spark.read.text(path).select(F.col("value").alias(name))


def parse_mapping(lines: DataFrame) -> DataFrame:
    """Ad and campaign UUIDs at fixed places of a line (characters 2-37 and 41-76, counted from one).

    Of several lines of one ad the smallest campaign counts, so the result doesn't depend on file order.
    """
    pairs = lines.select(F.substring("value", 2, 36).alias("ad_id"), F.substring("value", 41, 36).alias("c_id"))
    return pairs.groupBy("ad_id").agg(F.min("c_id").alias("c_id"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return parse_mapping(spark.read.text(path))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


#: Columns of the dumps that a replay check reads.
DATA = "event_time long, w_id long, rank int, iteration int, event_type string, a_id string"
MAPPINGS = "a_id string, c_id long"
RESULTS = "w_id long, c_id long, count long"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def dump_data(events: DataFrame, path: str) -> None:
    """Raw events (event_time, w_id, event_type, a_id), with the task that wrote each and its number there."""
    number = F.monotonically_increasing_id()
    numbered = events.withColumn("rank", F.shiftright(number, 33).cast("int")).withColumn("iteration", number.bitwiseAND(F.lit((1 << 33) - 1)).cast("int"))
    write_tsv(numbered.select(*_columns(DATA)), path)


def dump_mappings(mapping: DataFrame, path: str) -> None:
    """Ads and their campaigns' numbers."""
    write_tsv(mapping.select(*_columns(MAPPINGS)), path)


def dump_results(results: DataFrame, path: str) -> None:
    """Counts of windows and campaigns."""
    write_tsv(results.select(*_columns(RESULTS)), path)
