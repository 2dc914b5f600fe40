"""Replay checks: results of a pipeline against an independent recount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rill.functions.scalar import epoch_millis, window_id


def window_totals(result: DataFrame, recount: DataFrame) -> DataFrame:
    """Per window the pipeline's total and the recounted one; windows that only one side has are kept."""
    total = lambda df, name: df.groupBy("wid").agg(F.sum("cnt").alias(name))
    both = total(result, "obtained").join(total(recount, "actual"), "wid", "full")
    return both.select("wid", F.coalesce("obtained", F.lit(0)).alias("obtained"), F.coalesce("actual", F.lit(0)).alias("actual"))


def campaign_rows(result: DataFrame, recount: DataFrame) -> DataFrame:
    """Per window and campaign a flag whether both sides agree."""
    a, b = result.select("wid", "c_id", F.col("cnt").alias("obtained")), recount.select("wid", "c_id", F.col("cnt").alias("actual"))
    return a.join(b, ["wid", "c_id"], "full").withColumn("same", F.coalesce(F.col("obtained") == F.col("actual"), F.lit(False)))


def throughput(events: DataFrame, span_ms: int) -> DataFrame:
    return events.groupBy(window_id(epoch_millis("ts"), span_ms).alias("t")).agg(F.count(F.lit(1)).alias("tp"))


def average_throughput(per_span: DataFrame) -> DataFrame:
    return per_span.agg(F.avg("tp").alias("avg_tp"))
