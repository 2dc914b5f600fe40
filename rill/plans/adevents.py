"""The ad-event pipeline: filter, campaign lookup, windowed counts, click and view ratio.

Each function takes DataFrames and serves batch and streaming input alike. Counts per window need no explicit
partial stage: Spark combines before the exchange. The per-message partial is offered because its rows are an
output of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rill.functions.scalar import epoch_millis, window_id

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
CLICK, VIEW = 1, 2


def with_window(events: DataFrame, span_ms: int = DAY_MS, name: str = "wid") -> DataFrame:
    return events.withColumn(name, window_id(epoch_millis("ts"), span_ms))


def keep_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def split_types(events: DataFrame, *types: str) -> list[DataFrame]:
    """One frame a type; the scan filter of each reaches Parquet."""
    return [keep_type(events, t) for t in types]


def campaigns(customers: DataFrame) -> DataFrame:
    """Ad to campaign mapping; the smallest campaign counts if an ad is listed twice."""
    return customers.groupBy(F.col("c_custkey").alias("ad_id")).agg(F.min("c_nationkey").alias("c_id"))


def join_campaign(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Inner lookup; the mapping is broadcast only if its size is under Spark's threshold."""
    return events.join(mapping, events["user_id"] == mapping["ad_id"])


def partial_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("msg", "wid", "c_id").agg(F.count(F.lit(1)).alias("cnt"), F.max("ts").alias("met"))


def full_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("wid", "c_id").agg(F.count(F.lit(1)).alias("cnt"), F.max("ts").alias("max_event_time"))


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("wid", "c_id").agg(F.sum("cnt").alias("cnt"), F.max("met").alias("max_event_time"))


def collect_windows(full: DataFrame) -> DataFrame:
    return full.groupBy("wid").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n"))


def type_number() -> Column:
    return F.when(F.col("event_type") == "click", CLICK).otherwise(VIEW)


def typed_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("wid", "c_id", type_number().alias("typ")).agg(F.count(F.lit(1)).alias("cnt"))


def click_view_ratio(joined: DataFrame, *more_keys: Column) -> DataFrame:
    """Clicks over views of a window and campaign that has both: one pass, no join of two aggregates."""
    counts = joined.groupBy("wid", "c_id", *more_keys).agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views")
    )
    both = counts.where((F.col("clicks") > 0) & (F.col("views") > 0))
    return both.withColumn("ratio", F.col("clicks").cast("double") / F.col("views"))


def join_ratio(typed: DataFrame) -> DataFrame:
    """The same ratio as a join of the counts of the two types on window and campaign, for counts that come apart."""
    of = lambda t, name: typed.where(F.col("typ") == t).select("wid", "c_id", F.col("cnt").alias(name))
    both = of(CLICK, "clicks").join(of(VIEW, "views"), ["wid", "c_id"])
    return both.withColumn("ratio", F.col("clicks").cast("double") / F.col("views"))


def window_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"), F.max("ts").alias("met"))


def latency_millis(counts: DataFrame, now: Column | None = None) -> DataFrame:
    """Age of each row's newest event; by the clock for live reports, or at a given time for repeatable results."""
    now = F.localtimestamp() if now is None else now
    return counts.withColumn("latency", epoch_millis(now) - epoch_millis("max_event_time"))


def collect_latency(counts: DataFrame) -> DataFrame:
    """Per window the sum of counts, its number of rows and their mean latency (of rows with `latency`)."""
    return counts.groupBy("wid").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n"), F.avg("latency").alias("latency"))


def running_latency(windows: DataFrame) -> DataFrame:
    """The mean latency of all windows up to each: a row for each window, which windows' aggregate bounds, in order."""
    order = Window.orderBy("wid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return windows.withColumn("avg_latency", F.avg("latency").over(order))


def ten_second_chain(events: DataFrame, mapping: DataFrame, span: int = 10, lateness: str = "10 seconds") -> DataFrame:
    """The whole chain in one stream: clicks of `events` (event_time in ms, event_type, ad_id) by campaign and window,
    and of each complete window the clicks, campaigns, and mean latency in ms from a campaign's newest click to the
    window's end.

    A window is complete when each of its seconds has sent a message, whatever the message's events are, so seconds
    are counted on all events. State is dropped when the watermark passes a window. Of the mapping (ad_id, c_id) the
    smallest campaign counts.
    """
    one = mapping.groupBy("ad_id").agg(F.min("c_id").alias("c_id"))
    timed = events.withColumn("at", F.timestamp_millis("event_time")).withWatermark("at", lateness)
    joined = timed.join(one, "ad_id", "left")
    counts = (F.col("event_type") == "click") & F.col("c_id").isNotNull()
    second = F.pow(F.lit(2), F.floor(F.col("event_time") / 1000) % span).cast("long")
    partial = joined.groupBy(F.window("at", f"{span} seconds").alias("w"), "c_id").agg(
        F.count_if(counts).alias("cnt"), F.max(F.when(counts, F.col("event_time"))).alias("met"), F.bit_or(second).alias("seen")
    )
    late = F.unix_millis("w.end") - F.col("met")
    dated = partial.withColumn("late", late).withColumn("wid", F.floor(F.unix_millis("w.start") / (span * 1000)))
    full = dated.groupBy(F.window(F.window_time("w"), f"{span} seconds").alias("v"), "wid").agg(
        F.sum("cnt").alias("cnt"), F.count_if(F.col("cnt") > 0).alias("n"), F.avg("late").alias("latency"), F.bit_or("seen").alias("seen")
    )
    return full.where(F.bit_count("seen") == span).select("wid", "cnt", "n", "latency")
