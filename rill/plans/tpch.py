"""TPC-H style queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rill.functions.scalar import money_sum
from rill.sources.tables import table


def q5(spark: SparkSession, sf_dir: str, region: str = "ASIA", start: str = "1996-01-01", end: str = "1997-01-01") -> DataFrame:
    """Lines per nation of a region whose customer and supplier share that nation.

    Written declaratively: Catalyst pushes the filters to the scans, broadcasts region and nation (fixed, tiny
    tables, under its size threshold) and puts exchanges where the sizes ask for them.
    """
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "lineitem", "supplier")}
    bound = lambda s: F.lit(s).cast("timestamp_ntz")
    nations = t["nation"].join(t["region"].where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t["orders"].where((F.col("o_orderdate") >= bound(start)) & (F.col("o_orderdate") < bound(end)))
    lines = (
        t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(orders, F.col("c_custkey") == F.col("o_custkey"))
        .join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"))
    )
    both = (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))
    return lines.join(t["supplier"], both).groupBy("n_name").agg(F.count(F.lit(1)).alias("cnt"))


def q6(spark: SparkSession, sf_dir: str, start: str = "1996-01-01", end: str = "1997-01-01") -> DataFrame:
    """Revenue that a discount band cost, and the number of its lines: one scan with pushed filters."""
    bound = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").where(
        (F.col("l_shipdate") >= bound(start)) & (F.col("l_shipdate") < bound(end))
        & (F.col("l_discount") > 0.049) & (F.col("l_discount") < 0.071) & (F.col("l_quantity") < 24)
    )
    revenue = money_sum(F.col("l_extendedprice") * F.col("l_discount"), 18, 6)
    return rows.agg(F.round(revenue, 2).alias("revenue"), F.count(F.lit(1)).alias("cnt"))
