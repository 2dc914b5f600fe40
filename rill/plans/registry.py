"""Named queries, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rill.functions import predicates as P
from rill.functions.scalar import campaign_number, epoch_millis, money_sum, times_ten
from rill.operators import exchange, mapreduce, relational
from rill.plans import adevents as A
from rill.plans import completeness, sanity, tpch
from rill.session import shared_folder
from rill.sources import adgen, codecs, fixedwidth, textfiles
from rill.sources.tables import stream_table, table
from rill.streaming import counted, run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# in microseconds, for epoch_ms rounds up to the next window
W = "epoch_us(ts)//86400000000"
H = "epoch_us(ts)//3600000000"
EC = "events join customer on user_id=c_custkey"

CAMPAIGN_UUIDS = ("4a6b1f0c-9d2e-4c57-8f31-000000000001", "00000010-0000-4000-8000-00000000000a", "ffffffff-1111-4222-8333-444444444444")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Selection, projection, distinct


@query("select_cond", "select l_orderkey,l_linenumber,l_quantity from lineitem where l_quantity<24 and l_discount>0.049 and l_discount<0.071")
def select_cond(spark, d):
    band = [P.lt("l_quantity", 24), P.gt("l_discount", 0.049), P.lt("l_discount", 0.071)]
    return relational.select_project(table(spark, d, "lineitem"), band, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("select_all_columns", "select * from part where p_size>40")
def select_all_columns(spark, d):
    return relational.select(table(spark, d, "part"), [P.gt("p_size", 40)])


@query("char_prefix", "select r_regionkey,r_name from region where substring(r_name,1,4)='ASIA'")
def char_prefix(spark, d):
    return relational.select(table(spark, d, "region"), [P.char_prefix_eq("r_name", "ASIA")])


@query("char_prefix_order", "select n_nationkey,n_name from nation where substring(n_name,1,8)>'NATION_1' and substring(n_name,1,8)<'NATION_4'")
def char_prefix_order(spark, d):
    band = [P.char_prefix_gt("n_name", "NATION_1"), P.char_prefix_lt("n_name", "NATION_4")]
    return relational.select_project(table(spark, d, "nation"), band, ["n_nationkey", "n_name"])


@query("like", "select p_partkey,p_name from part where p_name like '%ring%'")
def like(spark, d):
    return relational.select_project(table(spark, d, "part"), [P.like("p_name", "%ring%")], ["p_partkey", "p_name"])


@query("select_distinct", "select distinct * from (select l_returnflag,l_linestatus from lineitem where l_quantity<24)")
def select_distinct(spark, d):
    return relational.select_project_distinct(table(spark, d, "lineitem"), [P.lt("l_quantity", 24)], ["l_returnflag", "l_linestatus"])


@query("select_distinct_rows", "select distinct n_nationkey,n_name,n_regionkey from nation where n_regionkey=2")
def select_distinct_rows(spark, d):
    doubled = relational.merge_inputs(*[table(spark, d, "nation")] * 2)
    return relational.select_distinct(doubled, [P.eq("n_regionkey", 2)])


# Aggregates


@query(
    "group_aggs",
    "select c_nationkey,count(*) cnt,min(c_acctbal) mn,max(c_acctbal) mx,cast(sum(cast(c_acctbal as decimal(18,2))) as double) sm,"
    "round(cast(sum(cast(c_acctbal as decimal(18,2))) as double)/count(*),4) av from customer group by c_nationkey",
)
def group_aggs(spark, d):
    balance, count = F.col("c_acctbal"), F.count(F.lit(1))
    aggregates = {
        "cnt": count, "mn": F.min(balance), "mx": F.max(balance), "sm": money_sum(balance),
        "av": F.round(money_sum(balance) / count, 4),
    }
    return relational.group_by(table(spark, d, "customer"), ["c_nationkey"], aggregates)


@query("group_carried", "select n_nationkey,any_value(n_name) n_name,count(*) cnt from nation join supplier on n_nationkey=s_nationkey group by n_nationkey")
def group_carried(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    return relational.group_by(joined, ["n_nationkey"], {"cnt": F.count(F.lit(1))}, carried=["n_name"])


@query("group_all", "select count(*) cnt,min(l_quantity) mn,max(l_quantity) mx from lineitem where l_quantity<24")
def group_all(spark, d):
    q = F.col("l_quantity")
    return relational.group_all(
        table(spark, d, "lineitem"), {"cnt": F.count(F.lit(1)), "mn": F.min(q), "mx": F.max(q)}, [P.lt("l_quantity", 24)]
    )


# Joins


@query("join_single_filter", "select n_nationkey,n_name,r_name from nation join region on n_regionkey=r_regionkey where r_name='ASIA'")
def join_single_filter(spark, d):
    return relational.equi_join(
        table(spark, d, "nation"), table(spark, d, "region"), [("n_regionkey", "r_regionkey")],
        ["n_nationkey", "n_name"], ["r_name"], right_conditions=[P.eq("r_name", "ASIA")],
    )


@query(
    "join_composite",
    "select s_suppkey,s_nationkey,l_orderkey,l_linenumber from supplier join (select l_orderkey,l_linenumber,l_suppkey,c_nationkey"
    " from lineitem join orders on l_orderkey=o_orderkey join customer on c_custkey=o_custkey) x on s_suppkey=l_suppkey and s_nationkey=c_nationkey",
)
def join_composite(spark, d):
    placed = relational.equi_join(
        table(spark, d, "orders"), table(spark, d, "customer"), [("o_custkey", "c_custkey")], ["o_orderkey"], ["c_nationkey"]
    )
    lines = relational.equi_join(
        table(spark, d, "lineitem"), placed, [("l_orderkey", "o_orderkey")],
        ["l_orderkey", "l_linenumber", "l_suppkey"], ["c_nationkey"],
    )
    return relational.equi_join(
        table(spark, d, "supplier"), lines, [("s_suppkey", "l_suppkey"), ("s_nationkey", "c_nationkey")],
        ["s_suppkey", "s_nationkey"], ["l_orderkey", "l_linenumber"],
    )


@query(
    "tpch_q5",
    "select n_name,count(*) cnt from customer,orders,lineitem,supplier,nation,region where c_custkey=o_custkey and l_orderkey=o_orderkey"
    " and l_suppkey=s_suppkey and c_nationkey=s_nationkey and s_nationkey=n_nationkey and n_regionkey=r_regionkey and r_name='ASIA'"
    " and o_orderdate>=timestamp'1996-01-01' and o_orderdate<timestamp'1997-01-01' group by n_name",
)
def tpch_q5(spark, d):
    return tpch.q5(spark, d)


@query(
    "tpch_q6",
    "select round(cast(sum(cast(l_extendedprice*l_discount as decimal(18,6))) as double),2) revenue,count(*) cnt from lineitem"
    " where l_shipdate>=timestamp'1996-01-01' and l_shipdate<timestamp'1997-01-01' and l_discount>0.049 and l_discount<0.071 and l_quantity<24",
)
def tpch_q6(spark, d):
    return tpch.q6(spark, d)


# Sort and top


@query("top25_strings", "select n_name,n_nationkey from nation order by n_name,n_nationkey limit 25")
def top25_strings(spark, d):
    return relational.top_n(table(spark, d, "nation").select("n_name", "n_nationkey"), ["n_name", "n_nationkey"])


@query("top25_orders", "select o_custkey,o_orderkey from orders order by o_custkey,o_orderkey limit 25")
def top25_orders(spark, d):
    return relational.top_n(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


@query("sort_ints", "select s_nationkey,s_suppkey from supplier order by s_nationkey,s_suppkey")
def sort_ints(spark, d):
    return relational.sort_by(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey", "s_suppkey"])


# Map and reduce


@query("map_x10", "select l_linenumber*10 l_linenumber from lineitem")
def map_x10(spark, d):
    return mapreduce.map_values(table(spark, d, "lineitem"), "l_linenumber", times_ten)


@query("map_map_x100", "select l_linenumber*100 l_linenumber from lineitem")
def map_map_x100(spark, d):
    return mapreduce.map_values(table(spark, d, "lineitem"), "l_linenumber", times_ten, times_ten)


@query("mapreduce_sum", "select cast(sum(cast(l_linenumber as bigint)*10) as bigint) total from lineitem")
def mapreduce_sum(spark, d):
    return mapreduce.reduce_sum(map_x10(spark, d), "l_linenumber")


@query("mapreduce_python", "select cast(sum(cast(l_linenumber as bigint)*10) as bigint) total from lineitem")
def mapreduce_python(spark, d):
    import pyarrow.compute as pc

    scaled = mapreduce.map_values_python(table(spark, d, "lineitem"), "l_linenumber", lambda a: pc.multiply(a, 10))
    partial = mapreduce.combine_partitions_python(scaled, "l_linenumber", lambda a: pc.sum(a).as_py() or 0)
    return mapreduce.reduce_sum(partial, "l_linenumber")


@query("reduce_per_partition", "select cast(sum(l_linenumber) as bigint) total from lineitem")
def reduce_per_partition(spark, d):
    dealt = table(spark, d, "lineitem").select("l_linenumber").repartition(4)
    return mapreduce.reduce_sum(mapreduce.reduce_per_partition(dealt, "l_linenumber"), "total")


@query("aggregate_python", "select l_returnflag,max(l_quantity)-min(l_quantity) spread from lineitem group by 1")
def aggregate_python(spark, d):
    import pyarrow as pa
    import pyarrow.compute as pc

    # NaN is the largest in SQL; of nulls alone there is no spread
    highest = lambda v: math.nan if pc.any(pc.is_nan(v)).as_py() else pc.max(v).as_py()
    lowest = lambda v: pc.min(v).as_py()
    spread = lambda high, low: pc.subtract(pa.scalar(highest(high), pa.float64()), pc.min(low)).as_py()
    return mapreduce.aggregate_python(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", [highest, lowest], spread, "spread")


@query("integer_file", "select cast(range as integer) v from range(1000)")
def integer_file(spark, d):
    """Consecutive integers as a headerless file, and back."""
    path = f"{shared_folder(spark)}/ints"
    fixedwidth.write_fixed_width(spark.range(1000).selectExpr("cast(id as int) v"), path, "v i")
    return fixedwidth.read_fixed_width(spark, path, "v i", rows_per_task=256)


# Placement


@query("hash_shard", "select (s_suppkey+s_nationkey)%4 shard,count(*) cnt from supplier group by 1")
def hash_shard(spark, d):
    shard = exchange.shard_id(["s_suppkey", "s_nationkey"], 4)
    return table(spark, d, "supplier").groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("cnt"))


@query("round_robin", "select count(*) cnt,cast(sum(l_linenumber) as bigint) total from lineitem")
def round_robin(spark, d):
    dealt = exchange.round_robin(table(spark, d, "lineitem").select("l_linenumber"), 4)
    return dealt.agg(F.count(F.lit(1)).alias("cnt"), F.sum("l_linenumber").alias("total"))


@query("hash_repartition", "select s_nationkey,count(*) cnt from supplier group by 1")
def hash_repartition(spark, d):
    """The explicit exchange serves the aggregate as well: one shuffle."""
    dealt = exchange.hash_shard(table(spark, d, "supplier"), ["s_nationkey"], 4)
    return dealt.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("cnt"))


@query("range_split", "select count(*) cnt,min(s_suppkey) mn,max(s_suppkey) mx from supplier")
def range_split(spark, d):
    dealt = exchange.range_split(table(spark, d, "supplier"), ["s_suppkey"], 4)
    return dealt.agg(F.count(F.lit(1)).alias("cnt"), F.min("s_suppkey").alias("mn"), F.max("s_suppkey").alias("mx"))


@query("gather", "select count(*) cnt,count(distinct n_nationkey) n from nation")
def gather(spark, d):
    one = table(spark, d, "nation").coalesce(1)
    return one.agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("n_nationkey").alias("n"))


@query("merge_inputs", "select n_regionkey k,count(*) cnt from (select n_regionkey from nation union all select r_regionkey from region) group by 1")
def merge_inputs(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"))
    both = relational.merge_inputs(table(spark, d, "nation").select("n_regionkey"), regions)
    return both.groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("cnt"))


@query("content_hash", "select s_suppkey,cast('0x'||substring(md5(s_suppkey||chr(31)||s_name),1,15) as bigint) h from supplier")
def content_hash(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", exchange.content_digest("s_suppkey", "s_name").alias("h"))


@query("sharded_parts", "select (s_suppkey+s_nationkey)%4 shard,count(*) cnt from supplier group by 1")
def sharded_parts(spark, d):
    """A folder of part files, each read by tasks of its own, and its rows sharded by key."""
    layout, path = "s_suppkey i, s_nationkey i", f"{shared_folder(spark)}/supplier"
    fixedwidth.write_fixed_width(exchange.round_robin(table(spark, d, "supplier"), 4), path, layout)
    rows = exchange.hash_shard(fixedwidth.read_fixed_width(spark, path, layout), ["s_suppkey", "s_nationkey"], 4)
    return rows.groupBy(exchange.shard_id(["s_suppkey", "s_nationkey"], 4).alias("shard")).agg(F.count(F.lit(1)).alias("cnt"))


@query("export_sorted", "select c_custkey,c_nationkey,c_mktsegment from customer")
def export_sorted(spark, d):
    """Sorted ranges as fixed-width files, and back."""
    layout, path = "c_custkey L, c_nationkey i, c_mktsegment c10", f"{shared_folder(spark)}/customer"
    fixedwidth.export_sorted(table(spark, d, "customer"), path, layout, ["c_nationkey", "c_custkey"])
    return fixedwidth.read_fixed_width(spark, path, layout)


@query("custom_vertex", "select count(*) n,cast(sum(l_linenumber) as bigint) total from lineitem where l_linenumber>3")
def custom_vertex(spark, d):
    """A custom operator: each task filters its batches and gives one row at its end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    class Kept(mapreduce.Vertex):
        def __init__(self):
            self.n = self.total = 0

        def batch(self, batch):
            kept = batch.column(0).filter(pc.greater(batch.column(0), 3))
            self.n, self.total = self.n + len(kept), self.total + (pc.sum(kept).as_py() or 0)
            return iter(())

        def end(self):
            yield pa.RecordBatch.from_pydict({"n": pa.array([self.n], pa.int64()), "total": pa.array([self.total], pa.int64())})

    parts = mapreduce.apply_vertex(table(spark, d, "lineitem").select("l_linenumber"), Kept, "n long, total long")
    return parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# Ad events


def _joined(spark, d, *types: str, stream: bool = False) -> DataFrame:
    events = (stream_table if stream else table)(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    kept = A.keep_type(A.with_window(events), *types)
    return A.join_campaign(kept, A.campaigns(table(spark, d, "customer")))


@query("ysb_filter", "select event_id,ts,user_id from events where event_type='click'")
def ysb_filter(spark, d):
    return A.keep_type(table(spark, d, "events"), "click").select("event_id", "ts", "user_id")


@query("ysb_join", f"select event_id,ts,c_nationkey c_id from {EC} where event_type='click' and c_acctbal>0")
def ysb_join(spark, d):
    mapping = A.campaigns(relational.select(table(spark, d, "customer"), [P.gt("c_acctbal", 0)]))
    return A.join_campaign(ysb_filter(spark, d), mapping).select("event_id", "ts", "c_id")


@query(
    "ysb_join_duplicates",
    "select event_id,min(c_id) c_id from events join (select c_custkey a,c_nationkey c_id from customer union all"
    " select c_custkey,24-c_nationkey from customer) on user_id=a where event_type='click' group by 1",
)
def ysb_join_duplicates(spark, d):
    """Ads that are listed twice: the smallest campaign counts."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    twice = customers.union(customers.select("c_custkey", 24 - F.col("c_nationkey")))
    return A.join_campaign(ysb_filter(spark, d), A.campaigns(twice)).select("event_id", "c_id")


@query("ysb_partial", f"select {H} msg,{W} wid,c_nationkey c_id,count(*) cnt,max(ts) met from {EC} where event_type='click' group by 1,2,3")
def ysb_partial(spark, d):
    return A.partial_counts(A.with_window(_joined(spark, d, "click"), A.HOUR_MS, "msg"))


_FULL = f"select {W} wid,c_nationkey c_id,count(*) cnt,max(ts) max_event_time from {EC} where event_type='click' group by 1,2"


@query("ysb_full", _FULL)
def ysb_full(spark, d):
    return A.full_counts(_joined(spark, d, "click"))


@query("ysb_merge_partials", _FULL.replace("count(*)", "cast(count(*) as bigint)"))
def ysb_merge_partials(spark, d):
    return A.merge_partials(ysb_partial(spark, d))


@query("ysb_collector", f"select wid,cast(sum(cnt) as bigint) cnt,count(*) n from ({_FULL}) group by wid")
def ysb_collector(spark, d):
    return A.collect_windows(ysb_full(spark, d))


_LATE = f"select wid,c_id,cnt,max_event_time,epoch_us((select max(ts) from events))//1000-epoch_us(max_event_time)//1000 latency from ({_FULL})"


def _late(spark, d, counts: DataFrame) -> DataFrame:
    """Latency at the time of the newest event, which stands in for the clock."""
    newest = table(spark, d, "events").agg(F.max("ts").alias("newest"))
    return A.latency_millis(counts.crossJoin(F.broadcast(newest)), F.col("newest")).drop("newest")


@query("ysb_latency", _LATE)
def ysb_latency(spark, d):
    return _late(spark, d, ysb_full(spark, d))


@query("ysb_collector_latency", f"select wid,cast(sum(cnt) as bigint) cnt,count(*) n,avg(latency) latency from ({_LATE}) group by wid")
def ysb_collector_latency(spark, d):
    return A.collect_latency(ysb_latency(spark, d))


@query("ysbm_split", "select event_type,event_id from events where event_type in ('click','view')")
def ysbm_split(spark, d):
    parts = A.split_types(table(spark, d, "events").select("event_type", "event_id"), "click", "view")
    return relational.merge_inputs(*parts)


_TYPED = (
    f"select {W} wid,c_nationkey c_id,case event_type when 'click' then 1 else 2 end typ,count(*) cnt"
    f" from {EC} where event_type in ('click','view') group by 1,2,3"
)


@query("ysbm_full", _TYPED)
def ysbm_full(spark, d):
    return A.typed_counts(_joined(spark, d, "click", "view"))


_RATIO = (
    "select wid,c_id,clicks,views,cast(clicks as double)/views ratio from (select "
    f"{W} wid,c_nationkey c_id,count(*) filter (where event_type='click') clicks,count(*) filter (where event_type='view') views"
    f" from {EC} group by 1,2) where clicks>0 and views>0"
)


@query("ysbm_ratio", _RATIO)
def ysbm_ratio(spark, d):
    return A.click_view_ratio(_joined(spark, d, "click", "view"))


@query("ysbm_ratio_join", _RATIO)
def ysbm_ratio_join(spark, d):
    return A.join_ratio(ysbm_full(spark, d))


@query("wa_sharder", f"select {H} msg,{W} wid,count(*) cnt,max(ts) met from events group by 1,2")
def wa_sharder(spark, d):
    events = A.with_window(A.with_window(table(spark, d, "events")), A.HOUR_MS, "msg")
    return A.window_counts(events, "msg", "wid")


_WA = f"select {W} wid,count(*) cnt,max(ts) met from events group by 1"


@query("wa_count", _WA)
def wa_count(spark, d):
    return A.window_counts(A.with_window(table(spark, d, "events")), "wid")


@query("wa_ten_seconds", "select epoch_us(ts)//10000000 wid,count(*) cnt,max(ts) met from events group by 1")
def wa_ten_seconds(spark, d):
    return A.window_counts(A.with_window(table(spark, d, "events"), 10_000), "wid")


_RUNNING = "(epoch_us((select max(ts) from events))//1000-epoch_us(met)//1000)"


@query("wa_latency", f"select wid,{_RUNNING} latency,avg({_RUNNING}) over (order by wid) avg_latency from ({_WA})")
def wa_latency(spark, d):
    late = _late(spark, d, wa_count(spark, d).withColumnRenamed("met", "max_event_time"))
    return A.running_latency(late).select("wid", "latency", "avg_latency")


# Completeness, sanity, throughput

_UNITS = f"select {W} wid,{H} h,user_id%2 p,count(*) n from events group by 1,2,3"
_COMPLETE = f"select wid,cast(sum(n) as bigint) cnt from ({_UNITS}) group by wid having count(*)>=48"


def _units(spark, d) -> DataFrame:
    events = A.with_window(A.with_window(table(spark, d, "events")), A.HOUR_MS, "h").withColumn("p", F.pmod("user_id", F.lit(2)))
    return completeness.message_units(events, 48, "h", "p")


@query("complete_windows", _COMPLETE)
def complete_windows(spark, d):
    return completeness.complete_windows(_units(spark, d))


def _recount(spark, d) -> DataFrame:
    """The same counts by SQL text, independent of the pipeline's functions."""
    table(spark, d, "events").createOrReplaceTempView("rill_events")
    table(spark, d, "customer").createOrReplaceTempView("rill_customer")
    return spark.sql(
        "select datediff(ts, date'1970-01-01') * 1L wid, c_nationkey c_id, count(*) cnt from rill_events, rill_customer"
        " where user_id = c_custkey and event_type = 'click' group by 1, 2"
    )


@query("sanity_window", f"select wid,cast(sum(cnt) as bigint) obtained,cast(sum(cnt) as bigint) actual from ({_FULL}) group by wid")
def sanity_window(spark, d):
    return sanity.window_totals(ysb_full(spark, d), _recount(spark, d))


@query("sanity_campaign", f"select wid,c_id,cnt obtained,cnt actual,true same from ({_FULL})")
def sanity_campaign(spark, d):
    return sanity.campaign_rows(ysb_full(spark, d), _recount(spark, d))


@query("throughput", f"select {H} t,count(*) tp from events group by 1")
def throughput(spark, d):
    return sanity.throughput(table(spark, d, "events"), A.HOUR_MS)


@query("throughput_average", f"select avg(tp) avg_tp from (select {H} t,count(*) tp from events group by 1)")
def throughput_average(spark, d):
    return sanity.average_throughput(throughput(spark, d))


# Codecs

_VALUES = ",".join(f"('{u}')" for u in CAMPAIGN_UUIDS)


@query("hex_campaign", f"select c_uuid,cast('0x'||substring(c_uuid,1,8) as bigint) c_id from (values {_VALUES}) v(c_uuid)")
def hex_campaign(spark, d):
    ids = spark.createDataFrame([(u,) for u in CAMPAIGN_UUIDS], "c_uuid string")
    return ids.select("c_uuid", campaign_number("c_uuid").alias("c_id"))


@query("fixed_width_roundtrip", "select n_nationkey,n_name,n_regionkey from nation")
def fixed_width_roundtrip(spark, d):
    layout, path = "n_nationkey i, n_name c25, n_regionkey i", f"{shared_folder(spark)}/nation"
    fixedwidth.write_fixed_width(table(spark, d, "nation"), path, layout)
    return fixedwidth.read_fixed_width(spark, path, layout, rows_per_task=10)


@query("event_codecs", "select epoch_us(ts)//1000 event_time,event_type,cast(user_id as varchar) ad_id from events")
def event_codecs(spark, d):
    """Raw events in their message layout, and back."""
    path, layout = f"{shared_folder(spark)}/events", codecs.LAYOUTS["event"]
    events = table(spark, d, "events").select(epoch_millis("ts").alias("event_time"), "event_type", F.col("user_id").cast("string").alias("ad_id"))
    fixedwidth.write_fixed_width(events.withColumn("userid_pageid_ipaddress", F.lit("u p 0.0.0.0")), path, layout)
    return fixedwidth.read_fixed_width(spark, path, layout).select("event_time", "event_type", "ad_id")


@query("message_codecs", f"select wid,c_id,cast(cnt as integer) count,epoch_us(max_event_time)//1000 event_time,1 \"type\" from ({_FULL})")
def message_codecs(spark, d):
    """Counts in the layout of typed results, and back."""
    path, layout = f"{shared_folder(spark)}/full", codecs.LAYOUTS["full_typed"]
    full = ysb_full(spark, d).select("wid", "c_id", F.col("cnt").alias("count"), epoch_millis("max_event_time").alias("event_time"), F.lit(A.CLICK).alias("type"))
    fixedwidth.write_fixed_width(full, path, layout)
    return fixedwidth.read_fixed_width(spark, path, layout)


@query("dump_data", f"select epoch_us(ts)//1000 event_time,{W} w_id,event_type,cast(user_id as varchar) a_id from events")
def dump_data(spark, d):
    path = f"{shared_folder(spark)}/data"
    events = A.with_window(table(spark, d, "events"), name="w_id").withColumn("event_time", epoch_millis("ts"))
    textfiles.dump_data(events.withColumn("a_id", F.col("user_id").cast("string")), path)
    return textfiles.read_tsv(spark, path, textfiles.DATA).select("event_time", "w_id", "event_type", "a_id")


@query("dump_mappings", "select cast(c_custkey as varchar) a_id,cast(c_nationkey as bigint) c_id from customer")
def dump_mappings(spark, d):
    path = f"{shared_folder(spark)}/mappings"
    mapping = A.campaigns(table(spark, d, "customer"))
    textfiles.dump_mappings(mapping.select(F.col("ad_id").cast("string").alias("a_id"), "c_id"), path)
    return textfiles.read_tsv(spark, path, textfiles.MAPPINGS)


@query("dump_results", f"select wid w_id,cast(c_id as bigint) c_id,cnt count from ({_FULL})")
def dump_results(spark, d):
    path = f"{shared_folder(spark)}/results"
    textfiles.dump_results(ysb_full(spark, d).select(F.col("wid").alias("w_id"), "c_id", F.col("cnt").alias("count")), path)
    return textfiles.read_tsv(spark, path, textfiles.RESULTS)


# Streams


def _by_day(events: DataFrame) -> DataFrame:
    """Events with the start of their day as event time: a day is closed once a later one has come."""
    return events.withColumn("at", F.timestamp_seconds(F.col("wid") * 86400)).withWatermark("at", "0 seconds")


_CLOSED = f"wid < (select max({W}) from events where event_type in ("


@query("stream_ysb", f"select * from ({_FULL}) where {_CLOSED}'click'))")
def stream_ysb(spark, d):
    """Append mode: a window comes out, and its state goes, once the watermark has passed its end."""
    joined = _by_day(_joined(spark, d, "click", stream=True))
    counts = joined.groupBy(F.window("at", "1 day"), "wid", "c_id").agg(F.count(F.lit(1)).alias("cnt"), F.max("ts").alias("max_event_time"))
    return run.run_available_now(counts.select("wid", "c_id", "cnt", "max_event_time"), "append")


@query("stream_ysbm", f"select * from ({_RATIO}) where {_CLOSED}'click','view'))")
def stream_ysbm(spark, d):
    joined = _by_day(_joined(spark, d, "click", "view", stream=True))
    ratio = A.click_view_ratio(joined, F.window("at", "1 day"))
    return run.run_available_now(ratio.select("wid", "c_id", "clicks", "views", "ratio"), "append")


@query("stream_wa", f"select * from ({_WA}) where wid < (select max({W}) from events)")
def stream_wa(spark, d):
    timed = _by_day(A.with_window(stream_table(spark, d, "events").select("ts")))
    counts = timed.groupBy(F.window("at", "1 day"), "wid").agg(F.count(F.lit(1)).alias("cnt"), F.max("ts").alias("met"))
    return run.run_available_now(counts.select("wid", "cnt", "met"), "append")


@query("stream_map_x100", "select l_linenumber*100 v from lineitem")
def stream_map_x100(spark, d):
    """Integers from fixed-width files as a stream, through two maps, into fixed-width files."""
    source, sink = (f"{shared_folder(spark)}/{x}" for x in ("in", "out"))
    fixedwidth.write_fixed_width(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("v")), source, "v i")
    mapped = mapreduce.map_values(fixedwidth.stream_fixed_width(spark, source, "v i"), "v", times_ten, times_ten)
    run.run_to_files(mapped, sink, "v i")
    return fixedwidth.read_fixed_width(spark, sink, "v i")


_GENERATED = (
    "select i,i//200*1000+999-i%1000 event_time,(((((i+1)*48271+7001)%2147483647)*69621%2147483647)>>4)%3 typ,"
    "(((((i+1)*48271+7002)%2147483647)*69621%2147483647)>>4)%1000 ad from range(15000) t(i)"
)


@query(
    "stream_ysb_chain",
    "select wid,cast(sum(cnt) as bigint) cnt,count(*) n,avg((wid+1)*10000-met) latency from (select event_time//10000 wid,ad%100 c_id,count(*) cnt,"
    f"max(event_time) met from ({_GENERATED}) where typ=0 group by 1,2) where wid<6 group by wid",
)
def stream_ysb_chain(spark, d):
    """75 generated seconds from the source to the collector: the six whole windows of ten seconds come out."""
    path = f"{shared_folder(spark)}/events"
    generated = adgen.generate_events(spark, 75, 200)
    for part in range(0, 75_000, 15_000):  # files in order of time
        generated.where(F.col("event_time").between(part, part + 14_999)).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("event_time long, event_type string, ad_id long").option("maxFilesPerTrigger", 1).parquet(path)
    mapping = spark.range(1000).select(F.col("id").alias("ad_id"), (F.col("id") % 100).alias("c_id"))
    return run.run_available_now(A.ten_second_chain(events, mapping), "append")


@query("stream_complete_windows", _COMPLETE)
def stream_complete_windows(spark, d):
    path = f"{shared_folder(spark)}/units"
    units = _units(spark, d)
    units.write.parquet(path)
    stream = spark.readStream.schema(units.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return run.run_available_now(counted.close_counted(stream, lateness="40 days"), "append")  # files are in no order of time
