import struct
import time

from pyspark.sql import functions as F

from rill.plans import adevents as A
from rill.plans import completeness, registry, sanity
from rill.sources import adgen, fixedwidth
from rill.streaming import counted, run

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stream_equals_batch(spark):
    assert rows(registry.QUERIES["stream_complete_windows"](spark, SF)) == rows(registry.QUERIES["complete_windows"](spark, SF))
    for stream, batch in (("stream_ysb", "ysb_full"), ("stream_ysbm", "ysbm_ratio")):
        got, want = rows(registry.QUERIES[stream](spark, SF)), rows(registry.QUERIES[batch](spark, SF))
        last = max(w[0] for w in want)  # the last day is not closed yet
        assert got == [w for w in want if w[0] < last] and got


def test_window_closes_over_several_batches_and_stays_closed(spark, tmp_path):
    schema = "wid long, n long, num int, den int"
    for i, part in enumerate([[(1, 5, 1, 3), (2, 7, 1, 2)], [(1, 6, 1, 3)], [(1, 7, 1, 3), (3, 9, 1, 1)], [(1, 100, 3, 3)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/u/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/u/*")
    got = rows(run.run_available_now(counted.close_counted(stream), "append"))
    assert {w for w, _ in got} == {1, 3} and len(got) == 2


def test_state_of_passed_windows_is_removed(spark, tmp_path):
    schema = "wid long, n long, num int, den int"
    for i in range(10, 22):  # each file opens a window, and closes the one before
        spark.createDataFrame([(i, 5, 1, 2), (i - 1, 6, 1, 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/u/{i:02d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/u/*")
    closed = counted.close_counted(stream, 1000, "2 seconds")
    query = closed.writeStream.format("memory").queryName("rill_closed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.wid for r in spark.table("rill_closed").collect()} == set(range(10, 21))
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(kept) <= 7 and kept[-1] < 7


def test_a_growing_file_is_read_from_where_it_ended(spark, tmp_path):
    path, out = tmp_path / "in", f"{tmp_path}/out"
    path.mkdir()
    stream = fixedwidth.stream_fixed_width(spark, str(path), "v i", rows_per_task=2)
    for n, more in ((3, 0), (5, 2)):
        (path / "a.bin").write_bytes(struct.pack(f"<{n}i", *range(n)))
        if more:
            (path / "b.bin").write_bytes(struct.pack("<2i", 70, 80))
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/log")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 70, 80]


def test_generated_stream_goes_through_the_chain(spark):
    events = adgen.stream_events(spark, 500)
    mapping = spark.range(1000).select(F.col("id").alias("ad_id"), (F.col("id") % 100).alias("c_id"))
    query = A.ten_second_chain(events, mapping).writeStream.format("noop").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.5)
        assert query.exception() is None and any(p["numInputRows"] for p in query.recentProgress)
    finally:
        query.stop()


def test_windows_that_lack_a_message_are_withheld(spark, tmp_path):
    rows_ = [(s * 1000 + 500, "view" if s % 3 else "click", s % 5) for s in range(40) if s != 13]
    spark.createDataFrame(rows_, "event_time long, event_type string, ad_id long").coalesce(1).write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("event_time long, event_type string, ad_id long").parquet(f"{tmp_path}/e")
    mapping = spark.createDataFrame([(0, 7), (0, 9), (3, 8)], "ad_id long, c_id long")
    got = run.run_available_now(A.ten_second_chain(events, mapping, lateness="0 seconds"), "append").collect()
    want = {}
    for t, kind, ad in rows_:
        want.setdefault(t // 10_000, 0)
        want[t // 10_000] += kind == "click" and ad in (0, 3)
    assert {r.wid: r.cnt for r in got} == {w: n for w, n in want.items() if w in (0, 2)}


def test_messages_without_kept_events_still_count(spark):
    events = spark.createDataFrame([(1, "a", "click"), (1, "b", "view"), (2, "a", "click")], "wid long, m string, event_type string")
    units = completeness.message_units(events, 2, "m")
    assert rows(completeness.complete_windows(units)) == [(1, 2)]


def test_sanity_reports_windows_that_one_side_lacks(spark):
    a = spark.createDataFrame([(1, 1, 3), (2, 1, 4)], "wid long, c_id int, cnt long")
    b = spark.createDataFrame([(1, 1, 3), (3, 1, 5)], "wid long, c_id int, cnt long")
    assert rows(sanity.window_totals(a, b)) == [(1, 3, 3), (2, 4, 0), (3, 0, 5)]
    assert sorted(r.same for r in sanity.campaign_rows(a, b).collect()) == [False, False, True]


def test_progress_is_reported(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").agg(F.count("*").alias("n"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rill_n").trigger(availableNow=True).start()
    q.awaitTermination()
    assert run.progress_rows(spark, q).agg(F.sum("input_rows")).first()[0] == 10
