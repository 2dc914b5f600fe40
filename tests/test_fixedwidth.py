import struct

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rill.sources import adgen, codecs, fixedwidth, textfiles

LAYOUT = "k i, v f, t L, s c6"
ROW = st.tuples(
    st.integers(-(2**31), 2**31 - 1), st.floats(width=32, allow_nan=False), st.integers(-(2**63), 2**63 - 1),
    st.text(st.characters(min_codepoint=33, max_codepoint=126), max_size=6),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(ROW, max_size=30), task=st.integers(1, 9))
def test_round_trip(spark, tmp_path_factory, rows, task):
    path = str(tmp_path_factory.mktemp("fw") / "t")
    df = spark.createDataFrame(rows, "k int, v float, t long, s string")
    fixedwidth.write_fixed_width(df, path, LAYOUT)
    back = fixedwidth.read_fixed_width(spark, path, LAYOUT, rows_per_task=task)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_bytes_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 3, "ab")], "k int, v float, t long, s string")
    fixedwidth.write_fixed_width(df.coalesce(1), f"{tmp_path}/t", LAYOUT)
    data = b"".join(p.read_bytes() for p in (tmp_path / "t").glob("*.bin"))
    assert data == struct.pack("<ifq6s", 1, 2.5, 3, b"ab    ")


def test_misfits_are_errors(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(b"\0" * 23)
    with pytest.raises(Exception, match="whole number"):
        fixedwidth.read_fixed_width(spark, f"{tmp_path}/t.bin", LAYOUT).collect()
    for row in [(1, 1.0, 1, "toolong"), (1, 1.0, 1, None)]:
        with pytest.raises(Exception, match="CHAR|NULL"):
            fixedwidth.write_fixed_width(spark.createDataFrame([row], "k int, v float, t long, s string"), f"{tmp_path}/w", LAYOUT)


def test_integers_of_a_single_file(spark, tmp_path):
    (tmp_path / "ints.bin").write_bytes(struct.pack("<1000i", *range(1000)))
    df = fixedwidth.read_fixed_width(spark, f"{tmp_path}/ints.bin", "v i", rows_per_task=100)
    assert df.rdd.getNumPartitions() == 10
    assert df.agg({"v": "sum"}).first()[0] == sum(range(1000))


TEXT = st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=2)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=20))
def test_char_codec(values):
    layout = fixedwidth.Layout.parse("s c8")
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["s"])
    data = layout.encode(batch)
    assert data == b"".join(v.encode().ljust(8) for v in values)
    assert layout.decode(data).column(0).to_pylist() == [v.rstrip(" ") for v in values]


def test_layouts_of_messages():
    widths = {k: fixedwidth.Layout.parse(v).dtype.itemsize for k, v in codecs.LAYOUTS.items()}
    assert widths == {"event": 136, "filtered": 45, "joined": 45, "partial": 20, "full": 24, "full_typed": 32, "window_partial": 16, "header": 16}


def test_sorted_export_is_sorted_ranges(spark, tmp_path):
    rows = [((i * 37) % 1000, i) for i in range(1000)]
    fixedwidth.export_sorted(spark.createDataFrame(rows, "k int, v int"), f"{tmp_path}/t", "k i, v i", ["k"], parts=5)
    files = [struct.unpack(f"<{p.stat().st_size // 4}i", p.read_bytes())[::2] for p in (tmp_path / "t").glob("*.bin")]
    assert all(list(f) == sorted(f) for f in files) and sum(map(len, files)) == 1000
    ends = sorted((f[0], f[-1]) for f in files if f)
    assert len(ends) > 1 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_tables_of_a_database(spark):
    url = "jdbc:derby:memory:rill;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "k int, s string")
    try:
        df.write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="s varchar(9)").save()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no embedded database: {str(e)[:80]}")
    back = textfiles.read_jdbc(spark, url, "t", driver="org.apache.derby.jdbc.EmbeddedDriver", partitionColumn="k", lowerBound="0", upperBound="20", numPartitions="4")
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == [(i, f"n{i}") for i in range(20)]


def test_ids_one_a_line(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a-1\nb-2\n")
    assert sorted(r.ad_id for r in textfiles.read_ids(spark, f"{tmp_path}/ids.txt").collect()) == ["a-1", "b-2"]


def test_dumps(spark, tmp_path):
    events = spark.createDataFrame([(i, 0, "click", "a") for i in range(10)], "event_time long, w_id long, event_type string, a_id string").repartition(2)
    textfiles.dump_data(events, f"{tmp_path}/d")
    back = textfiles.read_tsv(spark, f"{tmp_path}/d", textfiles.DATA).collect()
    assert len({(r["rank"], r.iteration) for r in back}) == 10 and {r["rank"] for r in back} == {0, 1}


def test_mapping_lines(spark, tmp_path):
    ad, one, two = "a" * 36, "b" * 36, "c" * 36
    (tmp_path / "m.txt").write_text(f'"{ad}", {two}\n"{ad}", {one}\n')
    assert [tuple(r) for r in textfiles.read_mapping(spark, f"{tmp_path}/m.txt").collect()] == [(ad, one)]


def test_tab_separated_dump(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    textfiles.write_tsv(df, f"{tmp_path}/t")
    assert sorted(map(tuple, textfiles.read_tsv(spark, f"{tmp_path}/t", "a long, b string").collect())) == [(1, "x"), (2, "y")]


def test_generated_events_repeat(spark):
    a, b = (adgen.generate_events(spark, 3, 50, start=100).collect() for _ in range(2))
    assert a == b and len(a) == 150
    assert {r.event_time // 1000 for r in a} == {100, 101, 102}
    assert {r.event_type for r in a} == set(adgen.EVENT_TYPES)
    assert all(0 <= r.ad_id < 1000 for r in a)
