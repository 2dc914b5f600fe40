from rill.llm import common


def test_workers_keep_one_of_each_kind():
    made = []
    make = lambda: made.append(1) or len(made)
    assert [common.per_worker(k, make) for k in (("a", 1), ("a", 1), ("b", 1), ("a", 2), ("b", 1), ("a", 1))] == [1, 1, 2, 3, 2, 4]


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\x0b",), (" a\u00a0b  c\n",)], "t string")
    assert [r[0] for r in df.select(common.words(df["t"])).collect()] == [[], [], [], ["a\u00a0b", "c"]]


def test_saved_and_dropped(spark):
    df = common.saved(spark.range(5))
    assert df.count() == 5 and df.columns == ["id"]
    common.dropped(df)
