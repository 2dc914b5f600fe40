import heapq
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from cases import DOCS, counted, docs, prose

from rill.llm import mixing


def apportion(votes, seats):
    """Seat by seat to the highest quotient."""
    given_ = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heap[0]
        given_[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * given_[i] + 1), i))
    return given_


def fill_targets(sizes, weights, most=3):
    """By bisection of the level."""
    lo, hi = 0.0, 10.0 * max(1, sum(sizes)) * 3
    fill = lambda x: [min(most * s, x * w) for s, w in zip(sizes, weights, strict=True)]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(fill(mid)) < sum(sizes) else (lo, mid)
    return fill(hi)


def test_apportionment_is_by_highest_quotients(spark):
    r = random.Random(3)
    groups = [([r.randrange(10**6) for _ in range(r.randrange(1, 12))], r.randrange(400)) for _ in range(60)]
    groups += [([0, 0], 5), ([7] * 9, 4), ([10**6] + [1] * 200, 900), ([10**6] + [2200] * 200, 900), ([3], 10), ([1, 2], 0), ([10, 20], 90), ([5] * 8, 17)]
    rows = [(g, i, float(v), n, float(sum(votes)), len(votes)) for g, (votes, n) in enumerate(groups) for i, v in enumerate(votes)]
    got = defaultdict(dict)
    for x in mixing.apportioned(spark.createDataFrame(rows, "g int, i int, votes double, seats long, all_votes double, voters long"), "g", "i").collect():
        got[x.g][x.i] = x.given
    for g, (votes, n) in enumerate(groups):
        given_ = [got[g][i] for i in range(len(votes))]
        assert sum(given_) == sum(apportion(votes, n)), (votes, n)
        price = [v / (2 * k + 1) for v, k in zip(votes, given_, strict=True)]
        last = [v / (2 * k - 1) for v, k in zip(votes, given_, strict=True) if k]
        assert not last or max(price) <= min(last) * (1 + 1e-12)


def test_targets_fill_up(spark):
    r = random.Random(4)
    for sizes in ([], [0], [0, 0, 5], [1, 10**5, 3], [10**4] * 7, [r.randrange(10**5) for _ in range(12)], [10**6, *range(30)]):
        w = [1 + i % 3 for i in range(len(sizes))]
        df = spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(zip(sizes, w, strict=True))], "i int, source_size long, weight int")
        got = [x.target for x in mixing.with_targets(df).orderBy("i").collect()]
        assert np.allclose(got, fill_targets(sizes, w), rtol=1e-9, atol=1e-6), sizes


def check(rows, mixed):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    assert counted((r.doc_id, r.rill_mix.size) for r in mixed) == counted((i, size(t)) for i, t, _ in rows)
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, fill_targets([per[s] for s in names], [1.0 + i % 3 for i in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for r in mixed:
        assert r.rill_mix.source_size == per[r.source] and abs(r.rill_mix.target - target[r.source]) < 1e-6
        assert 0 <= r.rill_mix.taken <= 3 * r.rill_mix.size
        taken[r.source] += r.rill_mix.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])


def test_odd_documents(spark):
    check(DOCS, mixing.mix(docs(spark)).collect())


def test_sources_of_many_sizes_and_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 40)
    r = random.Random(0)
    rows = [(i, prose(i, r.randrange(200)), r.choice(["hot"] * 6 + ["b", "c", "tiny", None, "é"]) if i else "one") for i in range(500)]
    first = mixing.mix(docs(spark, rows))
    check(rows, first.collect())
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7))
    assert counted(first.collect()) == counted(again.collect())


def test_words_taken_are_the_decision(spark):
    rows = [(i, prose(i, 30 + i), "ab"[i % 7 == 0]) for i in range(200)]
    taken = {r.doc_id: r.rill_mix.taken for r in mixing.mix(docs(spark, rows)).collect()}
    out, texts = mixing.take_words(docs(spark, rows)), {i: t for i, t, _ in rows}
    assert out.columns == docs(spark).columns
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r.text)
    for i, n in taken.items():
        assert sum(len(t.split()) for t in got[i]) == n
        assert all(texts[i].startswith(t) for t in got[i]) and sum(t != texts[i] for t in got[i]) <= 1


def test_no_rows_and_no_words(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.rill_mix.taken for r in mixing.mix(docs(spark, [(1, None, "a"), (2, " ", None)])).collect()] == [0, 0]


@pytest.mark.parametrize("stopped", [True, False])
def test_small_source_with_one_short_document_in_a_shard(spark, monkeypatch, stopped):
    monkeypatch.setattr(mixing, "FINENESS", 1)  # blocks of 64 words on a small table
    large, per_source = (1, 2000) if stopped else (10, 100)
    rows = [(i, prose(i, 60), f"s{i // per_source}") for i in range(large * per_source)]
    rows += [(10_000 + i, prose(10_000 + i, 10), "z" if stopped else "a") for i in range(190)]
    monkeypatch.setattr(mixing, "SHARD", len(rows) // 190)
    mixed = mixing.mix(docs(spark, rows)).collect()
    small = [r.rill_mix for r in mixed if r.doc_id >= 10_000]
    assert small[0].target == 3 * 1900 if stopped else 1.4 * 1900 < small[0].target < 1.7 * 1900
    check(rows, mixed)
    parts = -(-(190 if stopped else 290) // mixing.SHARD)
    assert sum(m.taken % m.size > 0 for m in small) <= parts  # one cut a part


def test_rows_without_ids_and_equal_rows_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 200)
    rows = [(None, prose(i, 20), "a") for i in range(1500)] + [(5, prose(1, 20), "a")] * 1500 + [(i, "", "a") for i in range(9)]
    rows += [(100 + i, prose(i, 20), "b") for i in range(1000)] + [(None, None, None)] * 1500
    docs(spark, rows).write.parquet(f"{tmp_path}/d")
    table = spark.read.parquet(f"{tmp_path}/d")
    mixed = mixing.mix(table)
    check(rows, mixed.collect())
    assert counted(mixed.collect()) == counted(mixing.mix(table).collect())
    assert mixed.columns == [*table.columns, "rill_mix"]


def test_parts_are_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 200)
    rows = [(None, prose(i, 20), "a") for i in range(3000)] + [(5, prose(1, 20), "a")] * 3000
    docs(spark, rows).write.parquet(f"{tmp_path}/d")
    seen = []
    real = mixing.apportioned
    monkeypatch.setattr(mixing, "apportioned", lambda df, *a: seen.append(df.agg(mixing.F.max("votes")).first()[0]) or real(df, *a))
    check(rows, mixing.mix(spark.read.parquet(f"{tmp_path}/d")).collect())
    assert seen[1] <= 20 * 500


def test_many_small_sources(spark):
    rows = [(i, prose(i, 10 + i % 7), f"s{i // 2:04d}") for i in range(1200)] + [(10_000 + i, prose(i, 200), "z") for i in range(300)]
    check(rows, mixing.mix(docs(spark, rows)).collect())


def test_rows_without_words_stay_wherever_they_are_dealt(spark, monkeypatch):
    real, blank = mixing._narrow, mixing.F.col("rill_size") == 0
    other = mixing.F.when(blank, mixing.F.xxhash64("rill_order", mixing.F.lit(1))).otherwise(mixing.F.col("rill_order"))
    monkeypatch.setattr(mixing, "_narrow", lambda sized: real(sized.withColumn("rill_order", other)))
    rows = [(i, prose(i, 900) if i % 3 else " ", "a" if i % 2 else None) for i in range(24)]
    check(rows, mixing.mix(docs(spark, rows)).collect())
