import random
import re
from collections import Counter

import numpy as np
from cases import DOCS, counted, docs, prose

from rill.llm import quality

S = r"[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    w = re.findall(S, t)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(S, x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_statistics_against_brute_force(spark):
    rows = [*DOCS, (30, "a$ b# <c> | && " * 3, "a"), (31, "x y z\nx y z\n x y z", "a")]
    got = quality.judge(docs(spark, rows), []).collect()
    assert counted(got) == counted((i, *brute(t), not brute(t)[5]) for i, t, _ in rows)


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_rules(docs(spark), labels) == []
    assert quality.judge(docs(spark, []), []).count() == 0


def test_learned_list_on_held_out_rows(spark):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        text, bad = prose(i, 60), r.random() < 0.3
        if bad:
            text = text.upper().replace(" ", "!! ") if r.random() < 0.5 else re.sub(" ", "*** ", text)
        rows.append((i, text, "a"))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 0, 0), (5, None, 0), (10_000, 0, 1)]
    train = spark.createDataFrame([x for x in labels if x[0] is None or x[0] % 3], "doc_id long, quality int, toxic int")
    rules = quality.fit_rules(docs(spark, rows), train)
    assert 1 <= len(rules) <= 4 and all(str(c) for rule in rules for c in rule)
    kept = {x.doc_id: x.kept for x in quality.judge(docs(spark, rows), rules).collect()}
    held = [(i, q) for i, q, _ in labels if i is not None and i % 3 == 0 and i < 600]
    assert all(kept[i] == (q == 1) for i, q in held)
    good = quality.keep_good(docs(spark, rows), rules)
    assert good.columns == docs(spark).columns and good.count() == sum(kept.values())


def test_driver_gets_a_row_for_each_sampled_id(spark, monkeypatch):
    rows = [(7, prose(i, 30), "a") for i in range(500)] + [(i, prose(i, 30), "a") for i in range(100, 120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (7, *range(100, 120))], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "learn_rules", lambda rates, bad: seen.append(len(rates)) or [])
    quality.fit_rules(docs(spark, rows), labels, sample=10)
    assert seen and seen[0] <= 10


def test_noise_teaches_nothing():
    r = np.random.default_rng(1)
    assert quality.learn_rules(r.random((900, len(quality.RATES))), r.random(900) < 0.1) == []


def test_plan_has_no_python(spark):
    text = quality.judge(docs(spark), [(quality.Condition("symbol_rate", True, 5.0),)])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
