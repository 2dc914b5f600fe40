import hashlib
import random
from collections import Counter

import numpy as np
from cases import DOCS, PASSAGE, counted, docs, prose

from rill.llm import substring


def brute(rows):
    split = [(t or "").encode().split() for _, t, _ in rows]
    starts = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    for (i, _, _), w in zip(rows, split, strict=True):
        gone = {s + k for s in range(len(w) - 34) if starts[tuple(w[s : s + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept).hexdigest()


def test_odd_documents_against_brute_force(spark):
    assert counted(substring.remove_repeats(docs(spark)).collect()) == counted(brute(DOCS))


def test_many_variants_around_shared_passages(spark):
    r, parts = random.Random(4), PASSAGE.split()
    rows = []
    for i in range(150):
        a = r.randrange(len(parts) - 36)
        piece = parts[a : a + r.randrange(33, 61)]
        if r.random() < 0.3:
            piece = piece[:20] + ["other"] + piece[20:]
        rows.append((i, " ".join([prose(i, r.randrange(30)), *piece, prose(-i, r.randrange(30))] * r.randrange(1, 3)), "a"))
    assert counted(substring.remove_repeats(docs(spark, rows)).collect()) == counted(brute(rows))


def test_few_different_words(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(120))), "a") for i in range(60)] + [(99, "a " * 500, "b")]
    assert counted(substring.remove_repeats(docs(spark, rows)).collect()) == counted(brute(rows))


def test_no_rows(spark):
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_run_hashes_are_those_of_runs_alone():
    x = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    for width in (1, 2, 12, 35, 64):
        whole = substring.run_hashes(x, width)
        assert len(whole) == 201 - width
        assert all(substring.run_hashes(x[i : i + width], width)[0] == whole[i] for i in range(0, len(whole), 17))
    assert len(substring.run_hashes(x[:3], 4)) == 0


def edges_of(spark, rows):
    met = docs(spark, rows).selectExpr("doc_id", "xxhash64(text) text_hash", "text").mapInArrow(substring._pieces, substring.PIECES)
    return substring.graph_edges(met).collect()


def test_repeated_texts_are_one_path(spark):
    long = prose(1, 600)
    edges = [e for e in edges_of(spark, [(1, long, "a"), (2, long, "a"), (3, long, "a")])]
    assert len(edges) > 20 and all(e.c == 3 and e.doc_id == 1 and not e.compared for e in edges)
    assert sum(e.joined for e in edges) == len(edges) - 1
    assert [(a["s"], n) for a, n in substring._paths([e.asDict() for e in edges])] == [(0, len(long.split()) - 34)]


def test_paths_end_where_nodes_branch(spark):
    """The middle of 1 and 2 goes on in 3: each part is a path that all its occurrences run through."""
    a, b, c = (prose(i, 200) for i in (11, 12, 13))
    rows = [(1, f"{a} {b}", "x"), (2, f"{a} {b}", "x"), (3, f"{b} {c}", "x"), (4, f"{b} {c}", "x"), (5, a, "x")]
    asks = [e.asDict() for e in edges_of(spark, rows)]
    by_text = {i: [a for a in asks if a["doc_id"] == i] for i in (1, 3)}
    lengths = {i: sorted(n for _, n in substring._paths(v)) for i, v in by_text.items()}
    assert all(1 < len(v) < 12 for v in lengths.values()), lengths
    assert counted(substring.remove_repeats(docs(spark, rows)).collect()) == counted(brute(rows))


def test_spans_of_other_words_stay(spark):
    text = prose(5, 80)
    words = text.encode().split()
    right, wrong = (substring.span_digest(w, 0, 10) for w in (words, words[::-1]))
    for digest, removed in ((right, 44), (wrong, 0), (None, 44)):
        df = spark.createDataFrame([(1, text, [(0, 10, digest)])], "doc_id long, text string, spans array<struct<s: long, n: long, digest: binary>>")
        assert df.mapInArrow(substring._removed, substring.RESULT).first().n_removed == removed


def test_hot_and_rare_keys_are_joined_alike(spark, monkeypatch):
    rows = [(i, PASSAGE if i % 3 else prose(i, 90) + " " + prose(i // 9, 60), "a") for i in range(90)]
    want = counted(brute(rows))
    for hot in (1, 20, 10**6):
        monkeypatch.setattr(substring, "HOT", hot)
        assert counted(substring.remove_repeats(docs(spark, rows)).collect()) == want


def test_periodic_and_repeated_rows(spark):
    line = prose(3, 12)
    rows = [(None, f"{line} " * 40, "a"), (None, f"{line} " * 40, "a"), (7, f"{prose(4, 50)} {line} {line} {line} {line}", "a"), (7, PASSAGE, "b"), (7, PASSAGE, "b")]
    assert counted(substring.remove_repeats(docs(spark, rows)).collect()) == counted(brute(rows))
