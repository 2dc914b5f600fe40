import random

import xxhash
from cases import DOCS, counted, docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from rill.llm import graph, simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Of (key, fingerprint) the smallest key that links reach, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return [least[find(i)] for i in range(len(prints))]


def test_odd_documents_against_brute_force(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    prints = [(i, brute_print(t)) for i, t, _ in DOCS]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True)]
    assert counted(got) == counted(want)


def test_no_rows(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


@settings(max_examples=300)
@given(radius=st.integers(1, 4), bits=st.data())
def test_masks_cover_every_pair_within_the_radius(radius, bits):
    flipped = bits.draw(st.sets(st.integers(0, 63), max_size=radius))
    changed = sum(1 << b for b in flipped)
    assert any(not changed & m for m in simhash.covering_masks(radius))


def test_links_against_all_pairs(spark):
    r, prints = random.Random(3), set()
    for _ in range(40):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(r.randrange(12)):
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = {x.node % 2**64: x.root for x in graph.connected_components(simhash.fingerprint_links(df)).collect()}
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    got = {}
    for i, p in enumerate(prints):
        got.setdefault(roots.get(p, ("alone", p)), []).append(i)
    assert all(want[i] == members[0] for members in got.values() for i in members)
    for a, b in ((x.a, x.b) for x in simhash.fingerprint_links(df).collect()):
        assert ((a ^ b) % 2**64).bit_count() <= 2


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 90)]
    edges = spark.createDataFrame(path + star + [(7, 7), (500, 501), (501, 500), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert len({roots[i] for i in range(100, 161)}) == 1
    assert len({roots[i] for i in range(90)}) == 1
    assert len(set(roots.values())) == 3 and set(roots.values()) <= set(roots)


def test_one_document_of_each_group_stays(spark):
    kept = simhash.keep_one(docs(spark))
    rows = kept.collect()
    assert kept.columns == docs(spark).columns
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids))
    prints = [(i, brute_print(t)) for i, t, _ in DOCS]
    assert {c for c in brute_components(prints) if c is not None} == {i for i in ids if i is not None}


def test_each_component_keeps_a_row_whatever_its_ids(spark):
    nameless = [(None, prose(50 + i, 40), "a") for i in range(6)]
    rows = [*nameless, nameless[0], (5, prose(50, 40), "b"), (7, prose(70, 40), "a"), (7, prose(71, 40), "a"), (8, prose(71, 40), "a"), (0, " ", "a"), (None, None, "a")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs(spark, rows)).collect()]
    want = [(None, t) for _, t, _ in nameless[1:]] + [(5, prose(50, 40)), (7, prose(70, 40)), (7, prose(71, 40)), (0, " ")]
    assert counted(kept) == counted(want)
