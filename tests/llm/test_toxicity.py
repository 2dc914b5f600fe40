import random
import zlib

import numpy as np
import pytest
from cases import DOCS, docs, prose

from rill.llm import toxicity

BAD = ("idiot", "moron", "worthless", "stupid")
LEET = str.maketrans("oiesat", "01354+")


def corpus(n=900):
    r, rows, labels = random.Random(0), [], []
    for i in range(n):
        w, bad = prose(i, 60).split(), r.random() < 0.3
        if bad:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "", "s", "ic"]))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    frame = docs(spark, rows)
    return rows, labels, toxicity.fit(frame, spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int"))


def test_counts_cover_every_whole_text(spark):
    counts = {r.gram: r.n for r in toxicity.count_ngrams(docs(spark)).collect()}
    want: dict[int, int] = {}
    for _, text, _ in DOCS:
        k = [0, 0, 0]
        for c in [*map(toxicity.letter_class, (text or "").lower()), 0]:
            if c or k[-1]:
                k.append(c)
        for i in range(len(k) - 3):
            g = ((k[i] * 28 + k[i + 1]) * 28 + k[i + 2]) * 28 + k[i + 3]
            want[g] = want.get(g, 0) + 1
    assert counts == want


def test_probabilities_sum_to_one():
    counts = np.random.default_rng(0).integers(0, 5, [28] * 4)
    p = np.exp(np.array(toxicity.log_probabilities(counts))).reshape(-1, 28)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


@pytest.mark.parametrize("written", ["1d10t", "i.d.i.o.t", "iiddiioott", "idiooooot", "!d!ot", "id-iot", "IDI0T!!", "(idiot)"])
def test_restoration(fitted, written):
    restorer = toxicity.Restorer(fitted[2].letters)
    assert restorer.words(written.lower()) == ("idiot",)


def readings(observed, model):
    """Every reading of `observed`, with its score."""
    out = {("", 0.0)}
    last, run = "", 0
    for ch in observed:
        run, last = (run + 1 if ch == last else 1), ch
        plain = toxicity.letter_class(ch)
        letters = [(ch, 0.0)] if plain else [(x, toxicity.SUBSTITUTED) for x in toxicity.LOOKALIKES.get(ch, "")]
        repeated = toxicity.REPEATED_AGAIN if run > 2 else toxicity.REPEATED
        new = set()
        for text, score in out:
            for x, cost in letters:
                new.add((text + x, score - cost))
                if text[-1:] == x:
                    new.add((text, score - cost - repeated))
            if not plain:
                new.add((text, score - (0.1 if ch == " " else toxicity.SIGN_DROPPED if letters else toxicity.DROPPED)))
                if text and text[-1] != " ":
                    new.add((text + " ", score - toxicity.PARTED))
        out = new

    def likely(text):
        classes = [0, 0, 0, *map(toxicity.letter_class, text), 0]
        return sum(model[((a * 28 + b) * 28 + c) * 28 + d] for a, b, c, d in zip(classes, classes[1:], classes[2:], classes[3:]))  # noqa: B905

    return {(text, score + likely(text)) for text, score in out}


def test_restoration_is_the_best_of_all_readings(fitted):
    restorer, r = toxicity.Restorer(fitted[2].letters), random.Random(5)
    model = np.frombuffer(restorer.model, np.float32).astype(float)
    tokens = ["".join(r.choice("aeiostdnéé10!6@-. $") for _ in range(r.randrange(1, 8))) for _ in range(300)] + ["1d1!0t", "!!11||", "éé1é", "a-a--b"]
    for token in tokens:
        scores = {}
        for text, score in readings(token, model):
            scores[text.strip()] = max(score, scores.get(text.strip(), -1e9))
        best = max(scores.values())
        steps = restorer._steps(token)
        for way in (restorer.restore(token), restorer._few(steps).strip(), restorer._many(steps).strip()):
            assert scores[way] > best - 1e-3, (token, way, max(scores, key=scores.get))


def test_long_runs_of_signs_are_read_alike_by_both_ways(fitted, monkeypatch):
    restorer, r = toxicity.Restorer(fitted[2].letters), random.Random(6)
    monkeypatch.setattr(toxicity, "SETTLED", 8)
    for _ in range(20):
        steps = restorer._steps("".join(r.choice("aeist10!6@-") for _ in range(120)))
        assert restorer._few(steps) == restorer._many(steps)


@pytest.mark.parametrize("text", ["Please travel by train to the traditional market and work with the world", "The cloud closed the clock", "a trader transports trays", "An idea worth more than words"])
def test_ordinary_words_that_begin_alike_are_clean(spark, text):
    r, rows, labels = random.Random(2), [], []
    for i in range(900):
        w, bad = prose(i, 60).split(), r.random() < 0.3
        if bad:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["worthless", "trash", "clown", "scum", "idiot", "moron"]))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, 1, int(bad)))
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    find = toxicity.Finder(model)
    assert model.score(find(text)) < 0.3 < model.score(find("what idiots"))


def test_one_long_toxic_text_teaches_little(spark):
    rows = [(i, prose(i, 60) + (f" idiot {prose(10_000 + i, 9)}" if i % 3 == 0 else ""), "a") for i in range(300)] + [(1000, " ".join(f"{a} zzyx {b}" for a, b in zip(prose(1, 900).split(), prose(2, 900).split(), strict=True)), "a")]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(1000, 1, 1)]
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "idiot" in model.lexicon and not any(w.startswith("zzyx") or w.startswith("zyx") for w in model.lexicon)


def test_spaced_letters_are_joined_and_parted(fitted):
    restorer = toxicity.Restorer(fitted[2].letters)
    assert restorer.spaced("it is i d i o t  m 0 r o n and a b") == ["idiot", "moron"]
    assert restorer.spaced("a b") == []


def test_words_of_long_tokens_and_runs_are_never_cut(fitted):
    restorer = toxicity.Restorer(fitted[2].letters)
    for before in range(56, 70):
        short = -before % 5  # words of four and five characters, with their signs
        token = "was-" * short + "with-" * ((before - 4 * short) // 5) + "idiot-" + "that-" * 20
        assert token.index("idiot") == before and "idiot" in restorer.words(token), before
    found = [restorer.spaced(" ".join("with" * 28 + "that"[: k % 4] + "with" * (k // 4) + "idiot" + "that" * 9)) for k in range(8, 24)]
    assert all(any("idiot" in w for w in words) for words in found)


def test_held_out_documents(spark, fitted):
    rows, labels, model = fitted
    scored = {r.doc_id: r for r in toxicity.score(docs(spark, rows), model).collect()}
    for i, _, bad in labels:
        assert scored[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(scored[i], bad) for i, _, bad in labels if scored[i].held_out]
    assert sum(r.predicted == bad for r, bad in held) >= 0.97 * len(held)
    assert all(r.predicted == (r.score >= 0.3) for r, _ in held)


def test_disguised_documents(spark, fitted):
    model = fitted[2]
    r = random.Random(1)
    disguise = [str.upper, lambda w: w.translate(LEET), lambda w: " ".join(w), lambda w: "".join(c * r.randrange(1, 4) for c in w), lambda w: ".".join(w)]
    rows = [(i, prose(5000 + i, 30) + " " + disguise[i % 5](BAD[i % 4]) + " " + prose(6000 + i, 30), "a") for i in range(60)]
    clean = [(1000 + i, prose(7000 + i, 60), "a") for i in range(60)]
    got = {x.doc_id: x.predicted for x in toxicity.score(docs(spark, rows + clean), model).collect()}
    assert sum(got[i] for i in range(60)) >= 54
    assert sum(got[1000 + i] for i in range(60)) <= 1


def test_labels_of_held_out_rows_are_never_read(spark, fitted):
    rows, labels, model = fitted
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = toxicity.fit(docs(spark, rows), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert again == model


def test_odd_documents(spark, fitted):
    got = toxicity.score(docs(spark), fitted[2]).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, []), empty)
    assert model.lexicon == {} and toxicity.score(docs(spark, []), model).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(docs(spark), toxicity.fit(docs(spark), empty)).collect())
