"""Toxicity by noisy-channel deobfuscation.

A character language model (four letters, counted over all documents) says how likely a restored text is; a
channel says what writing it as observed costs: look-alike signs for letters, signs and blanks put between
letters, letters repeated. Viterbi's algorithm over the lattice of readings finds the likeliest of all readings of
each word, and of each run of single characters that blanks pull apart, from end to end: it keeps the best way to
each of the model's contexts that a reading can reach, and no others are there. Restored words are scored with a
lexicon learned from labels, of whole words and of word families. A word that is longer than a lexicon word by up to
`ENDING` letters counts as its inflection, unless clean texts speak against it; a family is a beginning of `STEM`
letters that `FAMILY` or more different words of toxic texts share and that passes the same test as words do.

The lexicon is fitted on at most `SAMPLE` labelled documents outside the held-out fold, those with the smallest
XXH64 of doc_id. A word's toxic evidence is the number of different toxic texts, or of different neighbourhoods in
them, that it has, whichever is less, so neither copies nor one long text count for much. Scores combine the words
found by noisy-or over the base rate.

The model is bounded: 28^4 counts and `LEXICON` words. Scores use the text alone. Tokens of which less than an
eighth is letters are numbers or drawings and have no words.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rill.llm.common import dropped, per_worker, saved

SAMPLE, LEXICON = 8_000, 2_000
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
#: The least toxic share of a lexicon word's evidence, and how many words may pass by chance: Chernoff's bound on
#: the chance of a word's evidence, times the number of words tested, must stay below it.
MIN_SHARE, EXPECTED_FALSE = 0.85, 0.1

#: Letters of a lexicon word that may have inflections, and of what these add.
ROOT, ENDING = 5, 3
#: Least and most letters of a family's beginning, and its different words.
STEM, FAMILY = (5, 8), 4

#: Classes of characters: 0 a word border, 1-26 the letters a-z, 27 any other letter.
CLASSES, ORDER = 28, 4
CONTEXTS = CLASSES ** (ORDER - 1)
SMOOTHING = 4.0

LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs in nats.
SUBSTITUTED, DROPPED, SIGN_DROPPED, PARTED, REPEATED, REPEATED_AGAIN = 1.5, 1.0, 2.5, 1.0, 3.0, 0.3
#: Tokens that a worker remembers, and the longest of them. With more look-alikes than `FEW`, contexts are many and
#: are worked on as arrays, whose way back is cleared every `SETTLED` characters.
REMEMBERED, LONGEST_REMEMBERED, FEW, SETTLED = 300_000, 64, 10, 64
EDGES = ".,;:?\"'*&%#)]}[{~_-…»«“”‘’"


def letter_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" and len(c) == 1 else 27 if c.isalpha() else 0


def _class_table() -> np.ndarray:
    return np.array([letter_class(chr(i)) for i in range(0x110000)], np.int8)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(gram, n): counts of class four-grams over every whole text, lower-cased; border runs count as one border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = per_worker(("classes",), _class_table), np.zeros(CONTEXTS * CLASSES, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                c = np.concatenate([[0], table[points].astype(np.int64), [0]])
                c = c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]
                c = np.concatenate([np.zeros(ORDER - 2, np.int64), c])
                if len(c) >= ORDER:
                    grams, n = np.unique(((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:], return_counts=True)
                    total[grams] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram long, n long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray) -> array:
    """Of each class after each three, from counts of shape [28] * 4; shorter contexts smooth longer ones."""
    p = np.full(CLASSES, 1 / CLASSES)
    for order in range(1, ORDER + 1):
        c = counts.sum(axis=tuple(range(ORDER - order))).astype(float)
        p = (c + SMOOTHING * p) / (c.sum(axis=-1, keepdims=True) + SMOOTHING)
    return array("f", np.log(p).ravel().tolist())


@dataclass
class Restorer:
    """Reads words through the channel; remembers a bounded number of readings."""

    model: array
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def restore(self, observed: str) -> str:
        """The likeliest of all readings of `observed` (lower case): words with single blanks between."""
        steps = self._steps(observed)
        reading = self._few(steps) if sum(len(x[0]) > 1 or not x[3] for x in steps if x[0]) <= FEW else self._many(steps)
        return reading.strip()

    @staticmethod
    def _steps(observed: str) -> list[tuple[list[tuple[str, int, float]], float, float | None, bool]]:
        """Of each character: letters it may stand for (with class and cost), costs of a repeat and of a drop, and
        whether it is a letter itself, which is neither dropped nor a border."""
        steps, last, run = [], "", 0
        for ch in observed:
            run, last = (run + 1 if ch == last else 1), ch
            plain = letter_class(ch)
            letters = [(ch, plain, 0.0)] if plain else [(x, ord(x) - 96, SUBSTITUTED) for x in LOOKALIKES.get(ch, "")]
            dropped = None if plain else 0.1 if ch == " " else SIGN_DROPPED if letters else DROPPED
            steps.append((letters, REPEATED_AGAIN if run > 2 else REPEATED, dropped, bool(plain)))
        return steps

    def _few(self, steps: list) -> str:
        """One dictionary of contexts: the score of the best way there, and its letters as linked pairs."""
        model, ways, other = self.model, {0: (0.0, None)}, ""
        for letters, repeated, dropped, plain in steps:
            new: dict[int, tuple[float, tuple | None]] = {}
            for context, (score, text) in ways.items():
                at, final = context * CLASSES, context % CLASSES
                for letter, k, cost in letters:
                    to, value = (at + k) % CONTEXTS, score - cost + model[at + k]
                    if to not in new or value > new[to][0]:
                        new[to] = (value, (letter, text))
                    if final == k and (k < CLASSES - 1 or other == letter):
                        value = score - cost - repeated
                        if context not in new or value > new[context][0]:
                            new[context] = (value, text)
                if not plain:
                    if context not in new or score - dropped > new[context][0]:
                        new[context] = (score - dropped, text)
                    if final:
                        to, value = at % CONTEXTS, score - PARTED + model[at]
                        if to not in new or value > new[to][0]:
                            new[to] = (value, (" ", text))
            ways, other = new, letters[0][0] if plain else other
        text = max(((score + model[c * CLASSES], c, text) for c, (score, text) in ways.items()), key=lambda x: x[:2])[2]
        out = []
        while text is not None:
            out.append(text[0])
            text = text[1]
        return "".join(reversed(out))

    def _many(self, steps: list) -> str:
        """The same with arrays: contexts in order, scores, and for each step where its ways come from."""
        model = np.frombuffer(self.model, np.float32)
        contexts, scores, other = np.zeros(1, np.int64), np.zeros(1), ""
        settled: list[str] = []
        back: list[tuple[np.ndarray, np.ndarray, list[str]]] = []
        for place, (letters, repeated, dropped, plain) in enumerate(steps, 1):
            at, final, every = contexts * CLASSES, contexts % CLASSES, np.arange(len(contexts))
            parts, signs = [], [""]
            for letter, k, cost in letters:
                signs.append(letter)
                parts.append(((at + k) % CONTEXTS, scores - cost + model[at + k], every, len(signs) - 1))
                if k < CLASSES - 1 or other == letter:
                    same = every[final == k]
                    parts.append((contexts[same], scores[same] - cost - repeated, same, 0))
            if not plain:
                signs.append(" ")
                inside = every[final > 0]
                parts.append((contexts, scores - dropped, every, 0))
                parts.append((at[inside] % CONTEXTS, scores[inside] - PARTED + model[at[inside]], inside, len(signs) - 1))
            to, value, come = (np.concatenate([p[i] for p in parts]) for i in range(3))
            sign = np.repeat([p[3] for p in parts], [len(p[0]) for p in parts])
            order = np.lexsort((-value, to))
            first = order[np.append(True, np.diff(to[order]) > 0)]
            contexts, scores, other = to[first], value[first], letters[0][0] if plain else other
            back.append((come[first], sign[first], signs))
            if place % SETTLED == 0:
                self._settle(back, settled)
        best = int(np.lexsort((-contexts, -(scores + model[contexts * CLASSES])))[0])
        return "".join([*settled, _read_back(back, best)])

    @staticmethod
    def _settle(back: list, settled: list[str]) -> None:
        """Put out and forget the steps that all ways share."""
        ways = np.arange(len(back[-1][0]))
        for k in range(len(back) - 1, -1, -1):
            ways = np.unique(back[k][0][ways])
            if len(ways) == 1 and k:
                settled.append(_read_back(back[:k], int(ways[0])))
                del back[:k]
                return

    def words(self, token: str) -> tuple[str, ...]:
        """Restored words of one blank-free token of a lower-cased text."""
        found = self.known.get(token)
        if found is None:
            found = self._read(token)
            if len(token) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token] = found
        return found

    def _read(self, token: str) -> tuple[str, ...]:
        bare = token.strip(EDGES)
        if bare.isalpha():
            if not _DOUBLED.search(bare):
                return (bare,)
        elif not bare or 8 * sum(map(str.isalpha, bare)) < len(bare):
            return ()
        return tuple(self.restore(bare).split())

    def spaced(self, text: str) -> list[str]:
        """Restored words of the runs of single characters with blanks between."""
        out = []
        for m in _SPACED.finditer(text):
            out += self.restore(" ".join(m[0].split())).split()
        return out


def _read_back(back: list, way: int) -> str:
    out = []
    for come, sign, signs in reversed(back):
        out.append(signs[sign[way]])
        way = int(come[way])
    return "".join(reversed(out))


_DOUBLED = re.compile(r"(.)\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")


def _restorer(letters: array) -> Restorer:
    """The worker's restorer for this language model, with what it has read before."""
    return per_worker(("restorer", xxhash.xxh64_intdigest(letters.tobytes())), lambda: Restorer(letters))


def inflected(word: str) -> list[str]:
    """What a word may be an inflection of, as the lexicon writes it; longest first."""
    return [word[:k] + "+" for k in range(len(word) - 1, max(ROOT, len(word) - ENDING) - 1, -1)]


def beginnings(word: str) -> list[str]:
    """The families that a word may be of, as the lexicon writes them; longest first."""
    return [word[:k] + "*" for k in range(min(STEM[1], len(word) - 1), STEM[0] - 1, -1)]


@dataclass(frozen=True)
class Model:
    letters: array
    lexicon: dict[str, float]
    base: float

    def find(self, words: Iterable[str]) -> Iterator[str]:
        """The lexicon entry of each word that has one: itself, or the longest that it inflects, or its family."""
        lexicon = self.lexicon
        for w in words:
            if w in lexicon:
                yield w
            elif len(w) > ROOT:
                hit = next((f for f in inflected(w) + beginnings(w) if f in lexicon), None)
                if hit is not None:
                    yield hit

    def score(self, found: set[str]) -> float:
        clean = 1 - self.base
        for w in sorted(found):
            clean *= 1 - self.lexicon[w]
        return 1 - clean


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the held-out fold; rows without id are not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(toxic, text) of the labelled sample; its ids are broadcast, `sample` bounds them."""
    of = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    one = of.groupBy(F.col("doc_id").cast("long").alias("rill_id")).agg(F.max("toxic").alias("rill_toxic"))
    chosen = one.orderBy(F.xxhash64("rill_id"), "rill_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("rill_id"), F.col("text").cast("string"))
    return texts.join(F.broadcast(chosen), "rill_id").select((F.col("rill_toxic") == 1).alias("toxic"), "text")


def _evidence_rows(letters: array) -> Callable:
    """Of (toxic, text): each word's neighbourhoods in toxic texts, and in how many clean texts of a batch it is."""

    def features(words: Iterable[str]) -> Iterator[str]:
        for w in words:
            yield w
            yield from inflected(w)
            yield from beginnings(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, digest = _restorer(letters), xxhash.xxh64_intdigest
        for b in batches:
            toxic: set[tuple[str, int, int]] = set()
            clean: Counter[str] = Counter()
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = (text or "").lower()
                read = [w for t in low.split() for w in restorer.words(t)]
                if label:
                    text_hash = digest(low) >> 1
                    for i, w in enumerate(read):
                        around = digest(" ".join([*read[max(0, i - 1) : i], *read[i + 1 : i + 2]])) >> 1
                        toxic.update((f, around, text_hash) for f in features([w]))
                    toxic.update((f, text_hash, text_hash) for f in features(restorer.spaced(low)))
                else:
                    clean.update(set(features({*read, *restorer.spaced(low)})))
            rows = [(*x, 0) for x in toxic] + [(w, None, None, n) for w, n in clean.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "around", "whole", "clean"])

    return run


class Finder:
    """Lexicon entries of texts; remembers a bounded number of tokens, most of which have none."""

    def __init__(self, model: Model):
        self.model, self.restorer, self.known = model, _restorer(model.letters), {}

    def __call__(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        tokens, known = set(low.split()), self.known
        if new := tokens.difference(known):
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = tokens
            for t in new:
                known[t] = tuple(self.model.find(self.restorer.words(t)))
        found = {hit for t in tokens if (hits := known[t]) for hit in hits}
        for t in new:
            if len(t) > LONGEST_REMEMBERED:
                del known[t]
        return found.union(self.model.find(self.restorer.spaced(low)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Language model over all of `docs` (text), lexicon from `labels` (doc_id, toxic); see the module's text."""
    counts = np.zeros(CONTEXTS * CLASSES)
    for gram, n in count_ngrams(docs).collect():
        counts[gram] = n
    letters = log_probabilities(counts.reshape([CLASSES] * ORDER))
    training = training_texts(docs, labels, sample)
    rows = saved(training.mapInArrow(_evidence_rows(letters), "word string, around long, whole long, clean long"))
    seen = F.least(F.countDistinct("around"), F.countDistinct("whole")).alias("toxic")
    evidence = saved(rows.groupBy("word").agg(seen, F.sum("clean").alias("clean")))
    whole, kind = evidence.where(~F.col("word").rlike("[*+]$")), F.substring("word", -1, 1)
    letters_of = lambda k: F.substring("word", 1, k)
    stems = F.array(*(F.when(F.length("word") > k, F.concat(letters_of(k), F.lit("*"))) for k in range(STEM[0], STEM[1] + 1)))
    families = whole.where("toxic > 0").select(F.explode(stems).alias("word")).groupBy("word").count().where(F.col("count") >= FAMILY)
    tested = whole.union(evidence.where(kind == "*").join(families, "word", "left_semi"))
    words, toxic, clean = whole.agg(F.count(F.lit(1)), F.sum("toxic"), F.sum("clean")).first()
    lexicon = {}
    if toxic:
        chance = toxic / (toxic + clean)
        n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - chance))).otherwise(0.0) if chance < 1 else F.lit(0.0)
        strength = n * (share * F.log(share / chance) + rest)
        strong = tested.where((share >= MIN_SHARE) & (strength >= math.log(words) - math.log(EXPECTED_FALSE)))
        weight = ((F.col("toxic") + 0.1) / (n + 1.0)).alias("weight")
        best = strong.orderBy(F.desc(strength), "word").limit(LEXICON).select("word", weight)
        lexicon = {r["word"]: r["weight"] for r in best.collect()}
        roots = [w + "+" for w in lexicon if len(w) >= ROOT and w[-1] != "*"]
        against = {r["word"] for r in evidence.where(F.col("word").isin(roots) & (share < MIN_SHARE)).select("word").collect()}
        lexicon |= {w: lexicon[w[:-1]] for w in roots if w not in against}
    dropped(rows, evidence)

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(Model(letters, lexicon, 0.0))
        for b in batches:
            none = [not find(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(none, pa.bool_())], ["toxic", "none"])

    without = training.mapInArrow(bare, "toxic boolean, none boolean").where("none")
    n, t = without.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    return Model(letters, lexicon, (t + 0.1) / (n + 10.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs` (doc_id, text).

    Null and empty texts have the base rate as score. Repeated rows and rows without id are scored like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(model)
        for b in batches:
            scores = [model.score(find(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
