"""Removal of word windows that repeat anywhere, by compaction of a de Bruijn graph of the corpus.

Edges are the windows of `WINDOW` words, nodes their overlaps. A window's anchor is the smallest hash among its
runs of `ANCHOR` words, so equal windows have equal anchors at equal places. Consecutive windows of a text that
share an anchor leave the scan as one piece, an edge of several windows, with the text and the place of its first
window as source coordinates: about one row for twelve words.

* An anchor met once has no repeated window. One count and one join drop these, most of the corpus.
* Pieces are counted, and those that occur twice are the repeated edges. A node between two of them does not branch
  if the occurrences that leave the one are all those that enter the other. A join over source coordinates finds
  these nodes; the edges there compact into one path, which all its occurrences run through from end to end.
* A path's words are read at its first source coordinates. Every occurrence has its own words compared with them,
  by a digest of 128 bits, before it is removed.
* At anchors where some pieces occur once the graph branches within a piece: there windows are compared one by one,
  by their words at the source coordinates of one instance of each piece.

Counts are combined before each exchange, and every join meets unique keys on one side. Keys of a passage in a third
of all texts are among the fewer than `HOT` that are broadcast, so its occurrences stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rill.llm.common import dropped, per_worker, saved

WINDOW, ANCHOR = 35, 12
#: Words whose hashes a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
#: Words that a task works on at once, if no text is longer; each takes about 300 bytes.
BLOCK = 400_000
BASE = 0x9E3779B97F4A7C15
KEY = ("doc_id", "text_hash")
#: Bits of a coordinate's hash in each of two sums: these hold 2^39 occurrences of an edge.
SUMMED = 24
#: A key that makes up more than one in so many rows is broadcast to them: there are fewer than so many such keys.
HOT = 1000


class WordHasher:
    """64-bit hashes of words; a bounded number is remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        for w in new:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values, by doubling: polynomial in an odd base modulo 2^64."""
    n, modulus = len(x) - width + 1, 1 << 64
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, part, size = np.zeros(n, np.uint64), 0, 1, x, 1
    base_power = BASE  # base ** size
    while True:
        if width & size:
            out += np.uint64(power) * part[done : done + n]
            done += size
            power = power * base_power % modulus
        if done == width:
            return mixed(out)
        part = part[:-size] + np.uint64(base_power) * part[size:]
        base_power = base_power * base_power % modulus
        size *= 2


def path_pieces(x: np.ndarray, ends: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """(anchor hash, piece hash, first window, windows) of texts laid end to end; `ends` are the texts' ends."""
    owner_end = np.repeat(ends, np.diff(ends, prepend=0))
    starts = np.flatnonzero(np.arange(len(x)) + window <= owner_end)
    if not len(starts):
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    runs, windows, reach = run_hashes(x, anchor), run_hashes(x, window), window - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(runs, reach)[starts].argmin(axis=1) + starts
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(first, append=len(at))
    s, p = starts[first], at[first]
    last = s + count - 1
    shape = ((p - s) * 64 + count).astype(np.uint64)
    piece = mixed(windows[s] + mixed(windows[last] + mixed(shape + np.uint64(BASE))))
    return runs[p], piece, s, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


PIECES = "anchor long, piece long, doc_id long, text_hash long, s long, n long"
#: Of a window: its place at the anchor and its hash. Of a path: no place, its first piece, its windows (n) and the
#: digest of its words. c is how often the piece occurs.
READ = "anchor long, place long, code long, doc_id long, text_hash long, s long, n long, c long, digest binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text_hash, text); a batch is worked on in blocks of about `BLOCK` words."""
    hasher = per_worker(("words",), WordHasher)
    names = [f.split()[0] for f in PIECES.split(", ")]
    for b in batches:
        row = 0
        while row < b.num_rows:
            block, sizes, first, total = [], [], row, 0
            while row < b.num_rows and total < BLOCK:
                words = (b.column(2)[row].as_py() or "").encode().split()
                block.append(hasher(words))
                sizes.append(len(words))
                total += len(words)
                row += 1
            ends = np.cumsum(sizes)
            anchor, piece, s, n = path_pieces(np.concatenate(block), ends)
            text = np.searchsorted(ends, s, side="right")
            ids, hashes = (b.column(k).slice(first, row - first).take(pa.array(text)) for k in (0, 1))
            s = s - (ends[text] - np.array(sizes)[text])
            yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(piece), ids, hashes, pa.array(s), pa.array(n)], names)


def span_digest(words: list[bytes], s: int, n: int) -> bytes:
    """Digest of the words of the `n` windows from word `s` on."""
    return hashlib.blake2b(b" ".join(words[s : s + n + WINDOW - 1]), digest_size=16).digest()


def _paths(asks: list[dict]) -> Iterator[tuple[dict, int]]:
    """The first edge and the windows of each path of a text's repeated edges; a joined edge follows the one before."""
    first, n = None, 0
    for a in sorted((a for a in asks if a["c"] > 1), key=lambda a: a["s"]):
        if first and not a["joined"]:
            yield first, n
        if not a["joined"]:
            first, n = a, 0
        n += a["n"]
    if first:
        yield first, n


def _windows(words: list[bytes], asks: list[dict], hasher: WordHasher) -> Iterator[tuple[dict, int, int, int]]:
    """(ask, place at the anchor, hash of the words, first word) of each window of the asked pieces."""
    line, at = b" ".join(words), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    runs = run_hashes(hasher(words), ANCHOR)
    for a in asks:
        p = a["s"] + int(runs[a["s"] : a["s"] + WINDOW - ANCHOR + 1].argmin())
        for s in range(a["s"], a["s"] + a["n"]):
            code = xxhash.xxh3_64_intdigest(line[at[s] : at[s + WINDOW] - 1])
            yield a, p - s, code - (code >> 63 << 64), s


def _read_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text_hash, text, asks): what the texts have at the coordinates that the asks name, as `READ`."""
    hasher = per_worker(("words",), WordHasher)
    names = [f.split()[0] for f in READ.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()]
    for b in batches:
        for row in range(b.num_rows):
            doc_id, text_hash, text, asks = (b.column(k)[row].as_py() for k in range(4))
            words, key = (text or "").encode().split(), (doc_id, text_hash)
            rows = [(a["anchor"], None, a["piece"], *key, a["s"], n, a["c"], span_digest(words, a["s"], n)) for a, n in _paths(asks)]
            compared = [a for a in asks if a["compared"]]
            if compared:
                found = _windows(words, compared, hasher)
                rows += [(a["anchor"], place, code, *key, s, 1, a["c"], None) for a, place, code, s in found]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text, so repeated ids and null ids need no care; equal rows fare alike."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))


def _same_key(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def joined_by(left: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """`left`, a saved table, joined with the saved `counted`: unique keys, and how often (c) `left` has them.

    More than one in `HOT` rows of `left` can have the same key for fewer than `HOT` keys. These are broadcast, and
    rows of other keys are exchanged.
    """
    often = F.col("c") > left.count() // HOT
    few = F.broadcast(counted.where(often))
    rest = left.join(few.select(*keys), keys, "left_anti").join(counted.where(~often), keys)
    return left.join(few, keys).unionByName(rest)


def _coordinates(s) -> tuple:
    """Two sums of hashes that stand for the coordinates at which word `s` is met."""
    h, low = F.xxhash64(*KEY, s), (1 << SUMMED) - 1
    return F.sum(F.shiftright(h, 64 - SUMMED)), F.sum(h.bitwiseAND(F.lit(low)))


def graph_edges(met: DataFrame) -> DataFrame:
    """(anchor, piece, doc_id, text_hash, s, n, c, compared, joined) of the different pieces of `met` that need
    their words read; the coordinates are those of a piece's first occurrence.

    An edge is `joined` if the node before it does not branch: a repeated edge ends where this one begins, and the
    occurrences of both meet there, every one of them. Then their first occurrences meet there too, so the join looks
    at these. An edge is `compared` if its anchor has other pieces too, and one of all these occurs once.
    """
    sums = [*_coordinates(F.col("s")), *_coordinates(F.col("s") + F.col("n"))]
    named = [x.alias(k) for x, k in zip(sums, ("in_a", "in_b", "out_a", "out_b"), strict=True)]
    first = F.min(F.struct(*KEY, "s", "n")).alias("at")
    counted = met.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("c"), first, *named)
    edges = saved(counted.select("*", "at.*").drop("at"))
    variants = edges.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least"))
    forks = variants.where("k > 1 and least = 1").select("anchor", F.lit(True).alias("fork"))
    before = edges.where("c > 1").select(*KEY, (F.col("s") + F.col("n")).alias("s"), "c", "out_a", "out_b")
    node = (F.col("e.s") == F.col("b.s")) & (F.col("e.c") == F.col("b.c")) & (F.col("in_a") == F.col("b.out_a")) & (F.col("in_b") == F.col("b.out_b"))
    flagged = edges.join(forks, "anchor", "left").where("c > 1 or fork").alias("e").join(before.alias("b"), _same_key("e", "b") & node, "left")
    flags = (F.col("fork").isNotNull().alias("compared"), F.col("b.c").isNotNull().alias("joined"))
    return flagged.select("anchor", "piece", *(f"e.{k}" for k in (*KEY, "s", "n", "c")), *flags)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, s, n, digest): runs of n windows from word s that all start elsewhere too. `docs` as by
    `_keyed`. A run with a digest counts only if its words have that digest."""
    pieces = saved(docs.select(*KEY, "text").mapInArrow(_pieces, PIECES))
    twice = saved(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    met = saved(joined_by(pieces, twice, ["anchor"]).drop("c"))
    dropped(pieces, twice)
    ask = F.struct("anchor", "piece", "s", "n", "c", "compared", "joined")
    asks = graph_edges(met).groupBy(*KEY).agg(F.collect_list(ask).alias("asks"))
    asked = docs.alias("d").join(asks.alias("a"), _same_key("d", "a")).select("d.doc_id", "d.text_hash", "d.text", "a.asks")
    read = saved(asked.mapInArrow(_read_sources, READ))  # equal rows give equal paths, made distinct, and windows of c > 1
    path = ("anchor", F.col("code").alias("piece"), F.col("n").alias("length"), "digest", "c")
    paths = saved(read.where("digest is not null").select(*path).dropDuplicates(["anchor", "piece"]))
    spans = joined_by(met, paths, ["anchor", "piece"]).select(*KEY, "s", F.col("length").alias("n"), "digest")
    windows, edge = read.where("digest is null"), ["anchor", "place", "code"]
    again = saved(windows.groupBy(*edge).agg(F.sum("c").alias("w")).where("w > 1").select(*edge))
    lone = windows.where("c = 1").join(again, edge, "left_semi").select(*KEY, "s", "n", "digest")
    return spans.unionByName(lone)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for row in range(b.num_rows):
            doc_id, text, spans = (b.column(k)[row].as_py() for k in range(3))
            words = (text or "").encode().split()
            if spans:
                kept = np.ones(len(words), bool)
                for x in spans:
                    if x["digest"] is None or x["digest"] == span_digest(words, x["s"], x["n"]):
                        kept[x["s"] : x["s"] + x["n"] + WINDOW - 1] = False
                left = [words[i] for i in np.flatnonzero(kept).tolist()]
            else:
                left = words
            rows.append((doc_id, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in RESULT.split(", ")])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of `docs` (doc_id, text).

    Windows of `WINDOW` words that occur twice anywhere, in one text too, lose all their words, every instance.
    Null, blank and shorter texts lose nothing. Repeated rows count as occurrences of each other.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed).distinct().groupBy(*KEY).agg(F.collect_list(F.struct("s", "n", "digest")).alias("spans"))
    met = keyed.alias("d").join(spans.alias("x"), _same_key("d", "x"), "left")
    return met.select("d.doc_id", "d.text", "x.spans").mapInArrow(_removed, RESULT)
