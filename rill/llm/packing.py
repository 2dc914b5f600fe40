"""Best-fit packing of token sequences, with certified bin counts and exchange between partitions.

Texts become token ids with an end id; only documents longer than a sequence are cut. Pieces are dealt, sorted by
length, one by one into shards of bounded size, so that all shards have alike lengths, and each is packed best-fit
decreasing. Dual feasible functions map lengths so that the sum of
mapped lengths, over the capacity, bounds the number of any packing's sequences from below: a shard whose count
equals the bound is certified, and final. A shard with a gap gives its emptiest sequences to an exchange, as many
as have the room that the gap asks for; these are dealt, whole, into new shards of bounded size and packed again,
which counts only where it saves sequences. Rounds end when no gap is left, when a round frees fewer than
`MIN_FREED` of the exchanged sequences, or when all of them were in one shard. So there are at most as many
sequences as the bounds' sum and the gaps that are left; certified shards waste less than a sequence each.

Each round is written to the shared folder. Packing moves (id, length) rows alone, never texts or ids.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rill.llm.common import dropped, per_worker, saved

CAPACITY, END_ID = 4096, 1
#: Pieces in a shard on average; a task holds about a hundred bytes for each.
SHARD = 20_000
#: Chunks whose ids a worker remembers, in each of two generations, and the sum of their characters.
REMEMBERED, REMEMBERED_CHARS = 150_000, 3_000_000
#: A round that frees less than this share of the sequences it was given is the last.
MIN_FREED = 0.002

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, shard_sequences long, shard_bound long"


class Remembered(dict):
    """A bounded cache of two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old, self.chars = make, most, {}, 0

    def learn(self, keys: set[str]) -> None:
        new = keys.difference(self)
        self.chars += sum(map(len, new))
        if len(self) + len(new) > self.most or self.chars > REMEMBERED_CHARS:
            self.old = dict(self) if self.chars <= 2 * REMEMBERED_CHARS else {}
            self.clear()
            new, self.chars = keys, sum(map(len, keys))
        known = {k: v for k in new if (v := self.old.get(k)) is not None}
        self.update(known)
        if missing := list(new.difference(known)):
            self.update(self.make(missing))


class ChunkEncoder:
    """Ids of texts, encoded a chunk between blanks at a time and remembered.

    The vocabulary's normalizer and splitter work inside such chunks only, so the ids of a text are those of its
    chunks in a row. They fold case and part full stops and commas from what stands before, unless that is a sign
    as well; texts of Latin-1 characters are folded and parted first, which makes for fewer different chunks.
    Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.model = self.tokenizer.model
        self.known = Remembered(self._encoded)
        self.end = np.uint32(END_ID).astype("<u4").tobytes()
        probe = "One wörd,\ntwo. It's 3 x!"
        if next(self.encode([probe])).tolist() != [*self.tokenizer.encode(probe, add_special_tokens=False).ids, END_ID]:
            raise ValueError(f"{path}: words are not encoded one by one, in lower case and as bytes")

    def _encoded(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """A word of Latin-1 letters goes straight to the library's model, as the splitter would hand it over."""
        letters, others, tokenize = [], [], self.model.tokenize
        for c in chunks:  # of Latin-1 letters no change of case makes signs
            (letters if c.isalpha() and (c.isascii() or max(c) <= "\xff") else others).append(c)
        for c in letters:
            word = c.lower() if c.isascii() else c.lower().translate(_BYTES)
            yield c, array("I", [t.id for t in tokenize(word)]).tobytes()
        for c, e in zip(others, self.encode_batch(others, add_special_tokens=False), strict=True):
            yield c, array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text with the end id; texts are taken in blocks of about a hundred thousand chunks."""
        at = 0
        while at < len(texts):
            block, n = [], 0
            while at < len(texts) and n < 100_000:
                block.append(_chunks(texts[at]))
                n += len(block[-1])
                at += 1
            self.known.learn(set().union(*block))
            known = self.known.__getitem__
            for chunks in block:
                yield np.frombuffer(b"".join(map(known, chunks)) + self.end, "<u4")


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters as byte-level vocabularies write their UTF-8 bytes: printable bytes as the characters of
    the same number, the others as those from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in printable]
    of_byte = {i: chr(i) for i in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {i: "".join(of_byte[b] for b in chr(i).encode()) for i in range(256)}


_BYTES = _byte_letters()

#: Of each Latin-1 character: d a full stop or comma, x a letter, digit or white space, s any other sign, which the
#: separators 28 to 31 are to the vocabulary's splitter.
_KINDS = bytes(b"d"[0] if chr(i) in ".," else b"x"[0] if chr(i).isalnum() or chr(i).isspace() and not 28 <= i <= 31 else b"s"[0] for i in range(256))


def _chunks(text: str) -> list[str]:
    try:
        low = text.lower()
        kinds = low.encode("latin-1").translate(_KINDS)
        if b"sd" not in kinds and b"dd" not in kinds:
            text = low.replace(".", " .").replace(",", " ,")
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each row of `docs` (doc_id, text); a null text is an empty one and gives one piece, the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("chunks", vocabulary), lambda: ChunkEncoder(vocabulary))
        for b in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(texts), strict=True):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fills. Each item, longest first, goes where least room is left.

    Open bins are kept by room; a bit mask of rooms in use finds the smallest sufficient one.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fitting := used >> n:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        by_room[room - n].append(b)
        used |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound that three families of dual feasible functions give: no packing has fewer bins."""
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.flatnonzero(counts)
    counts = counts[sizes]
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 6):  # rounding: x (k + 1) / C whole keeps x, else floor(x (k + 1) / C) C / k
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    for e in np.unique(np.concatenate([sizes[sizes <= capacity // 2], capacity - sizes[sizes > capacity // 2]])):
        # threshold: above C - e counts as C, below e as 0
        value = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
        if e > 0:  # multiples of e in the room: above half a bin 2 (floor(C/e) - floor((C-x)/e)), at half floor(C/e), else 2 floor(x/e)
            whole = capacity // e
            value = np.where(2 * sizes > capacity, 2 * (whole - (capacity - sizes) // e), np.where(2 * sizes == capacity, whole, 2 * (sizes // e)))
            best = max(best, -(-int((value * counts).sum()) // (2 * whole)))
    return best


def given_up(fills: np.ndarray, gap: int, capacity: int = CAPACITY) -> np.ndarray:
    """Which sequences a shard exchanges: its emptiest, until their room would do without `gap` sequences."""
    out = np.zeros(len(fills), bool)
    if gap > 0:
        order = np.argsort(fills, kind="stable")
        enough = int(np.searchsorted(np.cumsum(capacity - fills[order]), gap * capacity)) + 1
        out[order[: max(enough, gap + 1)]] = True
        out[fills == capacity] = False
    return out


def _pack_shard(table: pa.Table, round_no: int, capacity: int) -> pa.Table:
    """The shard's rows with sequence, offset and certificate; `open` are those given to the exchange.

    From the second round on rows have sequences already, which stay if the new packing saves none.
    """
    table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
    lengths, shard = table["length"].to_numpy(), table["shard"][0].as_py()
    bins, offsets, fills = best_fit_decreasing(lengths, capacity)
    sequence = (round_no << 56) + (shard << 24) + bins
    if round_no:
        before, old = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)
        if len(before) <= len(fills):
            bins, offsets, sequence = old, table["offset"].to_numpy(), before[old]
            fills = np.bincount(bins, weights=lengths).astype(np.int64)
    bound = lower_bound(lengths, capacity)
    columns = {c: table[c] for c in (f.split()[0] for f in PIECES.split(", "))}
    columns |= {"sequence_id": pa.array(sequence), "offset": pa.array(offsets)}
    columns |= {k: pa.array(np.full(len(bins), v, np.int64)) for k, v in (("shard_sequences", len(fills)), ("shard_bound", bound))}
    return pa.table(columns | {"open": pa.array(given_up(fills, len(fills) - bound, capacity)[bins])})


def _shard_packer(round_no: int, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        return _pack_shard(table, round_no, capacity)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """`pieces` with sequence_id and offset, and their last shard's certificate: its sequences and lower bound.

    `pieces` are to be a saved table: rows of one length are dealt by their place in it, so equal rows spread like
    others. Each is packed; no rows give no rows. Lengths must be between 1 and the capacity. A shard has `shard` rows on
    average in every round, whatever is exchanged.
    """
    of = lambda key, rows: F.pmod(key, F.lit(max(1, -(-rows // shard))))
    rows, round_no = pieces.count(), 0
    placed = pieces.withColumn("place", F.monotonically_increasing_id())
    by_length = placed.repartitionByRange("length", "place").sortWithinPartitions("length", "place").drop("place")
    # numbers of a task's rows in a row, from a place of its own on
    pool = by_length.withColumn("shard", of(F.monotonically_increasing_id() + F.xxhash64(F.spark_partition_id()) % 1_000_003, rows))
    settled, taken_in = None, 0
    while True:
        packed = saved(pool.groupBy("shard").applyInArrow(_shard_packer(round_no, capacity), PACKED + ", open boolean"))
        sequences, open_rows, open_ = packed.agg(
            F.count_if(F.col("offset") == 0), F.count_if("open"), F.count_if(F.col("open") & (F.col("offset") == 0))
        ).first()
        freed = taken_in - sequences
        last = not open_rows or rows <= shard or round_no and freed < max(1, MIN_FREED * taken_in)
        done = (packed if last else packed.where("not open")).drop("open")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            return settled
        rows, taken_in, round_no = open_rows, open_, round_no + 1
        pool = packed.where("open").withColumn("shard", of(F.xxhash64("sequence_id", F.lit(round_no)), rows))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of each row of `docs` (doc_id, text) and its place; null ids and repeated rows are kept."""
    pieces = saved(tokenized_pieces(docs, vocabulary, capacity))
    packed = pack(pieces, capacity)
    dropped(pieces)
    return packed
