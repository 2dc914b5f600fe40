"""SimHash fingerprints, and near-duplicate components by covering locality-sensitive hashing.

A text's lower-cased (A-Z) words give 3-word shingles, repeats included; fewer words give the whole sequence,
none the fingerprint zero. A bit is set if it is set in over half of the shingles' XXH64 values (seed 42).

Covering hashing: bit i of a fingerprint gets a non-zero vector of radius + 1 bits; table v, for each non-zero
v of that length, keeps the bits whose vector has an odd product with v. Two fingerprints that differ in at
most `radius` bits put at most `radius` linear conditions on v, so some v fulfils all: its table ignores every
differing bit, and the pair meets there. No such pair is lost, and nothing is left to chance.

Links are verified without pairs: fingerprints within two bits of each other, and only these, share a midpoint
at most one bit from both. A fingerprint that has company in some table names itself and its one-bit neighbours
in that table's ignored bits; a midpoint has at most 65 fingerprints, whatever the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rill.llm.common import saved
from rill.llm.graph import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a whole text; shingles are hashed in blocks, so memory follows the text alone."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line, width = b" ".join(words), min(SHINGLE, len(words))
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    n, digest, seed = len(words) - width + 1, xxhash.xxh64_intdigest, SEED
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : min(n, at + BLOCK)], ends[at + width - 1 : at + BLOCK + width - 1])  # noqa: B905
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of `docs` (doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.fromiter(map(fingerprint, b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Kept bits of each table."""
    vectors = (1 << (radius + 1)) - 1
    odd = lambda i, v: ((1 + i % vectors) & v).bit_count() % 2
    return [sum(1 << i for i in range(bits) if odd(i, v)) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints (fp) whose components are those of all links within the radius."""
    masks = [_signed(m) for m in covering_masks()]
    entries = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("kept")) for t, m in enumerate(masks)))
    tables = distinct.select("fp", F.inline(entries))
    crowded = saved(tables.groupBy("t", "kept").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "kept"))
    ignored = F.element_at(F.array(*(F.lit(~m) for m in masks)), F.col("t") + 1)
    free = tables.join(crowded, ["t", "kept"], "left_semi").groupBy("fp").agg(F.bit_or(ignored).alias("free"))
    powers = F.array(*(F.lit(_signed(1 << i)) for i in range(BITS)))
    flips = F.transform(F.filter(powers, lambda p: F.col("free").bitwiseAND(p) != 0), lambda p: F.col("fp").bitwiseXOR(p))
    midpoints = free.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("m"))
    met = midpoints.groupBy("m").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    links = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return links.where("a <> b").distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fp, root, first_id, component_id) of each fingerprint of `prints` (doc_id, fp): a fingerprint that stands for
    its component, and the smallest doc_ids that the fingerprint and the component have."""
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    named = connected_components(fingerprint_links(distinct.select("fp")))
    members = distinct.join(named.withColumnRenamed("node", "fp"), "fp", "left")
    linked = members.where("root is not null")
    smallest = saved(linked.groupBy("root").agg(F.min("first_id").alias("component_id")))
    component = F.coalesce("component_id", "first_id").alias("component_id")
    return saved(members.join(smallest, "root", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", component))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of `docs`.

    component_id is the smallest doc_id among the documents that links reach. Null and blank texts have the
    fingerprint zero and are linked like others. Repeated rows come out as often as they come in; a null
    doc_id is kept, and its component is null only if no document of it has an id. Other columns are ignored.
    """
    prints = saved(fingerprints(docs))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(components(prints).select("fp", "component_id"), "fp").select("doc_id", text, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the document with the smallest doc_id.

    Components go by text, and each keeps one row, whatever its ids: an id that texts of several components have
    stays once for each that has no smaller one, and rows without id stay only where no row of theirs has one. Of
    texts with one id in a component that with the smallest fingerprint stays, and one of repeated rows. All
    columns are kept.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(np.fromiter(map(fingerprint, a.to_pylist()), np.uint64, len(a)).view(np.int64))

    printed = saved(docs.withColumn("rill_fp", F.arrow_udf(run, "long")(F.col("text").cast("string"))))
    prints = printed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("rill_fp").alias("fp"))
    key = lambda i, fp: F.struct(F.isnull(i).alias("none"), i.alias("doc_id"), F.col(fp).alias("fp"))  # noqa: E731  (a null is equal within a struct)
    firsts = saved(components(prints).groupBy("root").agg(F.min(key(F.col("first_id"), "fp")).alias("rill_key")).select("rill_key"))
    keyed = printed.withColumn("rill_key", key(F.col("doc_id").cast("long"), "rill_fp"))
    kept = keyed.join(firsts, "rill_key", "left_semi")
    often = prints.groupBy(key(F.col("doc_id"), "fp").alias("rill_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = saved(often.join(firsts, "rill_key", "left_semi").select("rill_key"))
    if not repeated.isEmpty():  # only rows that share id and fingerprint are compared
        one = kept.join(repeated, "rill_key", "left_semi").dropDuplicates(["rill_key"])
        kept = kept.join(repeated, "rill_key", "left_anti").unionByName(one)
    return kept.drop("rill_key", "rill_fp")
