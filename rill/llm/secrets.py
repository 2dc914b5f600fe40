"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary finds hard to say.

A tokenizer's merges were learned from text, so words and names take few tokens and random strings take many:
a string that has few characters to a token is reported. Strings of letters alone are tried as well, at stricter
ratios, for rare words and compounds take many tokens too; how strict goes by case and length. Known kinds
of digests (hex digits as many as a common hash has, integrity values), UUIDs, ULIDs and numbers are left alone. Of
a string that overlaps a span of the patterns, the parts outside are reported, if they are random themselves.

Positions are code points of the whole text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rill.llm.common import per_worker

KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A candidate's least length, and the most characters to a token of a string that counts as random.
MIN_RANDOM, MAX_RATIO = 16, 1.9
#: The same for strings without digits: of mixed case, of one case, and of one case from `LONG_LETTERS` characters on.
MIXED_RATIO, LETTERS_RATIO, LONG_RATIO, LONG_LETTERS = 1.7, 1.55, 1.7, 24
#: The least length of a random part that a pattern's span leaves of a longer string.
MIN_REST = 6
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
MASK = "[SECRET]"
#: Strings whose verdicts a worker remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 100_000, 256


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}")
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
ULID = re.compile(r"[0-7][0-9A-HJKMNP-TV-Z]{25}\Z")
INTEGRITY = re.compile(r"sha(?:1|256|384|512)[-_=][A-Za-z0-9+/_-]+={0,2}\Z")
HEX_ONLY = re.compile(r"[0-9A-Fa-f]+\Z")
#: Dates, times, versions, card and telephone numbers: digits and signs, with a few letters at most.
NUMBER_LIKE = re.compile(r"[0-9T_Z+/=-]+\Z")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, sorted by start, then kind."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    return sorted(spans)


def is_known_identifier(s: str) -> bool:
    patterns = (UUID, ULID, INTEGRITY, NUMBER_LIKE)
    return any(p.match(s) for p in patterns) or bool(HEX_ONLY.match(s)) and len(s) in DIGEST_LENGTHS


def most_ratio(s: str) -> float:
    """The most characters to a token with which a string counts as random."""
    if any(map(str.isdigit, s)):
        return MAX_RATIO
    if not s[1:].islower() and not s.isupper():
        return MIXED_RATIO
    return LONG_RATIO if len(s) >= LONG_LETTERS else LETTERS_RATIO


class Scanner:
    """Scans with a tiktoken vocabulary file; remembers a bounded number of verdicts."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bool] = {}

    def is_random(self, s: str) -> bool:
        found = self.known.get(s)
        if found is None:
            known = is_known_identifier(s) or not any(map(str.isalpha, s))
            found = not known and len(s) <= most_ratio(s) * len(self.encoding.encode_ordinary(s))
            if len(s) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[s] = found
        return found

    def spans(self, text: str) -> list[Span]:
        base, found, at = base_spans(text), [], 0
        for m in CANDIDATE.finditer(text):
            if self.is_random(m[0]):
                while at < len(base) and base[at][2] <= m.start():
                    at += 1
                rest = outside(*m.span(), islice(base, at, None))
                found += [(a, 3, b) for a, b in rest if b - a == len(m[0]) or b - a >= MIN_REST and self.is_random(text[a:b])]
        return sorted(base + found)


def outside(start: int, end: int, spans: Iterable[Span]) -> list[tuple[int, int]]:
    """The parts of a stretch that no span covers; spans are sorted by start."""
    out = []
    for a, _, b in spans:
        if a >= end:
            break
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """`text` with each stretch that spans cover, or adjoin in, replaced by `MASK`."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a > at or not out:
                out += [text[at:a], MASK]
            at = b
    return "".join([*out, text[at:]])


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts and spans of each row of `docs` (doc_id, text); null texts are empty ones, null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker(("scanner", ranks_path, pattern), lambda: Scanner(ranks_path, pattern))
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = scanner.spans(text or "")
                base = [s for s in spans if s[1] < 3]
                counts = [sum(k == s[1] for s in base) for k in range(3)]
                rows.append((doc_id, *counts, hashlib.sha256(described(base).encode()).hexdigest(), described(spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCANNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)


def mask_secrets(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`docs` with the secrets of `text` masked and `n_chars` counted anew where a text changed; all rows stay."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = per_worker(("scanner", ranks_path, pattern), lambda: Scanner(ranks_path, pattern))
        for a in texts:
            yield pa.array([t if t is None else masked(t, scanner.spans(t)) for t in a.to_pylist()], pa.string())

    mask = F.arrow_udf(run, "string")
    hidden = docs.withColumn("rill_masked", mask(F.col("text").cast("string")))
    length = F.when(F.col("rill_masked").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("rill_masked")).cast("long")
    columns = {"text": F.col("rill_masked"), "n_chars": length}
    return hidden.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))
