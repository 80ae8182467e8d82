"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class.

Base spans (kinds assign, access, hex) are leftmost non-overlapping matches; a match that is too
short is dropped and not retried. The method adds kind ``entropy``: in every run of candidate
characters, a window slides over the string; its character counts are updated by the one that
enters and the one that leaves, and so is sum(c * log2 c), which gives the window's entropy in
constant time. The class of the window's own characters (hex, letters of one case, with digits, of both cases, base64)
sets the threshold, which is a low quantile of the entropy of random windows of that class; the span runs from
the first window above it to the last. What base spans cover is cut out of a run, and the rest is scanned. Keys and
values are judged apart at ``=``, unless neither side fills a window by itself. Allow-listed shapes are suppressed:
identifiers, numbers, and words (see ``wordlike``), alone or in paths. Letters are words when their pairs are as likely as
those of the table's own texts, rather than as those of random letters: pairs are counted over all texts, 27 x 27 numbers.
Suppression never touches base spans.

Positions count code points, ends are exclusive. Null text is empty and has no spans; texts are scanned whole, however long. An
empty table gives no rows, rows repeated under one doc_id are scanned one by one, equal spans are in the order of KINDS, and
columns other than doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, raw

KINDS = ("assign", "access", "hex", "entropy")
BASE = 3
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

WINDOW = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: An = between key and value; those at a value's end are its padding.
BETWEEN = re.compile(r"=+(?=[^=])")
#: Share of random windows, and of runs of random letters, that a threshold gives up.
MISSED = 0.02
#: Fewer letters than these are too few to be told from random ones by their pairs.
LEAST_LETTERS = 12


def low_quantile(symbols: int, missed: float = MISSED) -> float:
    """Bits that all but ``missed`` of random windows of so many symbols have."""
    drawn = np.sort(np.random.default_rng([symbols, WINDOW]).integers(0, symbols, (20_000, WINDOW)), axis=1)
    fresh = np.hstack([np.ones((len(drawn), 1), bool), drawn[:, 1:] != drawn[:, :-1]])
    runs = np.diff(np.append(np.flatnonzero(fresh.ravel()), drawn.size))
    bits = np.zeros(len(drawn))
    np.add.at(bits, np.flatnonzero(fresh.ravel()) // WINDOW, -runs / WINDOW * np.log2(runs / WINDOW))
    return float(np.quantile(bits, missed))


#: Kinds of characters: digits, a-f, g-z, A-F, G-Z, others.
KIND_OF = {c: k for k, own in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-")) for c in own}
#: The most that the sum of a window of a class may be, by the class's number of symbols; digits alone are no secret.
MOST = {n: WINDOW * (math.log2(WINDOW) - low_quantile(n)) + 1e-9 for n in (16, 26, 32, 36, 62, 64)} | {10: -1.0}


def symbols_of(inside: list[int]) -> int:
    """How many symbols the class of a window has, given how many characters of each kind are in it."""
    digits, low_hex, low, up_hex, up, other = inside
    if other:
        return 64
    if (low or low_hex) and (up or up_hex):
        return 62
    if not (low or low_hex or up or up_hex):
        return 10
    if not low and not up:
        return 16
    # upper-case letters with digits are mostly of the 32 of base32
    return 26 if not digits else 36 if low or low_hex else 32


ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # identifiers
    re.compile(r"[0-9+/_=-]+"),  # numbers, dates, rules
)
#: A part of a path or slug that may be a word, or a year or version: one case, capitalised, or words set together in camel case.
PART = re.compile(r"[0-9]{1,4}|[a-z]+|[A-Z]+|[A-Z][a-z]+|[a-z]*(?:[A-Z][a-z]{2,})+")
PARTS = re.compile(r"[+/_=-]+")
#: Letters at random mostly have a longer run without a vowel.
NO_VOWELS = re.compile(r"[bcdfghjklmnpqrstvwxz]{6}", re.IGNORECASE)
ALPHABETS = ("0123456789abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "qwertyuiopasdfghjklzxcvbnm1234567890")
XLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
LETTERS = re.compile(r"[A-Za-z]+")


class Pairs:
    """How many bits a letter costs after the one before, from counts of pairs (0 is no letter, then a to z)."""

    def __init__(self, counts: np.ndarray):
        held = counts.reshape(27, 27) + 1.0
        self.bits = -np.log2(held / held.sum(axis=1, keepdims=True))
        # what random letters cost
        inner = self.bits[1:, 1:]
        self.mean, self.spread = float(inner.mean()), float(inner.std())
        rows = self.bits.tolist()
        self.cost = {chr(96 + i) + chr(96 + j): rows[i][j] for i in range(1, 27) for j in range(1, 27)}

    def wordy(self, run: str) -> bool:
        """Whether the letters of ``run`` cost clearly less than random ones."""
        costs = [self.cost[a + b] for part in LETTERS.findall(run) for low in [part.lower()] for a, b in zip(low, low[1:], strict=False)]
        if not costs:
            return True
        # a lower mean than all but MISSED of as many random letters have; neighbouring pairs share a letter, so their spread is wider
        return sum(costs) / len(costs) < self.mean - 2.05 * 1.2 * self.spread / math.sqrt(len(costs))


def windows_above(run: str, bits: float | None = None) -> tuple[int, int] | None:
    """From the first to the last window of at least ``bits`` bits (None: those of the window's class), or None."""
    counts: Counter[str] = Counter(run[:WINDOW])
    total = sum(XLOG[c] for c in counts.values())
    fixed = None if bits is None else WINDOW * (math.log2(WINDOW) - bits) + 1e-9
    kinds = [KIND_OF.get(c, 5) for c in run]
    inside = [kinds[:WINDOW].count(k) for k in range(6)]
    first = last = None
    for at in range(len(run) - WINDOW + 1):
        if at:
            out, new = run[at - 1], run[at + WINDOW - 1]
            c = counts[out]
            total += XLOG[c - 1] - XLOG[c]
            counts[out] = c - 1
            c = counts[new]
            total += XLOG[c + 1] - XLOG[c]
            counts[new] = c + 1
            inside[kinds[at - 1]] -= 1
            inside[kinds[at + WINDOW - 1]] += 1
        if total <= (MOST[symbols_of(inside)] if fixed is None else fixed):
            first = at if first is None else first
            last = at + WINDOW
    return None if first is None else (first, last)


def wordlike(run: str, pairs: Pairs | None = None) -> bool:
    """Parts that may all be words, years or versions, and letters that go together as in words. Without counts of pairs, or for few
    letters, a long run without a vowel tells random ones."""
    if not all(not p or PART.fullmatch(p) for p in PARTS.split(run)):
        return False
    if pairs is None or sum(map(len, LETTERS.findall(run))) < LEAST_LETTERS:
        return not NO_VOWELS.search(run)
    return pairs.wordy(run)


def allowed(run: str, pairs: Pairs | None = None) -> bool:
    low = run.lower()
    return any(p.fullmatch(run) for p in ALLOW) or wordlike(run, pairs) or any(low[:12] in a for a in ALPHABETS)


def uncovered(start: int, end: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans, sorted, leave of start to end."""
    for s, _, e in base:
        if s < end and e > start:
            if s > start:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


def pieces(run: str) -> Iterator[tuple[int, int]]:
    """Keys and values of a run that fill a window; shorter ones side by side are taken together."""
    cuts = [m.span() for m in BETWEEN.finditer(run)]
    parts = list(zip([0] + [e for _, e in cuts], [s for s, _ in cuts] + [len(run)], strict=True))
    short: tuple[int, int] | None = None
    for lo, hi in parts:
        if hi - lo < WINDOW:
            short = (short[0] if short else lo, hi)
            continue
        if short:
            yield short
            short = None
        yield lo, hi
    if short:
        yield short


def scan(text: str, pairs: Pairs | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(found)
    for m in CANDIDATE.finditer(text):
        for start, end in uncovered(m.start(), m.end(), base):
            for lo, hi in pieces(text[start:end]):
                piece = text[start + lo : start + hi]
                # padding isn't part of a value that fills a window without it
                piece = bare if len(bare := piece.rstrip("=")) >= WINDOW else piece
                if len(piece) >= WINDOW and not allowed(piece, pairs) and (hit := windows_above(piece)):
                    found.append((start + lo + hit[0], 3, start + lo + hit[1]))
    return sorted(found)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_batches(pairs: Pairs | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(text, pairs)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return run


#: a to z and A to Z by their number, other bytes 0.
LETTER = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0 for b in range(256)], np.int64)


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each letter (or none) follows each, in a task's texts."""
    counts = np.zeros(27 * 27, np.int64)
    for batch in batches:
        for cell in batch.column("text"):
            data = np.frombuffer(cell.as_buffer(), np.uint8)
            for lo in range(0, len(data), 1 << 22):
                codes = LETTER[data[max(0, lo - 1) : lo + (1 << 22)]]
                counts += np.bincount(codes[:-1] * 27 + codes[1:], minlength=27 * 27)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(27 * 27, dtype=np.int32)), pa.array(counts)], names=["pair", "n"])


def learn_pairs(docs: DataFrame, least: int = 10_000) -> Pairs | None:
    """Counts of letter pairs over all texts; None where there are so few that they say nothing."""
    rows = docs.select(raw().alias("text")).mapInArrow(count_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(27 * 27, np.int64)
    for r in rows:
        counts[r.pair] = r.n
    return Pairs(counts) if counts.reshape(27, 27)[1:, 1:].sum() >= least else None


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the spans (kind, start, end) of every text, by start, then kind as in KINDS."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(scan_batches(learn_pairs(docs)), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds: tuple[str, ...], flagged: bool = False) -> list:
    """Counts per base kind, the hash of the base spans, and all spans as text. Where spans are ``flagged``, those of
    a base kind that aren't base count among all only."""
    of = lambda *k: F.filter("spans", lambda s: (s["kind"].isin(*k) & s["base"]) if flagged else s["kind"].isin(*k))
    return [*(F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(listed(of(*kinds)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")]


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *digest(found, KINDS[:BASE]))
