"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

The index holds the test items, the queries are all passages (overlapping windows of words) of
all training texts. Terms are words, A-Z lower-cased, without marks at their ends. A term's
impact in an item is its BM25 weight; a passage's score for an item is the sum over its distinct
terms; an item is retrieved when a passage reaches SHARE of the score the item gives to itself.
As in block-max WAND (Ding and Suel 2011) upper bounds spare the work. A passage's terms are put in the order
of their largest impacts, and the pivot is where the sum of those below it first reaches PIVOT of the least threshold: an
item that is retrieved has a term from the pivot on, so postings of the terms below, the frequent ones, are never
gone through. Terms from the pivot on name the blocks of items; a block stays if what they give at most within it, and the
others anywhere, reaches its least threshold, and then if all terms within it do. Only blocks that stay are
scored item by item, and of each term only the postings in them are looked up. Nothing above its threshold is lost. All
passages of some texts are worked on at once in numpy, their blocks LOOKED at a time.

A retrieved pair is verified on the whole text: the share of the item's five-word shingles in it,
for the question and for the answer. Where items have no separate answer, the last quarter of
their words counts as the answer.

The index is broadcast in parts of at most PART items and PART_WORDS words, one pass over the
texts for each, so an executor holds a bounded size whatever the number of items; the driver holds all parts. Null or empty texts and
items match nothing; items under five words are matched as one shingle. Texts are read whole, however long, CHUNK words at a
time. Rows repeated under one id are matched one by one, equal scores keep every pair, an empty table gives no rows, and columns
other than doc_id and text (item_id, text and perhaps the answer) are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, raw

K1, B = 1.2, 0.75
PASSAGE, STRIDE = 128, 64
ITEM_WORDS = 64
ITEMS_A_BLOCK = 4
SHARE = 0.5
WORDS = 5
QUESTION_OVERLAP = 0.5
ANSWER_OVERLAP = 0.5
#: Terms below the pivot bring less than this share of the least threshold; with less, blocks are held against tighter bounds.
PIVOT = 0.5
PART, PART_WORDS = 20_000, 4_000_000
#: Words that are looked at together, and terms of blocks, about.
CHUNK = 200_000
LOOKED = 2_000_000
#: Bounds that are held at a time.
BOUNDS = 2_000_000
MARKS = b".,;:!?\"'()[]{}"


def terms(text: bytes) -> list[bytes]:
    return [t for w in text.lower().split() if (t := w.strip(MARKS))]


class Terms(dict):
    """Number of a raw word's term, -1 if it's in no item, -2 for marks alone."""

    def __init__(self, number: dict[bytes, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        term = word.strip(MARKS)
        found = self[word] = self.number.get(term, -1) if term else -2
        return found


class Index:
    """Postings by term with impacts, their maxima by block of items, thresholds and shingles."""

    def __init__(self, rows: list[tuple[int, bytes, bytes | None]]):
        self.item_ids, pieces, self.shingles = [], [], []
        self.number: dict[bytes, int] = {}
        for item_id, text, answer in rows:
            words = terms(text)
            end = terms(answer or b"")
            if not words and not end:
                continue
            if not end:
                words, end = words[: len(words) - len(words) // 4], words[len(words) - len(words) // 4 :]
            numbers = [[self.number.setdefault(t, len(self.number)) for t in part] for part in (words, end)]
            whole = numbers[0] + numbers[1]
            split = len(numbers[0])
            spans = range(max(1, len(whole) - WORDS + 1))
            grams = [tuple(whole[k : k + WORDS]) for k in spans]
            # a shingle that reaches into the answer is the answer's
            question = [g for k, g in zip(spans, grams, strict=True) if k + WORDS <= split]
            ending = [g for k, g in zip(spans, grams, strict=True) if k + WORDS > split]
            self.shingles.append((question or ending, ending or question))
            for lo in range(0, len(whole), ITEM_WORDS):
                pieces.append((len(self.item_ids), whole[lo : lo + ITEM_WORDS]))
            self.item_ids.append(item_id)
        self.n_terms = max(1, len(self.number))
        self.build(pieces)

    def build(self, pieces: list[tuple[int, list[int]]]) -> None:
        """A piece is an item or, of long items, a run of its words that fits a passage."""
        n = len(pieces)
        mean = sum(len(p) for _, p in pieces) / max(1, n)
        self.owner = np.array([k for k, _ in pieces], np.int64)
        df = np.zeros(self.n_terms)
        postings = []
        for at, (_, words) in enumerate(pieces):
            t, tf = np.unique(words, return_counts=True)
            df[t] += 1
            postings.append((t, np.full(len(t), at), tf / (tf + K1 * (1 - B + B * len(words) / mean))))
        t, piece, part = (np.concatenate(x) if postings else np.empty(0, np.int64) for x in (list(zip(*postings, strict=True)) or ([], [], [])))
        impact = part * (K1 + 1) * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) if n else np.empty(0)
        self.threshold = np.bincount(piece, impact, n) * SHARE if n else np.empty(0)
        order = np.argsort(t, kind="stable")
        self.terms, self.pieces, self.impacts = t[order], piece[order], impact[order]
        self.first = np.searchsorted(self.terms, np.arange(self.n_terms + 1))
        # per term and block the largest impact
        blocks = self.pieces // ITEMS_A_BLOCK
        code = self.terms * (n // ITEMS_A_BLOCK + 1) + blocks
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        self.block_of, block_terms = blocks[starts], self.terms[starts]
        self.block_max = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.empty(0)
        self.block_first = np.searchsorted(block_terms, np.arange(self.n_terms + 1))
        self.n_blocks = n // ITEMS_A_BLOCK + 1
        # where a term's postings in a block are
        self.block_code = block_terms * self.n_blocks + self.block_of
        self.block_start, self.block_end = starts, np.append(starts[1:], len(code))[: len(starts)]
        self.block_threshold = np.full(self.n_blocks, np.inf)
        np.minimum.at(self.block_threshold, np.arange(n) // ITEMS_A_BLOCK, self.threshold)
        self.term_max = np.zeros(self.n_terms)
        np.maximum.at(self.term_max, self.terms, self.impacts)
        self.by_rank = np.argsort(self.term_max, kind="stable")
        self.rank = np.argsort(self.by_rank)


def spread(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its postings' places: (which key, place)."""
    n = first[keys + 1] - first[keys]
    which = np.repeat(np.arange(len(keys)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[keys], n)


def retrieve(index: Index, numbers: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, best score) above threshold, from term numbers with their text and place in it."""
    known = numbers >= 0
    numbers, text, place = numbers[known], text[known], place[known]
    window = place // STRIDE
    span = int(window.max(initial=0)) + 2
    one = text * span + window
    # a word is in the passage that starts at its stride and in the PASSAGE // STRIDE - 1 before
    passages = np.concatenate([one[window >= k] - k for k in range(PASSAGE // STRIDE)])
    held = np.concatenate([numbers[window >= k] for k in range(PASSAGE // STRIDE)])
    # distinct terms of each passage in the order of their largest impacts
    codes = np.unique(passages * index.n_terms + index.rank[held])
    passages, held = codes // index.n_terms, index.by_rank[codes % index.n_terms]
    names, passages = np.unique(passages, return_inverse=True)
    least = index.block_threshold.min(initial=np.inf) - 1e-9
    ok = (np.bincount(passages, index.term_max[held], len(names)) >= least)[passages]
    passages, held = passages[ok], held[ok]
    if not len(held):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    # the pivot: largest impacts summed up within each passage
    first = np.flatnonzero(np.append(True, passages[1:] != passages[:-1]))
    size = np.diff(np.append(first, len(passages)))
    summed = np.cumsum(index.term_max[held])
    below = summed - np.repeat(summed[first] - index.term_max[held[first]], size)
    upper = below >= PIVOT * least
    rest = np.zeros(len(names))
    np.maximum.at(rest, passages[~upper], below[~upper])
    # bounds of passages by blocks, BOUNDS at a time
    able, named = passages[upper], held[upper]
    step, kept = max(1, BOUNDS // index.n_blocks), []
    for lo in range(0, len(names), step):
        some = slice(*np.searchsorted(able, [lo, lo + step]))
        which, at = spread(index.block_first, named[some])
        rows = min(step, len(names) - lo)
        bound = np.bincount((able[some][which] - lo) * index.n_blocks + index.block_of[at], index.block_max[at], rows * index.n_blocks).reshape(rows, -1)
        kept.append(np.flatnonzero((bound > 0) & (bound + rest[lo : lo + rows, None] >= index.block_threshold - 1e-9)) + lo * index.n_blocks)
    pairs = np.concatenate(kept)
    begins, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    begins[passages[first]], count[passages[first]] = first, size
    # every term of a passage in each of its blocks
    work = np.cumsum(count[pairs // index.n_blocks]) // LOOKED
    found = [scored(index, pairs[work == k], held, begins, count) for k in range(int(work[-1]) + 1)] if len(pairs) else []
    passage, piece, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return names[passage] // span, piece, scores


def scored(index: Index, pairs: np.ndarray, held: np.ndarray, begins: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, piece, score) above threshold in blocks of passages; of each passage ``held`` has ``count`` terms from ``begins`` on."""
    passage, block = pairs // index.n_blocks, pairs % index.n_blocks
    n = count[passage]
    which = np.repeat(np.arange(len(pairs)), n)
    term = held[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[passage], n)]
    code = term * index.n_blocks + block[which]
    at = np.minimum(np.searchsorted(index.block_code, code), len(index.block_code) - 1)
    there = index.block_code[at] == code
    which, at = which[there], at[there]
    stays = np.bincount(which, index.block_max[at], len(pairs)) >= index.block_threshold[block] - 1e-9
    which, at = which[stays[which]], at[stays[which]]
    n = index.block_end[at] - index.block_start[at]
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.block_start[at], n)
    codes = passage[np.repeat(which, n)] * len(index.threshold) + index.pieces[place]
    pairs, inverse = np.unique(codes, return_inverse=True)
    scores = np.bincount(inverse, index.impacts[place], len(pairs))
    passage, piece = pairs // len(index.threshold), pairs % len(index.threshold)
    ok = scores >= index.threshold[piece] - 1e-9
    return passage[ok], piece[ok], scores[ok]


def overlaps(index: Index, item: int, numbers: list[int]) -> tuple[float, float]:
    """Share of the question's and of the answer's shingles in a text."""
    question, answer = index.shingles[item]
    width = len(question[0])
    wanted = {g[0] for g in question} | {g[0] for g in answer}
    there = {tuple(numbers[k : k + width]) for k, n in enumerate(numbers) if n in wanted}
    return tuple(sum(g in there for g in part) / len(part) for part in (question, answer))


def match(rows: list[tuple[int, bytes, bytes | None]]):
    """Verified (row number in the batch, item number, score, overlaps) of the texts in a batch."""
    held: list[Index] = []

    def find(texts: list[bytes]) -> Iterator[tuple[int, int, float, float, float]]:
        index = held[0] if held else held.append(Index(rows)) or held[0]
        look = Terms(index.number)
        lo, words, lengths = 0, [], []
        for k, data in enumerate(texts):
            new = [n for n in map(look.__getitem__, data.lower().split()) if n != -2]
            words += new
            lengths.append(len(new))
            if len(words) < CHUNK and k < len(texts) - 1:
                continue
            if len(index.item_ids) and words:
                numbers, n = np.array(words, np.int64), np.array(lengths)
                starts = np.cumsum(n) - n
                which = np.repeat(np.arange(len(n)), n)
                best: dict[tuple[int, int], float] = {}
                for t, piece, score in zip(*(x.tolist() for x in retrieve(index, numbers, which, np.arange(len(numbers)) - starts[which])), strict=True):
                    pair = (t, int(index.owner[piece]))
                    best[pair] = max(best.get(pair, 0.0), score)
                for (t, item), score in sorted(best.items()):
                    q, a = overlaps(index, item, words[starts[t] : starts[t] + n[t]])
                    if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP:
                        yield lo + t, index.item_ids[item], score, q, a
            lo, words, lengths = k + 1, [], []

    return find


def parts(benchmark: DataFrame, answer: str | None) -> list[list[tuple[int, bytes, bytes | None]]]:
    """The items, in parts of bounded size: only one part is held at a time by an executor."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), raw().alias("text"), (raw(answer) if answer else F.lit(None).cast("binary")).alias("answer")).orderBy("item_id", "text")
    out, size = [[]], 0
    for row in items.toLocalIterator():
        n = len(row.text) // 4 + len(row.answer or b"") // 4
        if out[-1] and (len(out[-1]) >= PART or size + n > PART_WORDS):
            out.append([])
            size = 0
        out[-1].append((row.item_id, bytes(row.text), bytes(row.answer) if row.answer else None))
        size += n
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for every verified pair."""

    def stage(rows):
        find = match(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = list(find(batch.column("text").to_pylist()))
                cols = [pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    return reduce(DataFrame.union, (texts.mapInArrow(stage(rows), schema) for rows in parts(benchmark, answer)))


def clean(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds no test item; nothing is shuffled."""

    def stage(rows):
        find = match(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                bad = {f[0] for f in find(texts)}
                yield batch.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))

        return run

    return reduce(lambda df, rows: df.mapInArrow(stage(rows), df.schema), parts(benchmark, answer), docs)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
