"""Brown class-based bigrams: P(w | before) = P(class of w | class before) * P(w | class of w).

Clustered words are all that training has LEAST times or more, whatever the size of the corpus; all other
words, known or not, form the class of rare words, and the end token has a class of its own. The number
of classes grows with the square root of the clustered words. Exchange clustering (Kneser and Ney 1993, in parallel
sweeps after Uszkoreit and Brants 2008):

1. Spark counts the bigrams of all training texts and keeps them in blocks, each with all right
   and left neighbours of some words; those of frequent words (and of the end and the rare words) are
   counted in slices by neighbour;
2. the SEEDS most frequent words are exchanged one by one on the driver, by their bigrams with each
   other, until none moves; all others are placed in the class that gives the highest likelihood;
3. sweeps: with the table of class bigrams fixed, each block finds for each of its words the class to
   which moving it alone would raise the likelihood of the training texts most, exactly. All moves
   (from the sweep ALL_MOVE on, those of every other word by a hash, in turns) are made at once and the
   table is counted anew. Should the likelihood fall, half of them are made, then a quarter, and
   so on, so it never falls from sweep to sweep. It ends when none moves, or when two sweeps together
   bring less than TOLERANCE nats a token.

Class transitions are smoothed by adding ALPHA. A clustered word's emission is its share of its
class; so is a rare word's in the class of rare words, where one more event stands for all words that
training doesn't have: it counts as often as there are words seen once (Good and Turing).
Texts start from, and end in, the end token's class. Word counts cover all training texts and
grow with them, so they are a table. Of the clustered words only numbers are broadcast: a 64-bit hash, which names
them, a count and a class, some 30 bytes a word, which grow with the vocabulary. The others' counts are joined by
hash: a document sends one row for each distinct other word.

Null text is empty: its only token is the end. Without training texts every probability comes
from smoothing alone. Rows repeated under one doc_id are scored one by one; an empty table gives
no rows; very long texts are scored whole; of equal classes or words the first is taken; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, raw, written

LEAST = 3
SEEDS = 700
#: Classes for each square root of clustered words.
CLASSES = 0.25
TOLERANCE = 1e-2
ALL_MOVE = 2
ALPHA = 0.1
#: Tokens that are taken at a time, and distinct words that a task counts at a time.
CHUNK = 250_000
MOST_WORDS = 300_000
#: Bigrams that a task gathers before it counts them, and tokens for each block of bigrams, about.
GATHER = 1_000_000
BLOCK = 1_000_000
#: Entries weighed at a time: of neighbours x classes, or of counts x classes x classes; words x classes are a quarter.
ENTRIES = 2_000_000
#: Seed of Spark's xxhash64.
SPARK_SEED = 42


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update(text.lower().split())
            if len(counts) > MOST_WORDS:
                yield flush()
    yield flush()


class Head:
    """Clustered words, by their hashes in order of frequency."""

    def __init__(self, hashes: np.ndarray):
        self.size, self.places = len(hashes), np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.places]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by frequency; -1 for others."""
        if not self.size:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.places[at], -1)


class Index(dict):
    """Places of words as they come, their hashes and numbers: clustered words by frequency, then others by place."""

    def __init__(self, head: Head):
        super().__init__()
        self.head = head
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new, self.hashes, self.found = [], np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place

    def numbers(self, words: list[int]) -> np.ndarray:
        """Numbers of words by their places."""
        if self.new:
            hashes = np.array([xxhash.xxh64_intdigest(w, seed=SPARK_SEED) for w in self.new], np.uint64).view(np.int64)
            found = self.head.numbers(hashes)
            places = np.arange(len(self.hashes), len(self))
            self.hashes, self.found = np.append(self.hashes, hashes), np.append(self.found, np.where(found < 0, self.head.size + places, found))
            self.new = []
        return self.found[np.array(words, np.int64)]


def chunks(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, held_out flags, numbers of words, words per text) for some texts at a time."""
    for batch in batches:
        ids, texts, flags = batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("held_out").to_pylist()
        lo, words, lengths = 0, [], []
        for k in range(len(ids)):
            new = texts[k].as_py().lower().split()
            words += map(index.__getitem__, new)
            lengths.append(len(new))
            if len(words) >= CHUNK or k == len(ids) - 1:
                yield ids[lo : k + 1], flags[lo : k + 1], index.numbers(words), np.array(lengths)
                lo, words, lengths = k + 1, [], []
                if len(index) > MOST_WORDS:
                    index.reset()


def unit_runs(n_head: int, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each token (words, then the end) and of the token before it: clustered words, the end, rare words."""
    units = np.insert(np.where(numbers < n_head, numbers, n_head + 1), np.cumsum(lengths), n_head)
    return units, np.append(n_head, units[:-1])


def planes(x: np.ndarray) -> bytes:
    """An array, packed: its size in bytes, then its bytes, all first ones first, by zstd (small numbers leave long runs of zeros)."""
    data = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.empty(0, dtype)
    out = pa.decompress(data[8:], size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(out, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


#: Bigrams of the units of a block, or a slice of it, as sorted codes (unit * units + neighbour) and their counts.
BIGRAMS = "block int, slice int, codes binary, counts binary"


class Blocks:
    """Blocks of bigrams by unit, from how often each unit comes.

    Units that come more than BLOCK / 4 times have a block each, which is counted in slices by neighbour, of about
    BLOCK tokens; all others share blocks of about BLOCK tokens. So what all tasks counted for a slice comes to about
    BLOCK codes, however frequent a unit is, and a block, once counted, to that or to one for each unit.
    """

    def __init__(self, counts: np.ndarray):
        self.units, self.shared = len(counts), max(1, int(counts.sum()) // BLOCK)
        self.large = np.flatnonzero(counts > BLOCK // 4)
        self.slices = -(-counts[self.large] // BLOCK)

    def packed(self, codes: np.ndarray, counts: np.ndarray, sliced: bool) -> Iterator[pa.RecordBatch]:
        """Rows of BIGRAMS, from sorted codes."""
        unit = codes // self.units
        block, part = unit % self.shared, np.zeros(len(codes), np.int64)
        at = np.searchsorted(self.large, unit)
        own = np.flatnonzero(np.append(self.large, -1)[at] == unit)
        block[own] = self.shared + at[own]
        if sliced:
            part[own] = codes[own] % self.units % self.slices[at[own]]
        order = np.lexsort((part, block))
        block, part, codes, counts = block[order], part[order], codes[order], counts[order]
        edges = np.append(np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]))[: len(codes)]), len(codes))
        parts = [slice(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        columns = [pa.array(block[edges[:-1]], pa.int32()), pa.array(part[edges[:-1]], pa.int32()), pa.array([planes(np.diff(codes[p], prepend=0)) for p in parts], pa.binary()), pa.array([planes(counts[p]) for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "slice", "codes", "counts"])


def unpacked(codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unplanes(codes, np.int64)), unplanes(counts, np.int64)


def sides(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list]:
    """The values of some columns, a row at a time."""
    for batch in batches:
        for k in range(len(batch)):
            yield [batch.column(name)[k].as_py() or b"" for name in names]


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def count_pairs(head: Head, blocks: Blocks):
    """Bigrams of a task's texts by slice of the first unit's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, size = Index(head), [], 0
        for _, _, numbers, lengths in chunks(batches, index):
            now, before = unit_runs(head.size, numbers, lengths)
            held.append(before * blocks.units + now)
            size += len(now)
            if size >= GATHER:
                yield from blocks.packed(*np.unique(np.concatenate(held), return_counts=True), sliced=True)
                held, size = [], 0
        if held:
            yield from blocks.packed(*np.unique(np.concatenate(held), return_counts=True), sliced=True)

    return run


def turned(blocks: Blocks):
    """The same bigrams by block of the second unit; each comes once, so nothing is left to sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, counts in sides(batches, "codes", "counts"):
            c, n = unpacked(codes, counts)
            c = c % blocks.units * blocks.units + c // blocks.units
            order = np.argsort(c)
            yield from blocks.packed(c[order], n[order], sliced=False)

    return run


def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a slice (key: block, slice) or of a block (key: block)."""
    parts = [unpacked(c, n) for c, n in zip(rows.codes, rows.counts, strict=True)]
    codes, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return pd.DataFrame({"block": [key[0]], "slice": [0 if len(key) == 1 else key[1]], "codes": [planes(np.diff(codes, prepend=0))], "counts": [planes(counts)]})


def bigrams(train: DataFrame, head: Head, counts: np.ndarray) -> DataFrame:
    """A row per block with the right and the left neighbours of its units; ``counts`` is how often each unit comes."""
    blocks = Blocks(counts)
    slices = written(train.mapInArrow(count_pairs(head, blocks), BIGRAMS).groupBy("block", "slice").applyInPandas(merge, BIGRAMS), "bigrams")
    large = F.col("block") >= blocks.shared
    right = slices.where(~large).unionAll(slices.where(large).groupBy("block").applyInPandas(merge, BIGRAMS)).drop("slice")
    left = slices.mapInArrow(turned(blocks), BIGRAMS).groupBy("block").applyInPandas(merge, BIGRAMS).select("block", F.col("codes").alias("left_codes"), F.col("counts").alias("left_counts"))
    return written(right.join(left, "block", "full"), "neighbours")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """What classes have to do with the log-likelihood of the training tokens."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=1)).sum() - xlogx(table.sum(axis=0)).sum())


def contexts(codes: np.ndarray, counts: np.ndarray, units: int, words: np.ndarray, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word (sorted) how often a word of each class stands beside it; and its bigrams with itself. Class -1 isn't counted."""
    word, other = codes // units, codes % units
    at = np.searchsorted(words, word)
    ok = (at < len(words)) & (of[other] >= 0)
    ok[ok] = words[at[ok]] == word[ok]
    own = ok & (word == other)
    alone = np.bincount(at[own], counts[own], len(words))
    ok &= ~own
    return np.bincount(at[ok] * classes + of[other[ok]], counts[ok], len(words) * classes).reshape(len(words), classes), alone


def raised(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What small counts (1 and on, by row) add to x log x of each column, and of each row, of the table."""
    most = ENTRIES // table.size
    return tuple(np.concatenate([np.empty((0, len(table))), *(xlogx(t + n) - xlogx(t) for n in range(1, most + 1))]) for t in (table.T, table))


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, alone: np.ndarray, old: np.ndarray, small: tuple[np.ndarray, ...] | None = None, f: np.ndarray | None = None) -> np.ndarray:
    """What moving each word from its class (-1: it has none) to each other adds to the likelihood, for each word by itself.

    ``right`` and ``left`` count the classes of its neighbours, without itself; ``small`` is what :func:`raised` gives, ``f`` x log x of the table.
    """
    f, k, together = xlogx(table) if f is None else f, len(table), max(1, ENTRIES // len(table))
    out = np.zeros(right.shape)
    for side, t, ft, made in ((right, table.T, f.T, small and small[0]), (left, table, f, small and small[1])):
        # words' own counts fill some of a class's row: only those entries change
        word, other = np.nonzero(side)
        count = side[word, other]
        few = count <= (0 if made is None else len(made) // k)
        for of_few in (True, False):
            some = np.flatnonzero(few == of_few)
            for lo in range(0, len(some), together):
                w, o, n = (x[some[lo : lo + together]] for x in (word, other, count))
                change = made[(n.astype(np.int64) - 1) * k + o] if of_few else xlogx(t[o] + n[:, None]) - ft[o]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                out[w[first]] += np.add.reduceat(change, first, axis=0)
    rows, cols, n_right, n_left = table.sum(axis=1), table.sum(axis=0), right.sum(axis=1) + alone, left.sum(axis=1) + alone
    at, f_at = np.diag(table), np.diag(f)
    # bigrams within the new class: without its own, a word needs neighbours of the class on both sides
    w, c = np.nonzero(((right > 0) & (left > 0)) | (alone > 0)[:, None])
    r, l, s = right[w, c], left[w, c], alone[w]
    out[w, c] += xlogx(at[c] + r + l + s) - xlogx(at[c] + r) - xlogx(at[c] + l) + f_at[c]
    for total, n in ((rows, n_right), (cols, n_left)):
        values, place = np.unique(n, return_inverse=True)
        for lo in range(0, len(values), together):
            inside = np.flatnonzero((place >= lo) & (place < lo + together))
            out[inside] -= (xlogx(total + values[lo : lo + together, None]) - xlogx(total))[place[inside] - lo]
    placed = old >= 0
    if not placed.any():
        return out
    one = np.arange(int(placed.sum()))
    o, r, l, s = old[placed], right[placed], left[placed], alone[placed]
    r_o, l_o = r[one, o], l[one, o]
    both = table[o, o]
    leave = xlogx(np.maximum(both - r_o - l_o - s, 0)) - xlogx(np.maximum(both - r_o, 0)) - xlogx(np.maximum(both - l_o, 0)) + f[o, o]
    leave -= xlogx(np.maximum(rows[o] - n_right[placed], 0)) - xlogx(rows[o]) + xlogx(np.maximum(cols[o] - n_left[placed], 0)) - xlogx(cols[o])
    # entries between the old class and the new one lose and win at once
    cross = np.zeros(r.shape)
    for side, t, ft, won in ((r, table, f, l_o), (l, table.T, f.T, r_o)):
        w, c = np.nonzero(side)
        n, x, fx = side[w, c], t[o[w], c], ft[o[w], c]
        less = xlogx(np.maximum(x - n, 0)) - fx
        leave += np.bincount(w, less, len(o))
        cross[w, c] += xlogx(np.maximum(x + won[w] - n, 0)) - xlogx(x + won[w]) - less
    at = np.flatnonzero(placed)
    out[at] += leave[:, None] + cross
    out[at, o] = 0.0
    return out


def exchange(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Class per unit, moving one at a time until none moves; the last two units keep the last two classes to themselves."""
    units, free = len(pairs), classes - 2
    of = np.append(np.argsort(np.argsort(-pairs[:-2].sum(axis=1), kind="stable"), kind="stable") % free, [free, free + 1])
    member = np.eye(classes)[of]
    table = member.T @ pairs @ member
    f, moved = xlogx(table), True
    while moved:
        moved = False
        for u in range(units - 2):
            right, left, own = pairs[u] @ member, member.T @ pairs[:, u], pairs[u, u]
            right[of[u]] -= own
            left[of[u]] -= own
            gain = gains(table, right[None], left[None], np.array([own]), of[u : u + 1], f=f)[0][:free]
            new, old = int(np.argmax(gain)), of[u]
            if gain[new] <= 1e-6:
                continue
            for c, sign in ((old, -1), (new, 1)):
                table[c] += sign * right
                table[:, c] += sign * left
                table[c, c] += sign * own
            for c in (old, new):
                f[c], f[:, c] = xlogx(table[c]), xlogx(table[:, c])
            member[u] = np.eye(classes)[new]
            of[u], moved = new, True
    return of


def count_classes(of: np.ndarray, classes: int):
    """Class bigrams of a task's blocks, as a row of counts per class."""
    units = len(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for codes, counts in sides(batches, "codes", "counts"):
            c, n = unpacked(codes, counts)
            a, b = of[c // units].astype(np.int64), of[c % units]
            ok = (a >= 0) & (b >= 0)
            total += np.bincount(a[ok] * classes + b[ok], n[ok], classes * classes).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int32()), pa.array([r.tobytes() for r in total.reshape(classes, classes)], pa.binary())], names=["class", "counts"])

    return run


def sum_counts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"class": [key[0]], "counts": [sum(np.frombuffer(c, np.int64) for c in rows["counts"]).tobytes()]})


def class_table(blocks: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    table = np.zeros((classes, classes))
    shape = "class int, counts binary"
    for row in blocks.select("codes", "counts").mapInArrow(count_classes(of, classes), shape).groupBy("class").applyInPandas(sum_counts, shape).collect():
        table[row["class"]] = np.frombuffer(row["counts"], np.int64)
    return table


def in_turn(words: np.ndarray, sweep: int, share: int) -> np.ndarray:
    """Which words a sweep may move if it moves one of ``share``, by a hash."""
    return (words.astype(np.int64) * 2654435761 // 64 + sweep) % share == 0


def propose(of: np.ndarray, table: np.ndarray, sweep: int, share: int):
    """Moves of the words in turn that raise the likelihood by themselves: words and their new classes, per block."""
    units, classes = len(of), len(table)
    together = max(1, ENTRIES // 4 // classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = raised(table)
        for codes, counts, left_codes, left_counts in sides(batches, "codes", "counts", "left_codes", "left_counts"):
            found, new = [np.empty(0, np.int32)], [np.empty(0, np.int16)]
            both = [unpacked(codes, counts), unpacked(left_codes, left_counts)]
            words = np.unique(np.concatenate([c // units for c, _ in both]))
            words = words[(words < units - 2) & in_turn(words, sweep, share)]
            first = [np.searchsorted(c, words * units) for c, _ in both]
            last = [np.searchsorted(c, (words + 1) * units) for c, _ in both]
            for lo in range(0, len(words), together):
                some = words[lo : lo + together]
                cut = [slice(a[lo], b[lo + len(some) - 1]) for a, b in zip(first, last, strict=True)]
                (right, alone), (left, _) = (contexts(c[x], n[x], units, some, of, classes) for (c, n), x in zip(both, cut, strict=True))
                gain = gains(table, right, left, alone, of[some], small)[:, : classes - 2]
                best = np.argmax(gain, axis=1)
                better = gain[np.arange(len(some)), best] > 1e-6
                # a word that nothing speaks for is dealt out by its number
                best = np.where(better, best, some % (classes - 2))
                better |= of[some] < 0
                found.append(some[better].astype(np.int32))
                new.append(best[better].astype(np.int16))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(found).tobytes()], pa.binary()), pa.array([np.concatenate(new).tobytes()], pa.binary())], names=["words", "classes"])

    return run


def cluster(blocks: DataFrame, n_head: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class per unit, the table of class bigrams, and the likelihood after each sweep."""
    units, classes = n_head + 2, 2 + max(1, round(CLASSES * n_head**0.5))
    of = np.full(units, -1, np.int16)
    of[n_head:] = classes - 2, classes - 1
    seeds = np.append(np.arange(min(SEEDS, n_head)), [n_head, n_head + 1])
    pairs, number = np.zeros((len(seeds), len(seeds))), np.full(units, -1)
    number[seeds] = np.arange(len(seeds))

    def among_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, counts in sides(batches, "codes", "counts"):
            c, n = unpacked(codes, counts)
            a, b = number[c // units], number[c % units]
            ok = (a >= 0) & (b >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([(a * len(seeds) + b)[ok].astype(np.int32).tobytes()], pa.binary()), pa.array([n[ok].tobytes()], pa.binary())], names=["places", "counts"])

    for row in blocks.select("codes", "counts").mapInArrow(among_seeds, "places binary, counts binary").collect():
        pairs.ravel()[np.frombuffer(row.places, np.int32)] = np.frombuffer(row["counts"], np.int64)
    of[seeds] = exchange(pairs, classes)

    def moved(of: np.ndarray, table: np.ndarray, sweep: int = 0, share: int = 1) -> tuple[np.ndarray, np.ndarray]:
        rows = blocks.mapInArrow(propose(of, table, sweep, share), "words binary, classes binary").collect()
        return tuple(np.concatenate([np.empty(0, kind), *(np.frombuffer(r[name], kind) for r in rows)]) for name, kind in (("words", np.int32), ("classes", np.int16)))

    words, new = moved(of, class_table(blocks, of, classes))
    of[words] = new
    table = class_table(blocks, of, classes)
    found, sweep = [likelihood(table)], 0
    while True:
        least = share = 1 if sweep < ALL_MOVE else 2
        words, new = moved(of, table, sweep, share)
        while len(words) * least >= share:
            some = in_turn(words, sweep, share)
            tried = of.copy()
            tried[words[some]] = new[some]
            tried_table = class_table(blocks, tried, classes)
            if likelihood(tried_table) > found[-1]:
                break
            share *= 2
        else:
            return of, table, found
        of, table, sweep = tried, tried_table, sweep + 1
        found.append(likelihood(table))
        if sweep > ALL_MOVE and found[-1] - found[-3] < TOLERANCE * table.sum():
            return of, table, found


SCORED = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, word long, n long"


def score_texts(head: Head, head_counts: np.ndarray, of: np.ndarray, step: np.ndarray, emit: np.ndarray, ends: int, unknown: float):
    """A row per text with what the clustered words and the end give, and a row (key, word, n) for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, key = Index(head), TaskContext.get().partitionId() << 33
        log_count = np.log10(head_counts + 1.0)
        for ids, flags, numbers, lengths in chunks(batches, index):
            k, is_head = len(ids), numbers < head.size
            text = np.repeat(np.arange(k), lengths)
            add = lambda values, where: np.bincount(where, values, k)
            units, before = unit_runs(head.size, numbers, lengths)
            every = np.repeat(np.arange(k), lengths + 1)
            model = add(step[of[before], of[units]] + emit[units], every)
            known = add(np.ones(int(is_head.sum())), text[is_head]) + (ends > 0)
            base = add(log_count[numbers[is_head]], text[is_head]) + np.log10(ends + 1.0) - (lengths + 1) * unknown
            codes, n = np.unique((text[~is_head] << 40) | (numbers[~is_head] - head.size), return_counts=True)
            keys = key + np.arange(k)
            key += k
            yield rows(keys, ids, flags, lengths + 1, known.astype(np.int64), base, model)
            yield rows(keys[codes >> 40], word=index.hashes[codes & ((1 << 40) - 1)], n=n)

    def rows(key, doc_id=None, held_out=None, n_tokens=None, known=None, base=None, model=None, word=None, n=None) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), t) if v is None else pa.array(v, t) for v, t in zip((key, doc_id, held_out, n_tokens, known, base, model, word, n), kinds, strict=True)], names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def class_lm(docs: DataFrame, held_out) -> DataFrame:
    """Scores of every text under the model learnt from the rows where ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score and
    perplexity (of the class bigrams, per token).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("text"), held_out.alias("held_out"))
    train = texts.where(~F.col("held_out"))
    counts = written(train.select("text").mapInArrow(count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    words, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first() + (train.count(),)
    tokens, types = words + ends, distinct + (ends > 0)
    top = counts.where(F.col("c") >= LEAST).orderBy(F.desc("c"), "word").select(F.xxhash64("word").alias("hash"), "c").toArrow()
    head, head_counts = Head(top["hash"].to_numpy()), top["c"].to_numpy()
    rare = words - int(head_counts.sum())
    once = max(1, counts.where("c = 1").count())

    of, table, _ = cluster(bigrams(train, head, np.append(head_counts, [ends, rare])), head.size)
    table = table + ALPHA
    step = np.log10(table / table.sum(axis=1, keepdims=True))
    sizes = np.bincount(of[: head.size], head_counts, len(table))
    # rare words: the logarithm of their count comes later
    emit = np.concatenate([np.log10(head_counts / sizes[of[: head.size]]), [0.0, -np.log10(rare + once)]])
    unknown = np.log10(tokens + types + 1)

    scored = written(texts.mapInArrow(score_texts(head, head_counts, of, step, emit, ends, unknown), SCORED), "scored")
    rest = counts.select(F.xxhash64("word").alias("word"), "c")
    other = scored.where("word is not null").select("key", "word", "n").join(rest, "word").groupBy("key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.col("n") * F.log10("c")).alias("rare"), F.sum("n").alias("n_more"))
    n_more = F.coalesce("n_more", F.lit(0))
    unseen = F.col("n_tokens") - F.col("known") - n_more - F.lit(int(not ends))
    score = F.col("model") + F.coalesce("rare", F.lit(0.0)) + unseen * F.lit(float(np.log10(once)))
    return (
        scored.where("word is null")
        .join(other, "key", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + n_more).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            score.alias("score"),
            F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
        )
    )


def op8_brown_lm(spark, sf_dir: str) -> DataFrame:
    return class_lm(documents(spark, sf_dir), fold("doc_id", 7) == 2)
