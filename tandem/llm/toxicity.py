"""Toxicity with noisy-channel deobfuscation.

1. A character trigram model is counted over the words of all texts.
2. A word that may be written over (digits or marks between letters, a letter twice or more
   in a row, single letters or marks used for letters with white space between) becomes a lattice: each character may stand for itself,
   for the letters it is used for, or for nothing; a run may stand for one, two or all of its
   letters; between spaced letters a word may end. Viterbi finds the reading with the highest
   product of character model and channel probabilities. Other words are their only reading.
3. On the restored words and their first three to eight letters, weights are learnt from at most
   MAX_LABELS labelled rows: the log odds of being in a toxic text, where their lower confidence
   bound is high.
   A text's evidence is the sum over its distinct words of their largest weight; a logistic
   curve over the evidence, fitted on the same rows, gives the score.

Null and empty texts have no evidence and get the score that goes with it. Labels that are null
are left out, and so are labels of documents that there aren't; where a document has several
labels the largest counts. Without labels of both kinds all texts score the share of toxic labels
(0 if there are none). Rows repeated under one doc_id are scored one by one, an empty table gives
no rows, texts are read whole however long, and of readings that cost the same the first by letters is
taken. Other columns are not read; those of ``reject`` come along under any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, written

MAX_LABELS = 20_000
MOST_WORDS = 150_000
#: Distinct words whose trigrams are counted together.
PART = 20_000
#: Texts that a task reads at a time, and distinct features that it counts at a time.
ROWS = 500
MOST_FEATURES = 100_000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6, 7, 8)
LEAST_TOXIC = 5
#: Least confidence bounds of the log odds, by round.
LEAST_BOUNDS = (4.0, 3.0, 2.0, 1.5)
Z = 2.33
RIDGE = 0.05

#: What a character is used for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}
EDGE = ".,;:?\"'()[]{}<>|/\\&%#*~`^=_-+!"
#: Costs in nats: a character for a letter, a mark for nothing, a character of STANDS_FOR for nothing, a run read
#: shorter, a word's end between spaced letters.
SWAP, DROP, WASTE, SHORTEN, BREAK = 0.7, 1.5, 7.0, 0.7, 1.0
UNSEEN = 14.0
REPEAT = re.compile(r"(.)\1+")
SPACED = re.compile(r"\s([\w{0}](?:\s+[\w{0}]){{2,}})(?!\S)".format("".join(re.escape(c) for c in STANDS_FOR if not c.isalnum())))


class Characters:
    """Trigram costs, in nats, over words between marks (^)."""

    def __init__(self, counts: dict[str, int]):
        below: dict[str, float] = defaultdict(float)
        for gram, n in counts.items():
            below[gram[:2]] += n
        self.cost = {g: -math.log((n + 0.01) / (below[g[:2]] + 1.0)) for g, n in counts.items()}
        self.lengths: dict[str, int] = {}

    def step(self, before: str, char: str) -> float:
        return self.cost.get(before + char, UNSEEN)

    def length_of_run(self, window: str, n: int) -> int:
        """How many of its ``n`` equal letters a run is read as, by the two characters on either side in ``window``."""
        found = self.lengths.get(window)
        if found is None:
            before, char, after = window[:2], window[2], window[2 + n :]
            found = min((self.total(before + char * k + after) + SHORTEN * (k < n), k) for k in {1, 2, n})[1]
            if len(self.lengths) >= MOST_WORDS:
                self.lengths.clear()
            self.lengths[window] = found
        return found

    def total(self, text: str) -> float:
        """Cost of all trigrams inside ``text``."""
        return sum([self.cost.get(text[k : k + 3], UNSEEN) for k in range(len(text) - 2)])


def trigrams(word: str) -> Iterator[str]:
    padded = f"^^{word}^"
    return (padded[k : k + 3] for k in range(len(padded) - 2))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per piece of the token its readings and their costs."""
    out, k = [], 0
    while k < len(token):
        char, n = token[k], 1
        while k + n < len(token) and token[k + n] == char:
            n += 1
        if char.isalpha():
            out.append([(char * m, SHORTEN * (m < n)) for m in sorted({1, min(2, n), n})])
        else:
            reads = [(letter * m, SWAP + SHORTEN * (m < n)) for letter in STANDS_FOR.get(char, "") for m in sorted({1, n})]
            out.append([*reads, ("", WASTE if reads else DROP), (char * n, 0.0)])
        k += n
    return out


def viterbi(pieces: list[list[tuple[str, float]]], lm: Characters) -> str:
    """The cheapest reading; ^ marks ends of words inside it."""
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    for piece in [*pieces, [("^", 0.0)]]:
        after: dict[str, tuple[float, str]] = {}
        for context, (cost, read) in best.items():
            for chars, extra in piece:
                now, at = cost + extra, context
                for c in chars:
                    now += lm.step(at, c)
                    at = "^^" if c == "^" else at[1] + c
                if at not in after or now < after[at][0]:
                    after[at] = (now, read + chars)
        best = after
    return min(best.values())[1]


def shortened(word: str, lm: Characters) -> str:
    """The cheapest reading of a word of letters whose repeats may be read shorter."""
    found = list(REPEAT.finditer(word))
    if not found:
        return word
    if any(b.start() - a.end() < 2 for a, b in zip(found, found[1:], strict=False)):
        return viterbi(lattice(word), lm).rstrip("^")
    # no trigram reaches from one repeat to another, so each is read by itself, with two letters on either side
    padded, out, at = f"^^{word}^", [], 0
    for m in found:
        start, end = m.span()
        out.append(word[at:start] + m[1] * lm.length_of_run(padded[start : end + 4], end - start))
        at = end
    return "".join(out) + word[at:]


def restore(token: str, lm: Characters) -> tuple[str, ...]:
    """The words that a token stands for."""
    low = token.lower()
    core = low.strip(EDGE)
    if core.isalpha():
        return (shortened(core, lm),)
    core = low.strip(EDGE.replace("|", "").replace("+", "").replace("!", "").replace("(", ""))
    if not any(c.isalpha() for c in core):
        return ()
    read = "".join(c if c.isalpha() else "^" for c in viterbi(lattice(core), lm))
    return tuple(w for w in read.split("^") if w)


def unspaced(text: str, lm: Characters) -> list[str]:
    """Words spelled with white space after each letter."""
    out = []
    for found in SPACED.findall(" " + text):
        pieces: list[list[tuple[str, float]]] = []
        for char in found.lower().split():
            if pieces:
                pieces.append([("", 0.0), ("^", BREAK)])
            pieces += lattice(char)
        out += [w for w in viterbi(pieces, lm).split("^") if len(w) > 2]
    return out


def features(word: str) -> Iterator[str]:
    yield word
    yield from (f"{word[:n]}*" for n in PREFIXES if len(word) > n)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time: Spark's batches hold 10,000 whole texts."""
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            yield batch.slice(lo, ROWS)


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    total: Counter[tuple[int, int, int]] = Counter()

    def drain() -> None:
        cores = [(core, n) for token, n in words.items() if (core := token.strip(EDGE)).isalpha()]
        words.clear()
        for lo in range(0, len(cores), PART):
            some = cores[lo : lo + PART]
            sizes = np.fromiter((len(core) + 3 for core, _ in some), np.int64, len(some))
            chars = np.frombuffer("".join(f"^^{core}^" for core, _ in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            inside = np.ones(len(chars), bool)
            inside[np.cumsum(sizes) - 1] = inside[np.cumsum(sizes) - 2] = False
            at = np.flatnonzero(inside)
            codes, inverse = np.unique((chars[at] << 42) | (chars[at + 1] << 21) | chars[at + 2], return_inverse=True)
            times = np.bincount(inverse, np.repeat(np.fromiter((n for _, n in some), np.int64, len(some)), sizes - 2), len(codes))
            for code, n in zip(codes.tolist(), times.tolist(), strict=True):
                total[code] += int(n)

    for batch in parts(batches):
        for text in batch.column("text").to_pylist():
            words.update(text.lower().split())
            if len(words) > MOST_WORDS:
                drain()
    drain()
    mask = (1 << 21) - 1
    grams = [chr(c >> 42) + chr(c >> 21 & mask) + chr(c & mask) for c in total]
    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(total.values(), pa.int64())], names=["gram", "n"])


class Recent(dict):
    """What ``find`` gives for a token, kept while it is asked for again: the last MOST_WORDS tokens and those before."""

    def __init__(self, find: Callable[[str], tuple]):
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, token: str) -> tuple:
        if len(self) >= MOST_WORDS:
            self.before = dict(self)
            self.clear()
        found = self.before.get(token)
        if found is None:
            found = self.find(token)
        self[token] = found
        return found


def read_texts(lm: Characters):
    """The distinct restored words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Recent(lambda token: restore(token, lm))
        for batch in parts(batches):
            words = []
            for text in batch.column("text").to_pylist():
                own = set(unspaced(text, lm))
                for token in set(text.split()):
                    own.update(seen[token])
                words.append(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    return run


def count_features(weights: dict[str, float]):
    """Texts that have a feature, toxic or not, in some rows of a task; toxic texts with any of ``weights`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}

        def drain() -> Iterator[pa.RecordBatch]:
            for toxic, own in counts.items():
                n, none = pa.array(own.values(), pa.int64()), pa.array(np.zeros(len(own), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), *((n, none) if toxic else (none, n))], names=["feature", "n1", "n0"])
                own.clear()

        for batch in parts(batches):
            for words, toxic in zip(batch.column("words").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {f for w in words for f in features(w)}
                if not toxic or weights.keys().isdisjoint(own):
                    counts[toxic].update(own)
                if len(counts[0]) + len(counts[1]) > MOST_FEATURES:
                    yield from drain()
        yield from drain()

    return run


class Weights:
    """Evidence of words, tokens and texts."""

    def __init__(self, weights: dict[str, float], lm: Characters):
        self.weights, self.lm = weights, lm
        #: Every feature of a word begins with its first three letters.
        self.heads = {f[:3] for f in weights}
        self.seen = Recent(self.of_token)

    def of_token(self, token: str) -> tuple[tuple[str, float], ...]:
        """The words with evidence that a token stands for."""
        core = token.lower().strip(EDGE)
        # without a repeat among its first three letters, a word of letters keeps them in any reading
        if core[:3] not in self.heads and core[:1] != core[1:2] != core[2:3] and core.isalpha():
            return ()
        return tuple((w, e) for w in restore(token, self.lm) if (e := self.of_word(w)))

    def of_word(self, word: str) -> float:
        if word[:3] not in self.heads:
            return 0.0
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def of_words(self, words: list[str]) -> float:
        return math.fsum(map(self.of_word, words))

    def evidence(self, text: str) -> float:
        found = dict(p for hits in map(self.seen.__getitem__, set(text.split())) if hits for p in hits)
        for word in unspaced(text, self.lm):
            if e := self.of_word(word):
                found[word] = e
        return math.fsum(found.values())


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a ridge on the slope."""
    design, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ design + np.diag([1e-6, RIDGE])
        step = np.linalg.solve(h, design.T @ (y - p) - np.array([1e-6, RIDGE]) * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def learn(docs: DataFrame, labels: DataFrame) -> Callable[[], Callable[[str], float]]:
    """A maker of scorers, learnt from all texts (characters) and from the labelled ones among them."""
    texts = texts_of(docs)
    grams = texts.select("text").mapInArrow(count_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    lm = Characters({r.gram: r.n for r in grams.collect()})

    sample = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # a bounded sample, in the order of a hash: MAX_LABELS rows of two numbers are broadcast
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)
    train = written(texts.join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(read_texts(lm), "toxic int, words array<string>"), "read")
    totals = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        share = n1 / max(1, n0 + n1)
        return lambda: lambda text: share

    # In rounds, the surest features first; toxic texts that they explain don't count for later ones, which else
    # would take up whatever those texts (and copies of them) also say.
    weights: dict[str, float] = {}
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    bound = odds - Z * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    for least in LEAST_BOUNDS:
        counted = train.mapInArrow(count_features(dict(weights)), "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        found = counted.where(F.col("n1") >= LEAST_TOXIC).select("feature", odds.alias("weight"), "n1").where(bound >= least)
        weights |= {r.feature: r.weight for r in found.collect() if r.feature not in weights}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Weights(weights, lm)
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(map(seen.of_words, batch.column("words").to_pylist()), pa.float64())], names=["toxic", "evidence"])

    rows = train.mapInArrow(weigh, "toxic int, evidence double").toPandas()
    a, b = logistic(rows.evidence.to_numpy(), rows.toxic.to_numpy(float))

    def scorer() -> Callable[[str], float]:
        seen = Weights(weights, lm)
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * seen.evidence(text)))))

    return scorer


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every text."""
    maker = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = maker()
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(scorer, batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that score below ``threshold``; nothing is shuffled."""
    maker = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = maker()
        for batch in parts(batches):
            yield batch.filter(pa.array([scorer(text or "") < threshold for text in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
    scored = score(documents(spark, sf_dir), labels)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
