"""Language of words and texts by a linear-chain conditional random field.

A text's words are a chain of language labels. Emission scores are sums of learnt weights over a
word's features: its first and last one to three letters, its letter bigrams and trigrams, and
the language in whose lexicon it is. Lexicons hold the words that training texts of one language
use far more than the others'; they are counted over all training texts by Spark. A word counts from
LEXICON_RATE of all words on, so a lexicon has at most 1 / LEXICON_RATE words, whatever the corpus.
Transition scores are learnt as well.

Training takes at most ROWS different texts per language, whole, in the order of a hash, of those with
at most ROW_CHARS characters, and of these as many as have SAMPLE_CHARS together (a bounded sample of labelled rows); where all texts of
a language are longer, it takes the shortest one. Their document's
language labels all words at first; weights fitted to that relabel the words (a word goes to
another language where its neighbourhood speaks for it), so passages in another language give
transitions between labels; then the chain is fitted to the words' labels by its gradient, which
the forward-backward recursion yields.

Prediction runs forward-backward over every whole text, however long, some texts side by side in
numpy. A text's language is that with the largest sum of word probabilities; its share is the score.
Of equal languages the first by name is taken.

Features are hashed into BUCKETS weights; two that share one add up. Texts that are null, or without a letter, are ``und`` with score 0. Null languages aren't learnt
from; all others are, however rare. Without any every text is ``und``.
Rows repeated under one doc_id are labelled one by one, an empty table gives no rows, and columns
other than doc_id, text and (in training) lang are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fold, written

ROWS = 200
ROW_CHARS = 1_000_000
SAMPLE_CHARS = 4_000_000
LEXICON_SHARE = 0.9
LEXICON_COUNT = 20
LEXICON_RATE = 1e-5
BUCKETS = 1 << 16
#: Raw tokens that a task keeps scores of, or counts, at a time.
MOST_WORDS = 200_000
#: Words whose features are looked up at a time.
SCORED = 8192
EPOCHS = 30
RATE = 0.15
DECAY = 1e-4
SEGMENT = 200
#: Texts side by side, and characters of texts that are labelled together (a longer text by itself).
SIDE = 4096
CHUNK = 4_000_000
#: A letter by its category (L), so neither a fraction nor a number in a circle is one.
LETTER = regex.compile(r"\p{L}")
EDGE = ".,;:!?\"'()[]{}<>|/\\&%#*~`^=_-+$"


def plain(token: str) -> str:
    """The word as features see it; empty without letters."""
    core = token.lower().strip(EDGE)
    return core if LETTER.search(core) else ""


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, word after word, and how many each word has; below BUCKETS hashes of letters, then languages.

    A word of n letters, between ^ and $, has n + 1 bigrams, n trigrams, three first and three last pieces.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start, sizes = np.cumsum(n + 2) - (n + 2), 2 * n + 7 + (known >= 0)
    base = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), n + 2)
    place = np.arange(len(chars)) - start[word]
    after = np.append(chars[1:], np.uint64(0))
    third = np.append(after[1:], np.uint64(0))
    none = np.zeros(1, np.uint64)

    def number(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        mixed = ((a * np.uint64(0x100000001B3) + b) * np.uint64(0x100000001B3) + c) * np.uint64(0x100000001B3) + np.uint64(kind)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    flat = np.empty(int(sizes.sum()), np.int64)
    at = place <= n[word]
    flat[base[word[at]] + place[at]] = number(2, chars[at], after[at], none)
    at = place < n[word]
    flat[base[word[at]] + n[word[at]] + 1 + place[at]] = number(3, chars[at], after[at], third[at])
    first = [np.where(n > k, chars[start + np.minimum(k + 1, n)], np.uint64(0)) for k in range(3)]
    last = [np.where(n > k, chars[start + np.maximum(n - k, 1)], np.uint64(0)) for k in range(3)]
    for side, ends in enumerate((first, last)):
        for k in range(3):
            flat[base + 2 * n + 1 + 3 * side + k] = number(10 + 10 * side + k, ends[0], ends[1] if k > 0 else none, ends[2] if k > 1 else none)
    flat[(base + sizes - 1)[known >= 0]] = BUCKETS + known[known >= 0]
    return flat, sizes


def emissions(words: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """Scores per word and language; the features of some words are held at a time."""
    out = np.empty((len(words), weights.shape[1]), np.float32)
    for lo in range(0, len(words), SCORED):
        flat, n = word_features(words[lo : lo + SCORED], lexicon)
        out[lo : lo + SCORED] = np.add.reduceat(weights[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of all words of all chains, and expected transitions if ``pairs``.

    ``scores`` holds the chains one after the other. Chains are sorted by length, so those still
    running at a position are the first ones.
    """
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
    move = np.exp(step).astype(scores.dtype)
    back = np.ascontiguousarray(move.T)
    seen = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    out = np.empty_like(scores)
    total = np.zeros((k, k))
    for lo in range(0, len(n), SIDE):
        s, m = starts[lo : lo + SIDE], n[lo : lo + SIDE]
        running = np.searchsorted(-m, -np.arange(int(m[0])), "left").tolist()
        alphas: list[np.ndarray] = []
        for t, r in enumerate(running):
            a = seen[s[:r] + t]
            if t:
                a *= alphas[-1][:r] @ move
            a /= a.sum(axis=1, keepdims=True)
            alphas.append(a)
        beta = np.ones((0, k), scores.dtype)
        for t in range(len(running) - 1, -1, -1):
            r, old = running[t], len(beta)
            full = np.full((r, k), 1.0 / k, scores.dtype)
            if old:
                b = seen[s[:old] + (t + 1)] * beta
                if pairs:
                    a = alphas[t][:old]
                    total += move * ((a / ((a @ move) * b).sum(axis=1, keepdims=True)).T @ b)
                x = b @ back
                full[:old] = x / x.sum(axis=1, keepdims=True)
            out[s[:r] + t] = alphas[t] * full
            beta = full
    return out / out.sum(axis=1, keepdims=True), total


def fit(texts: list[tuple[list[str], int]], k: int, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from (words, language) of the training texts."""
    number: dict[str, int] = {}
    chains, labels, lengths = [], [], []
    for words, lang in texts:
        ids = [number.setdefault(w, len(number)) for w in words]
        for lo in range(0, len(ids), SEGMENT):
            chains += ids[lo : lo + SEGMENT]
            lengths.append(len(ids[lo : lo + SEGMENT]))
            labels += [lang] * lengths[-1]
    chains, labels, lengths = np.array(chains, np.int64), np.array(labels), np.array(lengths, np.int64)
    flat, sizes = word_features(list(number), lexicon)
    first, owner, scale = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), 1 / np.sqrt(sizes)
    weights, step = np.zeros((BUCKETS + k, k)), np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(step), np.zeros_like(step)]

    def scores() -> np.ndarray:
        return np.add.reduceat(weights[flat], first, axis=0) * scale[:, None]

    def climb(residual: np.ndarray, transitions: np.ndarray | None, turn: int) -> None:
        """A step of Adam; residual: wanted minus expected labels per word of the chains."""
        per_word = np.stack([np.bincount(chains, residual[:, j], len(number)) for j in range(k)], axis=1) * scale[:, None]
        grads = [np.stack([np.bincount(flat, per_word[owner, j], BUCKETS + k) for j in range(k)], axis=1) / len(chains) - DECAY * weights]
        grads.append(None if transitions is None else transitions / len(chains) - DECAY * step)
        for x, g, m, v in ((weights, grads[0], *moments[:2]), (step, grads[1], *moments[2:])):
            if g is not None:
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)

    wanted = np.eye(k)[labels]
    for turn in range(1, EPOCHS + 1):  # words by themselves
        e = scores()[chains]
        p = np.exp(e - e.max(axis=1, keepdims=True))
        climb(wanted - p / p.sum(axis=1, keepdims=True), None, turn)
    # words whose neighbourhood speaks for another language than their text's
    step[:] = np.log(np.where(np.eye(k, dtype=bool), 0.95, 0.05 / max(1, k - 1)))
    p, _ = forward_backward(scores()[chains] + 1.0 * wanted, lengths, step)
    labels = np.argmax(p, axis=1)
    wanted = np.eye(k)[labels]
    last = np.cumsum(lengths) - 1
    inner = np.ones(len(chains), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(labels[at] * k + labels[at + 1], minlength=k * k).reshape(k, k)
    for turn in range(1, EPOCHS + 1):  # the chain
        p, expected = forward_backward(scores()[chains], lengths, step, pairs=True)
        climb(wanted - p, seen - expected, turn)
    return weights, step


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter[str]] = {}

    def flush() -> pa.RecordBatch:
        total: Counter[tuple[str, str]] = Counter()
        for lang, words in counts.items():
            for token, n in words.items():
                if word := plain(token):
                    total[lang, word] += n
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in total]), pa.array([x[1] for x in total]), pa.array(total.values(), pa.int64())] if total else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, counts.values())) > MOST_WORDS:
            yield flush()
    yield flush()


def lexicons(train: DataFrame, langs: list[str]) -> dict[str, int]:
    """Word to number of its language, for the words that mostly belong to one."""
    counts = train.select("text", "lang").mapInArrow(count_words, "lang string, word string, n long")
    words = counts.groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.max(F.struct("n", "lang")).alias("top"))
    words = written(words.select("word", "n", F.col("top.n").alias("most"), F.col("top.lang").alias("lang")), "lexicon")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(LEXICON_COUNT, total * LEXICON_RATE)
    number = {lang: k for k, lang in enumerate(langs)}
    return {r.word: number[r.lang] for r in words.where((F.col("n") >= least) & (F.col("most") >= F.col("n") * LEXICON_SHARE)).select("word", "lang").collect()}


class Words(dict):
    """Row in the table of emission scores by raw token, -1 without letters; new words wait to be scored."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.rows: dict[str, int] = {}

    def forget(self) -> None:
        self.clear()
        self.rows.clear()

    def __missing__(self, token: str) -> int:
        word = plain(token)
        if not word:
            row = -1
        elif (row := self.rows.get(word, -1)) < 0:
            row = self.rows[word] = len(self.rows)
            self.new.append(word)
        self[token] = row
        return row


def label_words(texts: list[str], words: Words, table: list[np.ndarray], weights: np.ndarray, step: np.ndarray, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of all words with letters, such words per text)."""
    rows, lengths = [np.empty(0, np.int32)], []
    for text in texts:
        own = np.fromiter(map(words.__getitem__, text.split()), np.int32)
        rows.append(own[own >= 0])
        lengths.append(len(rows[-1]))
    if words.new:
        table[0] = np.vstack([table[0], emissions(words.new, weights, lexicon)])
        words.new.clear()
    return forward_backward(table[0][np.concatenate(rows)], np.array(lengths, np.int64), step)[0], np.array(lengths, np.int64)


class Labeller:
    """A fitted model; makes per-task functions."""

    def __init__(self, langs: list[str], weights: np.ndarray, step: np.ndarray, lexicon: dict[str, int]):
        self.langs, self.weights, self.step, self.lexicon = langs, weights.astype(np.float32), step, lexicon

    def batches(self):
        """Yields (texts, probabilities of all their words, words per text), for some texts at a time."""
        words, table = Words(), [np.empty((0, len(self.langs)), np.float32)]

        def run(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
            lo, size = 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= CHUNK or k == len(texts) - 1:
                    yield texts[lo : k + 1], *label_words(texts[lo : k + 1], words, table, self.weights, self.step, self.lexicon)
                    lo, size = k + 1, 0
                    if len(words) > MOST_WORDS:
                        words.forget()
                        table[0] = table[0][:0]

        return run


def learn(docs: DataFrame) -> Labeller | None:
    """Fit on ``docs`` (columns doc_id, text, lang)."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull())
    sizes = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    lexicon = lexicons(train, langs)
    # about 1.3 ROWS of each language by hash, equal texts once, then ROWS of them: so many come to the driver at most
    scale = 1 << 20
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(scale, int(1.3 * ROWS / sizes[lang] * scale) + 1)))))
    place = F.xxhash64("text", F.lit(7))
    near = train.where((F.length("text") <= ROW_CHARS) & (F.pmod(place, F.lit(scale)) < share[F.col("lang")])).groupBy("lang", place.alias("place")).agg(F.min("text").alias("text"))
    by_place = Window.partitionBy("lang").orderBy("place")
    ranked = near.withColumn("rank", F.row_number().over(by_place)).where(F.col("rank") <= ROWS)
    # the first always, then while the sum stays under the bound
    before = F.sum(F.length("text")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    picked = ranked.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("rank") == 1) | (F.col("before") + F.length("text") <= SAMPLE_CHARS)).select("lang", "place", "text").collect()
    if lacking := [lang for lang in langs if lang not in {r.lang for r in picked}]:
        picked += train.where(F.col("lang").isin(lacking)).groupBy("lang").agg(F.min_by("text", F.struct(F.length("text"), place)).alias("text")).select("lang", F.lit(0).alias("place"), "text").collect()
    texts = []
    for row in sorted(picked, key=lambda r: (r.place, r.lang)):
        if words := [w for w in map(plain, row.text.split()) if w]:
            texts.append((words, langs.index(row.lang)))
    if not texts:
        return None
    return Labeller(langs, *fit(texts, len(langs), lexicon), lexicon)


def label_languages(docs: DataFrame, model: Labeller | None) -> DataFrame:
    """doc_id, lang_pred, score, the share of words of the second language (second) and how often
    neighbouring words are of two languages (switches), of every text."""
    langs = model.langs if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = model.batches() if model else None
        for batch in batches:
            pred, score, second, switches = [], [], [], []
            for _, p, lengths in work(batch.column("text").to_pylist()) if work else [(None, np.empty((0, 1)), np.zeros(batch.num_rows, np.int64))]:
                full = lengths > 0
                starts = (np.cumsum(lengths) - lengths)[full]
                share, turns = np.zeros((len(lengths), p.shape[1])), np.zeros(len(lengths), np.int64)
                if len(starts):
                    share[full] = np.add.reduceat(p, starts, axis=0, dtype=float) / lengths[full][:, None]
                    best = np.argmax(p, axis=1)
                    turn = np.append(False, best[1:] != best[:-1])
                    turn[starts] = False
                    turns[full] = np.add.reduceat(turn, starts, dtype=np.int64)
                for row, n in zip(share, lengths.tolist(), strict=True):
                    ranked = np.argsort(-row, kind="stable")
                    pred.append(langs[ranked[0]] if n else "und")
                    score.append(min(1.0, max(0.0, float(row[ranked[0]]))) if n else 0.0)
                    second.append(float(row[ranked[1]]) if n and len(ranked) > 1 else 0.0)
                switches += turns.tolist()
            columns = [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.float64()), pa.array(switches, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "second", "switches"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, second double, switches long")


def spans(text: str, model: Labeller) -> list[tuple[str, int, int]]:
    """Runs of words of one language: (language, first word, after the last), words without letters joining the run before."""
    found: list[tuple[str, int, int]] = []
    tokens = text.split()
    _, p, _ = next(iter(model.batches()([text])))
    best = iter(np.argmax(p, axis=1).tolist())
    for k, token in enumerate(tokens):
        lang = model.langs[next(best)] if plain(token) else (found[-1][0] if found else "und")
        if found and found[-1][0] == lang:
            found[-1] = (lang, found[-1][1], k + 1)
        else:
            found.append((lang, k, k + 1))
    return found


def op4_crf_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(fold("doc_id", 3) != 1))
    found = label_languages(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "second", "switches")
