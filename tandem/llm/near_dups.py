"""N-gram Jaccard join with adaptive multi-match prefixes (after AdaptJoin, Wang et al. 2012).

A document's set holds its distinct five-word shingles (A-Z lower-cased; fewer than five words:
the whole sequence as one). Two documents link when 100 * |A & B| >= 75 * |A | B|.

Shingles are ordered by document frequency, rarest first. With alpha = ceil(0.75 n) and a match
count l, the l-prefix of a set of n shingles is its first n - alpha + l. Two sets that link share
at least min(l_a, l_b) shingles inside their prefixes, so each document may pick its own l: the
one with the lowest estimated cost of postings and candidates, sum(df - 1) * (1 + VERIFY / l).

Stages, all of them Spark jobs:

1. one row (doc_id, set fingerprint, n) per document, and the shingles that are very common;
   equal sets are one class from here on, so copies are never expanded into pairs;
2. (shingle, class) postings in packed sorted blocks, shuffled by shingle range: frequencies.
   Shingles of one class only can't match, so they are dropped there and merely counted as the
   start of the prefix. Very common shingles (a bounded list, which is broadcast with its counts)
   aren't shuffled by shingle: they go by class, so no task gathers their postings;
3. prefixes per class;
4. every class is verified against its best hub (the class with the fewest shingles of its own
   among those sharing a prefix shingle); this joins a group of k near copies by about k pairs;
   Then in turns, while that keeps cutting the estimate of what is left, classes outside the main
   component of a shingle are verified against a few classes inside it;
5. all remaining pairs: only between different components, with enough shared prefix shingles,
   then verified; a shingle whose classes are all in one component yields none;
6. connected components by large-star / small-star steps.

Shingles and sets are named by 64-bit hashes. Empty texts have an empty set, link with nothing
and are their own component. Rows repeated under one doc_id come back as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, raw, written

WORDS = 5
PERCENT = 75
MAX_MATCHES = 4
#: Cost of verifying a candidate, in postings.
VERIFY = 8.0
#: Rounds in which classes outside a shingle's main component try HUBS classes inside it each.
TURNS = 4
HUBS = 4
#: Shingles of more classes than this are joined together with the classes' prefixes.
LARGE = 48
#: A task packs its postings whenever it holds so many.
CHUNK = 1_000_000
#: Postings that a task counts at a time, about.
BUCKET = 1_500_000
#: A shingle is very common when 1 in HOT of all documents has it; so the list's length is at most
#: HOT times the mean set size, whatever the number of documents.
HOT = 400
HOT_LEAST = 64


class WordHash(dict):
    """64-bit hashes of words, kept while there are few enough of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def fingerprint(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: doc_id, fingerprint, n) and (kind 1: locally common shingle, count)."""
    hashes, seen, held, size = WordHash(), set(), [], 0

    def common() -> pa.RecordBatch:
        if not held:
            return rows(1, np.empty(0, np.int64), np.empty(0, np.int64), 0)
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= max(8, len(held) // (HOT // 2))
        return rows(1, signed(tokens[often]), counts[often], 0)

    def rows(kind: int, a, b, n, valid=None) -> pa.RecordBatch:
        k = len(a)
        n = np.full(k, n, np.int64) if np.isscalar(n) else n
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["kind", "a", "b", "n"])

    for batch in batches:
        prints, sizes = [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, hashes)
            prints.append(fp := fingerprint(found) if len(found) else None)
            sizes.append(len(found))
            if fp is not None and fp not in seen:
                seen.add(fp)
                held.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield common()
                    seen.clear()
                    held.clear()
                    size = 0
        yield rows(0, batch.column("doc_id"), prints, np.array(sizes, np.int64))
    yield common()


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first: small numbers leave long runs of zeros for the shuffle's compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


BLOCK = "bucket int, tokens binary, owner binary, prints binary, sizes binary"


def pack(hot: np.ndarray, buckets: int):
    """Postings of the classes of a task in sorted blocks, by range of the shingle or, for common shingles, by class."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def blocks(tokens: np.ndarray, owner: np.ndarray, bucket: np.ndarray, prints: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        out = {"bucket": [], "tokens": [], "owner": [], "prints": [], "sizes": []}
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own, index = np.unique(owner[lo:hi], return_inverse=True)
            out["bucket"].append(int(bucket[lo]))
            out["tokens"].append(planes(np.diff(tokens[lo:hi], prepend=np.uint64(0))))
            out["owner"].append(planes(index.astype(np.uint32)))
            out["prints"].append(prints[own].tobytes())
            out["sizes"].append(planes(sizes[own]))
        if out["bucket"]:
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("tokens", "owner", "prints", "sizes"))], names=list(out))

    def flush(held: list, prints: list) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(x) for x in held])
        tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), lengths)
        prints, sizes = np.array(prints, np.int64), lengths.astype(np.uint32)
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens if len(hot) else np.zeros(len(tokens), bool)
        t, o = tokens[~is_hot], owner[~is_hot]
        yield from blocks(t, o, (t >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(t), np.int64), prints, sizes)
        t, o = tokens[is_hot], owner[is_hot]
        by_class = buckets + prints[o] % buckets
        order = np.argsort(by_class, kind="stable")
        yield from blocks(t[order], o[order], by_class[order], prints, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, prints, size = WordHash(), set(), [], [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = shingles(text, hashes)
                if not len(found) or (fp := fingerprint(found)) in seen:
                    continue
                seen.add(fp)
                held.append(found)
                prints.append(fp)
                size += len(found)
                if size >= CHUNK:
                    yield from flush(held, prints)
                    seen, held, prints, size = set(), [], [], 0
        if held:
            yield from flush(held, prints)

    return run


def count(hot: np.ndarray, hot_counts: np.ndarray, buckets: int):
    """The shared postings of a block: (class, its n, shingle, frequency), once each."""

    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in blocks.tokens])
        owners = [unplanes(x, np.uint32) for x in blocks.owner]
        prints = np.concatenate([np.frombuffer(p, np.int64)[o] for p, o in zip(blocks.prints, owners, strict=True)])
        sizes = np.concatenate([unplanes(s, np.uint32)[o] for s, o in zip(blocks.sizes, owners, strict=True)])
        del owners
        order = np.argsort(tokens, kind="stable")
        tokens, prints, sizes = tokens[order], prints[order], sizes[order]
        if key[0] < buckets:
            same = tokens[1:] == tokens[:-1]
            shared = np.append(same, False) | np.append(False, same)
            tokens, prints, sizes = tokens[shared], prints[shared], sizes[shared]
        order = np.lexsort((prints, tokens))
        tokens, prints, sizes = tokens[order], prints[order], sizes[order]
        first = np.append(True, (tokens[1:] != tokens[:-1]) | (prints[1:] != prints[:-1]))[: len(tokens)]
        tokens, prints, sizes = tokens[first], prints[first], sizes[first]
        if key[0] < buckets:
            starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
            runs = np.diff(np.append(starts, len(tokens)))
            df = np.repeat(runs, runs)
        else:
            df = hot_counts[np.searchsorted(hot, tokens)]
        keep = df > 1
        return pd.DataFrame({"fp": prints[keep], "n": sizes[keep].astype(np.int64), "token": signed(tokens[keep]), "df": df[keep].astype(np.int64)})

    return run


def need():
    """The least overlap of a linking pair, from one side's size."""
    return F.floor((F.col("n") * PERCENT + 99) / 100)


def prefixes(shared: DataFrame) -> DataFrame:
    """Per class that can link at all: n, shared shingles rarest first, l, and how many of them its prefix holds."""
    sets = (
        shared.groupBy("fp")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("posting"))
        .withColumn("s", F.size("posting").cast("long"))
        .withColumn("need", need())
        .where("s >= need")
    )
    room = lambda l: F.col("s") - F.col("need") + l  # noqa: E731  of the prefix n - need + l, the n - s unshared come first
    cost = [
        F.when(
            F.lit(l) <= F.col("need"),
            F.struct((F.aggregate(F.slice("posting", 1, room(l).cast("int")), F.lit(0.0), lambda a, x: a + x["df"] - 1) * (1 + VERIFY / l)).alias("cost"), F.lit(l).alias("l")),
        )
        for l in range(1, MAX_MATCHES + 1)  # noqa: E741
    ]
    return (
        sets.withColumn("l", F.least(*cost)["l"])
        .withColumn("k", F.least(room(F.col("l")), F.col("s")).cast("int"))
        .select("fp", "n", "s", "l", "k", F.transform("posting", lambda x: x["token"]).alias("tokens"))
    )


def can_link(a: str, b: str):
    """Bounds that any linking pair meets: sizes, and shared shingles against the overlap it needs."""
    n_a, n_b, s_a, s_b = (F.col(f"{side}.{x}") for x in ("n", "s") for side in (a, b))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT) & (F.least(s_a, s_b) * (100 + PERCENT) >= (n_a + n_b) * PERCENT)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) whose sets are similar enough."""
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("t_a", "t_b"))
    return both.where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * PERCENT).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(edges.select(high.alias("u"), low.alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u != v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def opened(postings: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """Postings of the shingles whose classes are in several components, with their component and the
    shingle's main one; and how many pairs of a posting outside the main component with any other."""
    comp = components(found)
    placed = postings.join(comp, postings.fp == comp.node, "left").withColumn("comp", F.coalesce("root", "fp")).drop("node", "root")
    per_comp = placed.groupBy("token", "comp").agg(F.count("*").alias("m"))
    tokens = per_comp.groupBy("token").agg(F.max(F.struct("m", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("m").alias("m")).where("comps > 1")
    tokens = written(tokens.select("token", F.col("main.comp").alias("main"), ((F.col("m") - F.col("main.m")) * F.col("m")).alias("pairs")), "tokens")
    return placed.join(tokens.drop("pairs"), "token"), tokens.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def to_hubs(placed: DataFrame, turn: int) -> DataFrame:
    """For each class outside a main component, the HUBS classes of main components it shares most with, of some that ``turn`` picks."""
    pick = lambda k: F.min(F.when(F.col("comp") == F.col("main"), F.struct(F.xxhash64("fp", F.lit(turn * HUBS + k)).alias("h"), "fp", "n", "s")))
    hubs = placed.groupBy("token").agg(F.array_distinct(F.array(*(F.struct(*(pick(k)[c].alias(c) for c in ("fp", "n", "s"))) for k in range(HUBS)))).alias("hubs"))
    shared = (
        placed.where("comp != main")
        .join(hubs, "token")
        .select("fp", "n", "s", F.explode("hubs").alias("hub"))
        .alias("x")
        .where(can_link("x", "hub"))
        .groupBy("fp", F.col("hub.fp").alias("b"))
        .agg(F.count("*").alias("m"))
    )
    rank = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("m"), "b"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= HUBS).select(F.col("fp").alias("a"), "b")


def links(sets: DataFrame) -> DataFrame:
    """Verified links that hold every component of the similarity graph together."""
    prefix = F.slice("tokens", 1, F.col("k"))
    postings = sets.select("fp", "n", "s", "l", F.round((F.col("n") - F.col("s")) / F.col("n"), 3).alias("own"), F.explode(prefix).alias("token"))
    hubs = postings.groupBy("token").agg(F.min(F.struct("own", "fp", "n", "s")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("token", "hub")
    best = (
        postings.alias("x")
        .join(hubs, "token")
        .where((F.col("fp") != F.col("hub.fp")) & can_link("x", "hub"))
        .groupBy("fp", F.col("hub.fp").alias("b"))
        .agg(F.count("*").alias("m"))
        .groupBy(F.col("fp").alias("a"))
        .agg(F.max(F.struct("m", "b")).alias("best"))
        .select("a", "best.b")
    )
    found = written(verified(best, sets), "links")
    every, before = postings.count(), None
    for turn in range(TURNS):
        placed, pairs = opened(postings, found)
        if pairs <= every or (before is not None and pairs > 0.8 * before):
            break
        placed = written(placed, "open")
        found, before = written(found.union(verified(to_hubs(placed, turn), sets)), "links"), pairs
    else:
        placed, _ = opened(postings, found)
    first = F.array_contains(F.slice("prefix", 1, (F.col("s") - need() + 1).cast("int")), F.col("token"))
    placed = written(placed.select("token", "fp", "n", "s", "main", "comp"), "open")
    side = sets.select("fp", "l", prefix.alias("prefix"), (F.col("s") - F.col("k")).alias("rest"))
    both = F.array_intersect("x.prefix", "y.prefix")
    enough = (F.size(both) >= F.least("x.l", "y.l")) & ((F.size(both) + F.greatest("x.rest", "y.rest")) * (100 + PERCENT) >= (F.col("x.n") + F.col("y.n")) * PERCENT)
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp"))) & can_link("x", "y")
    large = placed.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > LARGE).select("token")
    # Shingles of few classes: pairs at once, then what their prefixes share.
    few = placed.join(large, "token", "left_anti")
    loose = few.where("comp != main").alias("x").join(few.alias("y"), apart).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    end = lambda x: sets.select(F.col("fp").alias(x), F.struct("n", "l", prefix.alias("prefix"), (F.col("s") - F.col("k")).alias("rest")).alias({"a": "x", "b": "y"}[x]))
    loose = loose.join(end("a"), "a").join(end("b"), "b").where(enough).select("a", "b")
    # Shingles of many: the prefixes come along to the join, so that only pairs with enough in common come out, once for
    # the first such shingle they share.
    many = placed.join(large, "token", "left_semi")
    own = many.groupBy("fp").agg(F.collect_set("token").alias("many"))
    many = written(many.join(side, "fp").where(first).join(own, "fp").withColumn("many", F.array_intersect("prefix", "many")), "many")
    tight = many.where("comp != main").alias("x").join(many.alias("y"), apart & (F.get(F.array_intersect("x.many", "y.many"), F.lit(0)) == F.col("x.token")) & enough).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pairs = loose.union(tight).distinct()
    return found.union(verified(pairs, sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (columns doc_id, text are read)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("text"))
    first = written(texts.mapInArrow(describe, "kind int, a long, b long, n long"), "described")
    rows = first.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("fp"), F.col("n").alias("n_shingles"))
    total, n_docs = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    common = first.where("kind = 1").groupBy("a").agg(F.sum("b").alias("df")).where(F.col("df") >= max(HOT_LEAST, n_docs // HOT)).toPandas()
    hot = common.a.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], common.df.to_numpy(np.int64)[order]
    buckets = 1 << max(0, (max(1, total // BUCKET)).bit_length() - 1)
    blocks = texts.select("text").mapInArrow(pack(hot, buckets), BLOCK)
    shared = blocks.groupBy("bucket").applyInPandas(count(hot, hot_counts, buckets), "fp long, n long, token long, df long")
    sets = written(prefixes(shared), "sets")
    found = components(links(sets))
    smallest = rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    member = smallest.join(found, smallest.fp == found.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = member.join(named, "root").select("fp", "component_id")
    return rows.join(member, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
