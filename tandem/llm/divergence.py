"""Source divergence audit: in which terms, and by how much, the sources of a language differ.

Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z lower-cased. A language keeps
the terms of at least LEAST_DOCS of its documents (V of them). A source gives a kept term with ``count``
occurrences the share p = 1 + floor(SCALE * (count + 1) / (N + V)), N being its occurrences of all kept
terms; the language as a whole likewise. A term weighs f(p, q) = floor((p - q)^2 / q).

* ``pair`` rows: for each source every other one of its language, and the sum of f over all kept terms;
* ``term`` rows: for each source its terms with p above the language's, by f, up to TOP of them.

Terms that occur equally often in each source give the same summands everywhere. So kept terms are grouped
by their sparse vector of (source, count), and everything is evaluated once per distinct vector and
multiplied by how many terms have it. Most entries of a vector are zero: with both counts zero, f is a
constant of the two sources, with one of them zero it hangs on the other count alone. Those parts come from
a histogram of counts per source, and only entries of one vector that are both above zero are paired.
Original terms are ranked at the end, those of the first TOP vectors of each source: no other vector can
have a term among the first TOP, as each of the TOP vectors before it has at least one before its first.

Counts are summed in each task before any shuffle, so a frequent term or a large source comes as one row a
task and source. All arithmetic is exact (whole numbers, decimals where 64 bits could be left).

Null text, lang and source are ''. A source without kept terms has N = 0; a language without kept terms has
pairs of value 0 and no term rows. Rows repeated under one doc_id count as documents each. Ties are ranked by the
bytes of the item. Texts of any length are cut into pieces of about CHUNK bytes at word ends. An
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, raw, written

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: A task hands its counts on whenever it holds so many.
HELD = 400_000
CHUNK = 1 << 22
#: Vectors to be ranked are broadcast up to so many.
FEW = 200_000

COUNTS = "lang string, source string, term binary, n long, docs long"
#: Lower-cases A-Z; what separates terms becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in portions."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, and documents that have the term, per language, source and term of a task."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            names = list(n)
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                cols = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
            n, docs = found[lang, source]
            seen: set[bytes] = set()
            for words in terms(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in found.values()) > HELD:
            yield from out()
    yield from out()


def share(count: Column, total: Column, size: Column) -> Column:
    """p of a term with ``count`` where all kept terms come ``total`` times and are ``size`` many."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.expr("1L") + F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(18,0)"), wide(total + size))


def weight(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, term and its vector, an array of (source, n) by source; terms of at least LEAST_DOCS documents."""
    named = docs.select(raw().alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    # dealt by term at once: sums by source, then the vector, need no other shuffle
    dealt = named.mapInArrow(counted, COUNTS).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = by_source.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs"))
    return vectors.where(F.col("docs") >= LEAST_DOCS).select("lang", F.col("term").cast("string").alias("term"), "vector")


def divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank; of ``docs`` text, lang and source are read."""
    kept = written(kept_terms(docs), "terms")
    classes = written(kept.groupBy("lang", "vector").agg(F.count("*").alias("m"), F.min("term").alias("first")), "vectors")
    entries = classes.select("lang", "vector", "m", "first", F.explode("vector").alias("e")).select("*", F.col("e.source").alias("source"), F.col("e.n").alias("n")).drop("e")
    # one row for each source of each language, and one for each language: their totals
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("own"))
    sizes = classes.groupBy("lang").agg(F.sum("m").alias("size"), F.sum(F.col("m") * F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e["n"])).alias("all"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "own", "size", "all"])
    # where nothing is kept there's nothing to divide either
    none = F.when(F.col("size") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("size"))).otherwise(F.lit(1).cast("long"))
    groups = written(groups.withColumn("none", none), "groups")
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), F.col("none").alias(f"none_{x}"), "size")
    p, q = side("source"), side("item").drop("size")

    both = p.join(q, "lang").where("source != item")
    value = lambda v: v.cast("decimal(38,0)").alias("value")
    flat = weight(F.col("none_source"), F.col("none_item"))
    base = both.select("lang", "source", "item", value(flat * F.col("size")))
    # terms of the one source, in place of what it would give a term that it lacks
    counts = written(entries.groupBy("lang", "source", "n").agg(F.sum("m").alias("m")), "counts")
    for_p = counts.join(p, ["lang", "source"]).join(q, "lang").where("source != item")
    own = share(F.col("n"), F.col("total_source"), F.col("size"))
    single = for_p.select("lang", "source", "item", value((weight(own, F.col("none_item")) - flat) * F.col("m")))
    for_q = counts.withColumnRenamed("source", "item").join(q, ["lang", "item"]).join(p, "lang").where("source != item")
    other = share(F.col("n"), F.col("total_item"), F.col("size"))
    mirrored = for_q.select("lang", "source", "item", value((weight(F.col("none_source"), other) - flat) * F.col("m")))
    # terms of both: pairs of entries of a vector
    paired = entries.where(F.size("vector") > 1).select("lang", "m", "source", "n", F.explode("vector").alias("e")).where("source != e.source")
    paired = paired.groupBy("lang", "source", "n", F.col("e.source").alias("item"), F.col("e.n").alias("k")).agg(F.sum("m").alias("m"))
    paired = paired.join(p, ["lang", "source"]).join(q, ["lang", "item"])
    mine, theirs = share(F.col("n"), F.col("total_source"), F.col("size")), share(F.col("k"), F.col("total_item"), F.col("size"))
    change = weight(mine, theirs) - weight(mine, F.col("none_item")) - weight(F.col("none_source"), theirs) + flat
    shared = paired.select("lang", "source", "item", value(change * F.col("m")))
    summed = base.unionByName(single).unionByName(mirrored).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    ordered = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    pairs = summed.withColumn("rank", F.row_number().over(ordered("item"))).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    # each source's terms, by vector first
    placed = entries.join(groups, ["lang", "source"])
    every = F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    placed = placed.withColumns({"p": share(F.col("n"), F.col("total"), F.col("size")), "q": share(every, F.col("all"), F.col("size"))}).where("p > q")
    placed = placed.select("lang", "source", "vector", "first", weight(F.col("p"), F.col("q")).alias("value"))
    chosen = written(placed.withColumn("rank", F.row_number().over(ordered("first"))).where(F.col("rank") <= top).drop("rank", "first"), "chosen")
    named = kept.join(F.broadcast(chosen) if chosen.count() <= FEW else chosen, ["lang", "vector"])
    ranked = named.withColumn("rank", F.row_number().over(ordered("term"))).where(F.col("rank") <= top)
    return pairs.unionByName(ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))
