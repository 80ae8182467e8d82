"""Mix sources to target weights by the cube method (Deville and Tille 2004).

A source's target says how often, in the mean, each of its documents is taken: target / size of
the source. The whole part of that is taken for certain; the fraction is an inclusion probability.
The flight phase moves the probabilities along the null space of two balancing equations
(documents taken, tokens taken), so both totals of a source stay as they are while at each step
at least one probability becomes 0 or 1. Documents are dealt into blocks by a
hash; each block leaves at most two documents open, the open ones of many blocks meet in the next
round. A source's flight ends when LAND documents are open. Landing them takes, of all ways to settle so
few, the one nearest to the tokens that they stand for, and of equal ones the nearest to their number.

Reruns agree: blocks, orders and random numbers derive from doc_id, size and source alone.
Null text has size 0, a null source is a source of its own, an empty table gives no rows. Rows
repeated under one doc_id are drawn one by one, and so are rows without one; those of one size are alike, so
they are counted and numbered, and dealt into blocks by that number as well. Long texts only have a
large size; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, written

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
BLOCK = 4096
#: Open documents that are landed together.
LAND = 12
#: Tasks of a flight at most.
MOST_TASKS = 20_000
SEED = 20240607
EPS = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per source: rank, size, target. Sources by code point, null last, take the weights in turn.

    Sharing the total by weight, stopping sources at ``cap`` times their size and resharing the
    excess until none is above comes to target = min(cap * size, level * weight), where level is
    found along the sources ordered by cap * size / weight. The table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.row_number().over(order).alias("i"), "level"))
    per = per.withColumn("level", F.min(fits).over(every)["level"])
    return per.select("source", "rank", "n", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def move(size: np.ndarray, pi: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Step along ``u`` or against it to where a probability becomes 0 or 1; the mean step is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.min(np.where(u > 0, (1 - pi) / u, np.where(u < 0, -pi / u, np.inf)))
        down = np.min(np.where(u > 0, pi / u, np.where(u < 0, (pi - 1) / u, np.inf)))
    pi = pi + (up if rng.random() * (up + down) < down else -down) * u
    return np.where(pi < EPS, 0.0, np.where(pi > 1 - EPS, 1.0, pi))


def fly(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move ``pi`` until at most two entries are open, or if ``land`` LAND, which are landed; sizes come largest first.

    The direction is the unit vector of the largest open document, projected onto the null space of
    the two balancing equations over all open documents: it moves most, so it's settled early, and
    the two that stay open are among the smallest.
    """
    pi = pi.copy()
    where = np.flatnonzero((pi > 0) & (pi < 1))
    s = size[where].astype(float)
    p = pi[where]
    while len(p) > (LAND if land else 2):
        mean = s.mean()
        centred = s - mean
        spread = centred @ centred
        u = np.full(len(p), -1 / len(p)) - (centred[0] / spread * centred if spread > 0 else 0.0)
        u[0] += 1
        if abs(u[0]) < 1e-6:  # the largest alone fixes the tokens: let the documents' total go
            u = -s[0] / (s[1:] @ s[1:]) * s
            u[0] = 1
        p = move(s, p, u / np.abs(u).max(), rng)
        closed = (p <= 0) | (p >= 1)
        pi[where[closed]] = p[closed]
        where, s, p = where[~closed], s[~closed], p[~closed]
    if land and len(p):
        ways = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
        tokens, number = np.abs(ways @ s - p @ s), np.abs(ways.sum(axis=1) - p.sum())
        p = ways[np.lexsort((rng.random(len(ways)), number.round(6), tokens.round(6)))[0]].astype(float)
    pi[where] = p
    return pi


def flight(seed: int, stage: int, land: bool):
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "none", "id", "k"], ascending=[False, True, True, True])
        rng = np.random.default_rng([seed, stage, int(key[0]), int(key[1])])
        return block.assign(pi=fly(block["size"].to_numpy(), block.pi.to_numpy(), rng, land))

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), copies (how often the document is taken)."""
    sizes = written(sized(docs), "sizes")
    per = written(targets(sizes, weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    blocks = F.floor((F.col("n") - 1) / BLOCK) + 1
    # rows that are alike are counted and numbered, in two steps so that no task numbers all of a large group
    alike = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("times"))
    parts = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / BLOCK)))).repartition("doc_id", "size", "part")
    first = F.col("part") * BLOCK
    rows = parts.withColumn("k", F.explode(F.sequence(first, F.least(F.col("times"), first + BLOCK) - 1)))
    # one row per source: broadcast by size, as Spark finds it
    rows = rows.join(per, rows.source.eqNullSafe(per.source)).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.col("doc_id").isNull().alias("none"),
        "k",
        "size",
        "rank",
        F.floor(rate).alias("whole"),
        (rate - F.floor(rate)).alias("pi"),
        F.pmod(F.xxhash64("doc_id", "size", "k", F.lit(seed)), blocks).alias("block"),
    )
    shape = "id long, none boolean, k long, size long, rank int, whole long, pi double, block long"
    most, every = per.agg(F.coalesce(F.max(blocks), F.lit(0)), F.coalesce(F.sum(blocks), F.lit(0))).first()
    tasks = lambda n: max(1, min(MOST_TASKS, int(n)))
    calm = (F.col("pi") < EPS) | (F.col("size") == 0)
    done = [rows.where(calm).withColumn("pi", F.lit(0.0))]
    rows, stage = rows.where(~calm), 0
    while most > 1:
        rows = written(rows.repartition(tasks(every), "rank", "block").groupBy("rank", "block").applyInPandas(flight(seed, stage, False), shape), "flight")
        every /= BLOCK // 2
        closed = F.col("pi").isin(0.0, 1.0)
        done.append(rows.where(closed))
        rows, stage, most = rows.where(~closed).withColumn("block", F.floor(F.col("block") / (BLOCK // 2))), stage + 1, -(-most // (BLOCK // 2))
    done.append(rows.withColumn("block", F.lit(0).cast("long")).groupBy("rank", "block").applyInPandas(flight(seed, stage, True), shape))
    fields = ("id", "none", "size", "rank", "whole", "pi")
    flown = done[0].select(*fields)
    for x in done[1:]:
        flown = flown.union(x.select(*fields))
    doc_id = F.when(~F.col("none"), F.col("id")).alias("doc_id")
    return flown.join(per, "rank").select(doc_id, "source", "size", "source_size", "target", (F.col("whole") + F.round("pi").cast("long")).alias("copies"))


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
