"""Near duplicates among embeddings by p-stable hashing (after Datar, Immorlica, Indyk and Mirrokni 2004).

Vectors of one label link when their cosine, in double precision, is COSINE or more. Vectors are normalised, so
that is a Euclidean distance of at most sqrt(2 - 2 * COSINE). A table hashes a vector by k quantised
projections floor((a . v + b) / WIDTH) on normal directions; vectors that agree in all k, and in label and length, share its
bucket. Vectors of a bucket are compared exactly.

k and the number of tables follow from the data's size and from the wanted RECALL alone: k is so large that among n
vectors without structure a bucket brings CHANCE others on average, and there are so many tables that a pair
exactly at the threshold shares a bucket with probability RECALL (closer pairs with a higher one).

1. Equal vectors of a label become one class, with how many they are and their smallest vec_id; copies are never
   compared, each links with all the others.
2. Classes are hashed; sizes of buckets are counted before any vector moves. Buckets of one class are dropped.
3. A bucket of up to SIDE classes is compared as it is; a larger one is cut into blocks of about SIDE by a hash, and every
   two blocks are compared by themselves, so no task holds more than 2 * SIDE vectors of a bucket. Buckets that hold more than
   1 in SHARE classes are a list of bounded length (SHARE for each table), which is broadcast; the others are joined.
4. A pair counts in the first table only in which it shares a bucket, so links are summed per class without a list
   of pairs; of each comparison only the edges of a spanning star per connected part go on to the components.

Vectors that are null, empty, zero or hold a null or non-finite component, and those without a label, link with nothing and are
their own component. Vectors of different lengths have no cosine and don't link. Rows repeated under one vec_id are rows
each: with equal vectors they link. A row without vec_id takes part, but never names a component; component_id is null where no
row of it has one, and such rows are kept only if it is. Components are by smallest vec_id, so there are no ties. An empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .near_dups import components

COSINE = 0.98
#: Width of a quantised projection; a threshold pair of 0.98 lies 0.2 apart, so a fifth of it.
WIDTH = 1.0
RECALL = 0.98
CHANCE = 0.1
SIDE = 1024
SHARE = 1024
SEED = 11
#: Rows that are compared at a time, about.
GATHERED = 8192

ROWS = "vec_id long, label string, print binary, vector binary"
NOBODY = (1 << 63) - 1


def agree(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection is the same for two vectors so far apart."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def sizes_of(n: int, cosine: float = COSINE, recall: float = RECALL, chance: float = CHANCE) -> tuple[int, int]:
    """Projections of a table, and tables, for n vectors; vectors without structure are sqrt(2) apart."""
    k = max(1, math.ceil(math.log(max(n, 2) / chance) / -math.log(agree(math.sqrt(2)))))
    found = agree(math.sqrt(2 - 2 * cosine)) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, fingerprint of label and vector, and the vector's doubles; the last two null for what can't link."""
    for batch in batches:
        prints, vectors = [], []
        labels = batch.column("label").to_pylist()
        for label, x in zip(labels, batch.column("embedding"), strict=True):
            values = x.values
            v = None if label is None or values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype("<f8")
            if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                prints.append(None)
                vectors.append(None)
                continue
            # scaled by the largest first: squares neither overflow nor vanish; adding zero makes -0.0 plain
            data = (v + 0.0).tobytes()
            unit = v / np.abs(v).max()
            vectors.append((unit / np.sqrt(unit @ unit)).tobytes())
            prints.append(xxhash.xxh3_128_digest(data + label.encode()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(prints, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "print", "vector"])


def directions(length: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, length, k, tables])
    return rng.normal(size=(length, k * tables)), rng.uniform(0, WIDTH, k * tables)


def hashed(k: int, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each class its bucket in every table, a hash of label, length, table and projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            buckets = []
            for label, data in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                v = np.frombuffer(data, "<f8")
                a, b = known.get(len(v)) or known.setdefault(len(v), directions(len(v), k, tables))
                cells = np.floor((v @ a + b) / WIDTH).astype("<i4").reshape(tables, k)
                head = f"{len(v)} {label} ".encode()
                buckets.append([xxhash.xxh3_64_intdigest(head + bytes([t & 255, t >> 8]) + row.tobytes()) for t, row in enumerate(cells)])
            flat = np.array(buckets, np.uint64).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * tables), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), lists], names=["cid", "buckets"])

    return run


def linked(units: np.ndarray, buckets: np.ndarray, block: np.ndarray, halves: bool, table: np.ndarray, cosine: float) -> np.ndarray:
    """Which members of each of r groups of s vectors link; vectors (r, s, d), buckets (r, s, tables). With ``halves`` only across blocks."""
    link = np.matmul(units, units.transpose(0, 2, 1)) >= cosine
    s = units.shape[1]
    link[:, np.arange(s), np.arange(s)] = False
    if halves:
        link &= block[:, :, None] != block[:, None, :]
    if link.any():
        # pairs that met in a table before aren't new
        r, i, j = np.nonzero(link)
        before = np.arange(buckets.shape[2]) < table[r, None]
        link[r, i, j] = ~((buckets[r, i] == buckets[r, j]) & before).any(axis=1)
    return link


def stars(link: np.ndarray) -> np.ndarray:
    """For each member of each group the first member of its connected part."""
    r, s, _ = link.shape
    first = np.broadcast_to(np.arange(s), (r, s)).copy()
    while True:
        near = np.where(link, first[:, None, :], s).min(axis=2)
        now = np.minimum(first, near)
        # a member's first may have an earlier one by now
        now = np.take_along_axis(now, now, axis=1)
        if (now == first).all():
            return first
        first = now


def compared(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A stream sorted by comparison (bucket and pair of blocks) to (node, other or null, n): links per class, and edges."""

    def results(nodes, reps, n, edges) -> Iterator[pa.RecordBatch]:
        if len(nodes):
            order = np.unique(nodes, return_index=True, return_inverse=True)
            total = np.zeros(len(order[0]), np.int64)
            np.add.at(total, order[2], n)
            at = order[1]
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(nodes[at]), none, none, pa.array(total)], names=["rep", "cid", "other_rep", "other", "n"])
        if len(edges):
            e = np.unique(edges, axis=0)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(e[:, k])) for k in range(4)), pa.nulls(len(e), pa.int64())], names=["rep", "cid", "other_rep", "other", "n"])

    def portion(rows: list[tuple], bounds: list[int]) -> Iterator[pa.RecordBatch]:
        """Comparisons of one size are worked on together, up to GATHERED vectors at a time."""
        by: dict[tuple, list[int]] = {}
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            by.setdefault((hi - lo, len(rows[lo][7]), rows[lo][2] != rows[lo][3]), []).append(lo)
        nodes, reps, counts, edges = [], [], [], []
        for (s, _, halves), starts in by.items():
            if s < 2:
                continue
            each = max(1, min(GATHERED // s, (1 << 22) // (s * s)))
            for k in range(0, len(starts), each):
                part = [rows[lo + x] for lo in starts[k : k + each] for x in range(s)]
                r = len(part) // s
                units = np.frombuffer(b"".join(x[7] for x in part), "<f8").reshape(r, s, -1)
                buckets = np.array([x[8] for x in part], np.int64).reshape(r, s, -1)
                column = lambda c: np.array([x[c] for x in part], np.int64).reshape(r, s)  # noqa: B023, E731
                cid, rep, m = column(5), column(4), column(6)
                link = linked(units, buckets, column(9), halves, column(1)[:, 0], cosine)
                if not link.any():
                    continue
                n = np.where(link, m[:, None, :], 0).sum(axis=2)
                hit = n > 0
                nodes.append(cid[hit])
                reps.append(rep[hit])
                counts.append(n[hit])
                first = stars(link)
                to_cid, to_rep = np.take_along_axis(cid, first, 1), np.take_along_axis(rep, first, 1)
                far = cid != to_cid
                edges.append(np.column_stack([rep[far], cid[far], to_rep[far], to_cid[far]]))
        if nodes:
            yield from results(np.concatenate(nodes), np.concatenate(reps), np.concatenate(counts), np.concatenate(edges))

    names = ("bucket", "place", "i", "j", "rep", "cid", "m", "vector", "buckets", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        bounds: list[int] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if not rows or row[:4] != rows[-1][:4]:
                    if len(rows) >= GATHERED:
                        yield from portion(rows, [*bounds, len(rows)])
                        rows, bounds = [], []
                    bounds.append(len(rows))
                rows.append(row)
        if rows:
            yield from portion(rows, [*bounds, len(rows)])

    return run


def vector_links(table: DataFrame, cosine: float = COSINE, recall: float = RECALL, side: int = SIDE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table``; vec_id, embedding and label are read."""
    plain = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(plain.mapInArrow(described, ROWS), "vectors")
    alike = rows.where(F.col("print").isNotNull()).groupBy("print").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = written(alike.select(F.monotonically_increasing_id().alias("cid"), F.coalesce("rep", F.lit(NOBODY)).alias("rep"), "print", "m", "label", "vector"), "classes")
    n = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    total = classes.count()
    k, tables = sizes_of(n, cosine, recall)
    placed = written(classes.select("cid", "label", "vector").mapInArrow(hashed(k, tables), "cid long, buckets array<long>"), "buckets")
    keys = placed.select("cid", F.posexplode("buckets").alias("place", "bucket"))
    counts = keys.groupBy("bucket", "place").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    sizes = written(counts.withColumn("blocks", F.ceil(F.col("size") / side).cast("int")), "sizes")
    large = F.col("size") > max(side, total // SHARE)
    often = keys.join(F.broadcast(sizes.where(large)), ["bucket", "place"])
    seldom = keys.join(sizes.where(~large), ["bucket", "place"])
    met = often.unionByName(seldom)
    # each block meets itself and every other one
    block = F.pmod(F.xxhash64("cid", "place"), F.col("blocks")).cast("int")
    met = met.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cid", "bucket", "place", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    full = met.join(classes.select("cid", "rep", "m", "vector").join(placed, "cid"), "cid")
    stream = full.repartition("bucket", "place", "i", "j").sortWithinPartitions("bucket", "place", "i", "j")
    found = written(stream.mapInArrow(compared(cosine), "rep long, cid long, other_rep long, other long, n long"), "links")
    links = found.where("n is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    # nodes by smallest vec_id first, so the smallest node of a component names it
    node = lambda rep, cid: F.struct(F.col(rep).alias("rep"), F.col(cid).alias("cid"))
    joined = components(found.where("other is not null").select(node("rep", "cid").alias("a"), node("other_rep", "other").alias("b")))
    roots = joined.select(F.col("node.cid").alias("cid"), F.col("root.rep").alias("root"))
    known = classes.select("cid", "print", "m", "rep").join(links, "cid", "left").join(roots, "cid", "left")
    known = known.select("print", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.nullif(F.coalesce("root", "rep"), F.lit(NOBODY)).alias("component_id"))
    known = written(known, "known")
    copied = F.col("m") > max(side, rows.count() // SHARE)
    few = F.broadcast(known.where(copied))
    out = rows.select("vec_id", "print")
    many = out.join(few, "print")
    others = out.join(few.select("print"), "print", "left_anti").join(known.where(~copied), "print", "left")
    both = many.unionByName(others).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("m").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_vector_links(spark, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
