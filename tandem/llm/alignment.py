"""Alignment of two tokenizers over a corpus, by a cogroup of postings.

Each text is encoded by A (space + text) and by B (text; B adds the space). Byte offsets where tokens of
both end cut the text into groups; an A and a B token are linked where they share a group. The count of a pair of
ids is how many documents hold it linked; a link is a best one where no other partner of its A id has a higher
count anywhere.

1. A task encodes texts, aligns some hundred kilobytes of them at a time by arrays over byte offsets, and packs
   blocks of documents: digests, and the postings, which are each document's distinct pairs of ids with how often they
   are linked in it (multiplicities), seven bytes each as a rule. Blocks are written to the shared folder once.
2. Counts of pairs: each task merges the pairs of several blocks before its rows are shuffled; sums by pair, then the
   maximum per A id (an id has at most as many partners as B has ids).
3. Postings are shuffled by side id: part = A id mod PARTS. The counts of a part come first in its sorted
   stream, then its postings, a block at a time, which are looked up and reduced to one pair of sums per
   document and block on the spot; sorting spills, and no task holds more than the counts of a part and one block.
   A part whose postings are many is dealt out by block over several tasks, to each of which go all its
   counts; the postings per task are at least SPREAD times the counts, so that the copies stay a small share.
4. Sums of the PARTS parts are added up per block, beside the block's digests.

The counts of a part are bounded by the vocabularies: 50,257 x 32,000 / PARTS pairs, whatever the corpus.

Texts that are null or empty, or whose joined token bytes aren't space + text on both sides, have no tokens: zeros, and ''
for the digest of groups. Strings of special tokens in a text are plain text. Long texts are encoded whole.
A group of many tokens is linked by distinct ids and their products, so a long run without a common end makes no
quadratic number of pairs. Rows repeated under one doc_id, and rows without one, are documents each. An empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, raw, written

PARTS = 64
#: Postings of a block, about, and bytes of text that are aligned at a time. A cell of a block stays below half a megabyte,
#: from which on the JVM lays objects out apart.
BLOCK = 80_000
CHUNK = 200_000
#: Blocks of a row group. Readers and compression hold whole row groups or pages, whose sizes Parquet looks at only after a hundred rows.
GROUP = 8
#: Distinct pairs that a task merges before it hands on their counts.
MERGED = 1_500_000
#: Postings of a part that stay in one task: so many at least, and SPREAD for each of its counts.
TOGETHER = 1_000_000
SPREAD = 32
#: A group is expanded link by link while it has at most so many times its tokens in links.
WIDE = 8
#: An id pair as one number: A id above, 15 bits of B id below.
B_BITS, PAIR_BITS = 15, 31
#: The number of a document in its block.
DOC = "<u2"

DIGESTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = "block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in DIGESTS) + ", groups_sha256 array<string>, docs binary, pairs binary, times binary"
RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in DIGESTS) + ", n_best long, count_sum long, groups_sha256 string"


def vocabularies() -> tuple[str, str]:
    """The default files: ranks of the byte-level vocabulary of byte_bpe_50k.json, and the piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Sides:
    """Both tokenizers, the bytes of their ids, and the texts of ids with what may follow them in a digest."""

    def __init__(self, ranks: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        # same ids as the library that reads byte_bpe_50k.json, in a third of its time; no string is special
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.a_bytes[rank] = token
        n = self.b.vocab_size()
        if n > 1 << B_BITS or len(self.a_bytes) > 1 << (PAIR_BITS - B_BITS):
            raise ValueError("a vocabulary is too large for packed pairs")
        as_byte = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)])  # noqa: E731  of a piece <0xHH>
        self.b_bytes = [as_byte(i) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        #: a token of A before another of its group, or last in it; then the same of B
        self.named = [f"{i}{mark}" for side, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(side))]

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where either side's bytes aren't the text's."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        out = []
        for data, text, b in zip(texts, plain, self.b.encode(plain, num_threads=1), strict=True):
            a = self.a.encode_ordinary(" " + text) if data else []
            whole = b" " + data
            same = bool(data) and b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out


SIDES: dict[tuple[str, str], Sides] = {}


def sides(paths: tuple[str, str]) -> Sides:
    """One per Python worker; workers are used again by later tasks."""
    if paths not in SIDES:
        SIDES[paths] = Sides(*paths)
    return SIDES[paths]


def linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, pairs, times), by document and pair, of tokens in groups; ``doc`` is each group's document."""
    first_b = np.cumsum(n_b) - n_b
    links = n_a * n_b
    wide = links > WIDE * (n_a + n_b)
    some = ~wide[group_a]
    a_some, g = a[some], group_a[some]
    times = n_b[g]
    at = np.repeat(first_b[g] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    keys = [np.repeat((doc[g] << PAIR_BITS) | (a_some << B_BITS), times) | b[at]]
    counts = [np.ones(len(at), np.int64)]
    first_a = np.cumsum(n_a) - n_a
    for k in np.flatnonzero(wide).tolist():
        x, x_times = np.unique(a[first_a[k] : first_a[k] + n_a[k]], return_counts=True)
        y, y_times = np.unique(b[first_b[k] : first_b[k] + n_b[k]], return_counts=True)
        keys.append(((doc[k] << PAIR_BITS) | (x[:, None] << B_BITS) | y[None, :]).ravel())
        counts.append((x_times[:, None] * y_times[None, :]).ravel())
    key = np.concatenate(keys)
    if len(keys) == 1:
        key.sort()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        total = np.diff(np.append(starts, len(key)))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        total = np.add.reduceat(np.concatenate(counts)[order], starts)
    key = key[starts]
    return key >> PAIR_BITS, key & ((1 << PAIR_BITS) - 1), total


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between ``bounds``."""
    return np.diff(np.append(0, np.cumsum(values))[bounds])


def align(texts: list[bytes], s: Sides) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Digests per text, digests of the groups, and the postings (text, pair, times)."""
    ids = s.encode(texts)
    count_a, count_b = (np.array([len(x[side]) for x in ids], np.int64) for side in (0, 1))
    a, b = (np.fromiter((i for x in ids for i in x[side]), np.int64, int(n.sum())) for side, n in ((0, count_a), (1, count_b)))
    end_a, end_b = np.cumsum(s.a_sizes[a]), np.cumsum(s.b_sizes[b])
    size = int(end_a[-1]) + 1 if len(end_a) else 1
    marks = np.zeros((2, size), bool)
    marks[0, end_a], marks[1, end_b] = True, True
    close_a, close_b = marks[1, end_a], marks[0, end_b]
    group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
    groups = int(close_a.sum())
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    bounds_a = np.append(0, np.cumsum(count_a))
    n_groups = per_doc(close_a, bounds_a)
    doc = np.repeat(np.arange(len(texts)), n_groups)
    bounds = np.append(0, np.cumsum(n_groups))
    digests = {"n_a": count_a, "n_b": count_b, "n_groups": n_groups, "n_links": per_doc(n_a * n_b, bounds)}
    # tokens in the order of the digest: of each group those of A, then those of B
    place_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(n_a)[group_b]
    order = np.empty(len(a) + len(b), np.int64)
    order[place_a] = a + close_a * len(s.a_bytes)
    order[place_b] = b + close_b * len(s.b_bytes) + 2 * len(s.a_bytes)
    named, cuts = list(map(s.named.__getitem__, order.tolist())), np.append(0, np.cumsum(count_a + count_b)).tolist()
    shas = ["" if lo == hi else hashlib.sha256("".join(named[lo:hi])[:-1].encode()).hexdigest() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return digests, shas, linked(a, b, group_a, group_b, n_a, n_b, doc)


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes each as the largest takes: 1, 2, 4 or 8."""
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if values.max(initial=0) <= np.iinfo(t).max))


def packed(paths: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, task, made = sides(paths), TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            starts = np.cumsum([0] + [len(shas) for _, shas, _ in held])
            # fewer than 40,000 documents
            docs = np.concatenate([p[0] + lo for (_, _, p), lo in zip(held, starts, strict=False)]).astype(DOC)
            pairs = np.concatenate([p[1] for _, _, p in held]).astype("<u4")
            times = narrow(np.concatenate([p[2] for _, _, p in held]))
            lists = [ids, *(np.concatenate([d[c] for d, _, _ in held]) for c in DIGESTS)]
            cols = [pa.array([(task << 32) | made], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in lists), pa.array([[x for _, shas, _ in held for x in shas]], pa.list_(pa.string()))]
            cols += [pa.array([x.tobytes()], pa.binary()) for x in (docs, pairs, times)]
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in BLOCKS.split(", ")])

        def portions() -> Iterator[tuple[list, list[bytes]]]:
            names, texts, size = [], [], 0
            for batch in batches:
                # a text at a time: a batch holds thousands of whole texts
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), (x.as_py() for x in batch.column("text")), strict=True):
                    names.append(doc_id)
                    texts.append(text)
                    size += len(text)
                    if size >= CHUNK or len(texts) >= 20_000:
                        yield names, texts
                        names, texts, size = [], [], 0
            if texts:
                yield names, texts

        for names, texts in portions():
            ids += names
            held.append(align(texts, s))
            if sum(len(p[0]) for _, _, p in held) >= BLOCK or len(ids) >= 20_000:
                yield row()
                made, ids, held = made + 1, [], []
        if held:
            yield row()

    return run


def numbers(cell: pa.Scalar, dtype: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype)


def multiplicities(cell: pa.Scalar, n: int) -> np.ndarray:
    """What :func:`narrow` has made of ``n`` numbers, as it is."""
    return numbers(cell, f"<u{cell.as_buffer().size // n if n else 1}")


def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): in how many documents of some blocks a pair is linked."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((pairs >> B_BITS).astype(np.int32)), pa.array((pairs & ((1 << B_BITS) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    held, size = [], 0
    for batch in batches:
        for cell in batch.column("pairs"):
            held.append(numbers(cell, "<u4").copy())
            size += len(held[-1])
            if size >= MERGED:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, n, best), by part and pair, as chunks of arrays."""
    for batch in batches:
        a, b, n, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n", "best"))
        part = a % PARTS
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
        pairs = ((a.astype(np.uint32) << np.uint32(B_BITS)) | b.astype(np.uint32)).astype("<u4")
        # the sign tells whether a count is its A id's highest
        signed = np.where(best, n, -n).astype("<i8")
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(part[lo]) for lo, _ in spans], pa.int32()), pa.array([pairs[lo:hi].tobytes() for lo, hi in spans], pa.binary()), pa.array([signed[lo:hi].tobytes() for lo, hi in spans], pa.binary())], names=["part", "pairs", "counts"]
        )


STREAM = "part int, salt int, block long, docs binary, pairs binary, counts binary"


def postings(salts: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each block's postings by part; a part of several ``salts`` is dealt by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *cells in zip(batch.column("block").to_pylist(), *(batch.column(c) for c in ("docs", "pairs", "times")), strict=True):
                docs, pairs = numbers(cells[0], DOC), numbers(cells[1], "<u4")
                times = multiplicities(cells[2], len(docs))
                part = (pairs >> np.uint32(B_BITS)) % PARTS
                order = np.argsort(part, kind="stable")
                cuts = np.append(0, np.cumsum(np.bincount(part, minlength=PARTS))).tolist()
                full = [k for k in range(PARTS) if cuts[k] < cuts[k + 1]]
                cut = lambda x: pa.array([x[order[cuts[k] : cuts[k + 1]]].tobytes() for k in full], pa.binary())  # noqa: B023, E731
                mixed = (block * 0x9E3779B97F4A7C15) % (1 << 64) >> 20
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([mixed % salts.get(k, 1) for k in full], pa.int32()), pa.array([block] * len(full), pa.int64()), cut(docs), cut(pairs), cut(times)], names=[c.split()[0] for c in STREAM.split(", ")]
                )

    return run


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted stream, per part and salt its counts (without block) and then its postings, to sums per document."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "docs", "best", "total"])

    at, pairs, counts, waiting = None, np.empty(0, np.uint32), np.empty(0, np.int64), []
    for batch in batches:
        out: list[tuple] = []
        for part, salt, block, docs, key, n in zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "block")), *(batch.column(c) for c in ("docs", "pairs", "counts")), strict=True):
            if (part, salt) != at:
                at, waiting, pairs = (part, salt), [], np.empty(0, np.uint32)
            if block is None:
                waiting.append((numbers(key, "<u4").copy(), numbers(n, "<i8").copy()))
                continue
            if waiting:
                pairs, counts = (np.concatenate(x) for x in zip(*waiting, strict=True))
                order = np.argsort(pairs)
                pairs, counts, waiting = pairs[order], counts[order], []
            found, doc = counts[np.searchsorted(pairs, numbers(key, "<u4"))], numbers(docs, DOC)
            times = multiplicities(n, len(doc)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            best, total = np.add.reduceat(times * (found > 0), starts), np.add.reduceat(times * np.abs(found), starts)
            out.append((block, doc[starts].tobytes(), best.tobytes(), total.tobytes()))
            if len(out) == 200:
                yield rows(out)
                out = []
        if out:
            yield rows(out)


def summed(digests: pa.Table, found: pa.Table) -> pa.Table:
    """A block's documents with their digests and the sums of all parts."""
    cols = {c: digests.column(c).combine_chunks().flatten() for c in ("doc_id", *DIGESTS, "groups_sha256")}
    best, total = np.zeros((2, len(cols["doc_id"])), np.int64)
    for docs, x, y in zip(*(found.column(c) for c in ("docs", "best", "total")), strict=True):
        doc = numbers(docs, DOC)
        best[doc] += numbers(x, "<i8")
        total[doc] += numbers(y, "<i8")
    made = cols | {"n_best": pa.array(best), "count_sum": pa.array(total)}
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.Table.from_arrays([made[c] for c in names], names=names)


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; doc_id and text are read."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("text"))
    blocks = written(texts.mapInArrow(packed(paths or vocabularies()), BLOCKS), "blocks", **{"parquet.block.row.count.limit": GROUP})
    pairs = blocks.select("pairs").mapInArrow(documents_with, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = written(pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))), "counts")
    # PARTS rows
    sizes = counts.groupBy((F.col("a") % PARTS).alias("part")).agg(F.sum("n").alias("postings"), F.count("*").alias("counts")).collect()
    salts = {r.part: -(-r.postings // max(TOGETHER, SPREAD * r.counts)) for r in sizes}
    several = F.create_map(*(F.lit(x) for k, n in salts.items() if n > 1 for x in (k, n))) if max(salts.values(), default=1) > 1 else F.create_map().cast("map<int,int>")
    chunks = counts.repartition((F.col("a") % PARTS)).sortWithinPartitions(F.col("a") % PARTS, "a", "b").mapInArrow(count_chunks, "part int, pairs binary, counts binary")
    first = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.try_element_at(several, "part"), F.lit(1)) - 1)))
    first = first.select("part", "salt", F.lit(None).cast("long").alias("block"), F.lit(b"").alias("docs"), "pairs", "counts")
    stream = first.unionByName(blocks.select("block", "docs", "pairs", "times").mapInArrow(postings(salts), STREAM))
    dealt = stream.repartition("part", "salt").sortWithinPartitions("part", "salt", "block")
    found = dealt.mapInArrow(looked_up, "block long, docs binary, best binary, total binary")
    digests = blocks.drop("docs", "pairs", "times")
    return digests.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(summed, RESULT)


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))
