"""Token-id output, compressed by Re-Pair grammars (after Larsson and Moffat 1999).

Documents are dealt out by ranges of doc_id and sorted, so the files are in ascending order of
doc_id. A shard is a range; it is cut into blocks of about BLOCK tokens. Per block, frequent pairs
of ids are repeatedly replaced by nonterminals: every round counts all neighbouring pairs, makes
rules of the most frequent ones and replaces their occurrences from left to right (a batch of at
most RULES_A_ROUND rules a round, rather than one), until no pair comes LEAST_COUNT times in the
block or the 16-bit symbols are used up. No pair crosses a document's end, so each document has its own
run of symbols. A block holds its rules, every symbol's expansion length and where each document
starts, so any token range of any document can be decoded without the rest.

Block layout, little-endian: magic RPG2; counts of rules, documents and symbols (3 x uint32);
rules (2 x uint16 each); expansion lengths (uint32 each); per document doc_id (int64), first
symbol (uint32), tokens (uint32), 1 if doc_id is null (uint8); symbols (uint16 each). Ids below BASE are
tokens, the others rules. Blocks are rows (shard, block, tokens, payload) of Parquet files, which
Spark's writer commits as a whole, so a lost executor leaves no broken file.

Null text is empty and holds the end id alone. Rows without doc_id come first. Rows repeated under
one doc_id are written as often as they come, ordered by a hash of the text and the text, so reruns agree. Special
tokens that stand in a text become their ids, as the library has it. A text is never split between
blocks, however long. An empty table gives files without blocks; other columns are not read.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir

END = 2
#: Ids below it are tokens; 16-bit symbols leave the rest for rules.
BASE = 50_257
BLOCK = 1 << 20
RULES_A_ROUND = 4096
LEAST_COUNT = 64
MAGIC = b"RPG2"
#: Pieces of text whose ids a worker keeps: so many at least, and twice as many at most.
CACHE = 150_000
#: Letters below it are letters in all versions of Unicode.
LATIN = "\u0250"
MARKS = '.,;:!?&*%$#|"()'
#: How the byte-level alphabet writes a space.
SPACE = "\u0120"
#: Bytes of texts that are cut at a time (a longer text by itself).
CHUNK = 4_000_000

#: A document's entry in a block.
DOC = np.dtype([("id", "<i8"), ("first", "<u4"), ("tokens", "<u4"), ("null", "u1")])
BLOCKS = "shard int, block int, tokens long, payload binary"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if visible, else the next one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def as_bytes(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


class Encoder:
    """Encodes texts piece by piece.

    The byte-level pre-tokenizer never joins anything across a single space or line end between two
    visible characters, so a text's ids are those of its pieces, each with the space or line end before
    it; a piece is encoded by the library once. Texts where white space meets a cut are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these are encoded whole, as the library treats them by itself.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > BASE:
            raise ValueError(f"the vocabulary has more than {BASE} ids")
        self.line_end = as_bytes(self.tokenizer.encode("\n", add_special_tokens=False).ids)
        self.letters, self.model = byte_letters(), self.tokenizer.model
        latin = "".join(c for c in map(chr, range(ord(LATIN) if self.tokenizer.normalizer is None else 0x80)) if c.isalpha())
        #: A line end or nothing, Latin letters, marks.
        self.simple = re.compile(rf"(\n?)([{re.escape(latin)}]+)([{re.escape(MARKS)}]*)").fullmatch
        self.id_bytes = [k.to_bytes(2, sys.byteorder) for k in range(BASE)]
        #: Ids by piece, empty where white space meets a cut; those of before are kept for one turn more.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [as_bytes(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces; one that starts a line has the line end before it, the others a space.

        Most pieces are letters, perhaps with marks after them. The pre-tokenizer cuts letters from marks as well, and Latin
        letters are one piece for it too, so they go to the model at once.
        """
        known, before, ends, tokenize, table = self.known, self.before, self.ends, self.model.tokenize, self.id_bytes
        others = []
        for p in pieces:
            found = self.simple(p)
            if found is None:
                others.append(p)
                continue
            start, word, marks = found.groups()
            head = start + word if marks else p
            ids = known.get(head) if marks else None
            if ids is None:
                ids = before.get(head) if marks else None
                if ids is None:
                    spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                    ids = b"".join([table[x.id] for x in tokenize(spelled if start else SPACE + spelled)])
                    ids = self.line_end + ids if start else ids
                known[head] = ids
            if marks:
                end = ends.get(marks)
                if end is None:
                    end = ends[marks] = self.library([marks])[0]
                known[p] = ids + end
        if others:
            self.learn_others(others)

    def learn_others(self, pieces: list[str]) -> None:
        cut = []
        for p in pieces:
            body = p[1:] if p[0:1] == "\n" else p
            if not body or body[0].isspace() or body[-1].isspace():
                self.known[p] = b""
            else:
                cut.append(p)
        for p, ids in zip(cut, self.library([p[1:] if p[0] == "\n" else " " + p for p in cut]), strict=True):
            self.known[p] = self.line_end + ids if p[0] == "\n" else ids

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        if len(self.known) > CACHE:
            self.before, self.known, self.ends = self.known, {}, {}
        known, before = self.known, self.before
        ids = list(map(known.get, pieces))
        new = []
        for k, x in enumerate(ids):
            if x is None:
                p = pieces[k]
                x = before.get(p)
                if x is None:
                    new.append(k)
                else:
                    known[p] = ids[k] = x
        self.learn([pieces[k] for k in new])
        for k in new:
            ids[k] = known[pieces[k]]
        return ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and the end id.

        Arrow cuts the texts and numbers the different pieces; numpy puts the pieces' ids together.
        """
        if not len(texts):
            return []
        whole = np.zeros(len(texts), bool)
        for mark in self.special:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        # a line end stays with the piece after it, and every text begins with one, which is left out again
        lines = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        cut = pc.split_pattern(lines, " ")
        first = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat = np.frombuffer(b"".join(ids), np.uint16)
        n = sizes[at]
        whole |= np.minimum.reduceat(n, first[:-1]) == 0
        ends = np.cumsum(n)
        shift = (np.cumsum(sizes) - sizes)[at] - (ends - n)
        tokens = flat[np.arange(int(ends[-1])) + np.repeat(shift, n)]
        bounds = np.append(0, ends)[first].tolist()
        skip, end = len(self.line_end) // 2, np.array([END], np.uint16)
        out = []
        for k, (lo, hi, w) in enumerate(zip(bounds[:-1], bounds[1:], whole.tolist(), strict=True)):
            own = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint16) if w else tokens[lo + skip : hi]
            out.append(np.concatenate([own, end]))
        return out


#: One encoder per Python worker; workers are used again by later tasks.
ENCODERS: dict[str, Encoder] = {}


def chosen_pairs(sym: np.ndarray, inner: np.ndarray, room: int) -> np.ndarray:
    """The most frequent neighbours (as left << 16 | right) within documents, LEAST_COUNT times or more, at most a round's rules."""
    pairs = np.sort(((sym[:-1].astype(np.uint32) << np.uint32(16)) | sym[1:])[inner])
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    counts = np.diff(np.append(starts, len(pairs)))
    often = np.flatnonzero(counts >= LEAST_COUNT)
    return pairs[starts[often[np.argsort(-counts[often], kind="stable")][: min(RULES_A_ROUND, room)]]]


def repair(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (two symbols each) and where each document ends, from ids and ends (exclusive).

    Goes on until no pair is left that comes LEAST_COUNT times, or no symbol is free.
    """
    sym, rules = ids.copy(), np.empty((0, 2), np.uint16)
    while len(sym) > 1:
        inner = np.ones(len(sym) - 1, bool)
        inner[ends[:-1] - 1] = False
        chosen = chosen_pairs(sym, inner, (1 << 16) - BASE - len(rules))
        if not len(chosen):
            break
        left, right = (chosen >> np.uint32(16)).astype(np.uint16), (chosen & np.uint32(0xFFFF)).astype(np.uint16)
        # the rule of a pair stands in a table of the left symbols and the right symbols that have any; 0 is none
        rows, cols = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.uint16)
        lefts, rights = np.unique(left), np.unique(right)
        rows[lefts], cols[rights] = np.arange(1, len(lefts) + 1), np.arange(1, len(rights) + 1)
        table = np.zeros((len(lefts) + 1, len(rights) + 1), np.uint16)
        table[rows[left], cols[right]] = BASE + len(rules) + np.arange(len(chosen))
        number = table[rows[sym[:-1]], cols[sym[1:]]]
        at = np.flatnonzero((number > 0) & inner)
        # matches that overlap form runs of neighbours; every other one is taken
        begins = np.flatnonzero(np.append(True, np.diff(at) != 1)[: len(at)])
        at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
        sym[at] = number[at]
        rules = np.vstack([rules, np.column_stack([left, right])])
        ends = ends - np.searchsorted(at, ends - 1)
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym = sym[keep]
    return sym, rules, ends


def lengths_of(rules: np.ndarray) -> np.ndarray:
    """Expansion length per symbol number; a rule uses earlier symbols only."""
    out = np.ones(BASE + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[BASE + k] = out[a] + out[b]
    return out


def pack(doc_ids: list, texts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(texts)
    ends = np.cumsum([len(t) for t in texts])
    sym, rules, closed = repair(ids, ends)
    docs = np.zeros(len(texts), DOC)
    docs["id"], docs["null"] = [d or 0 for d in doc_ids], [d is None for d in doc_ids]
    docs["first"], docs["tokens"] = np.append(0, closed[:-1]), np.diff(ends, prepend=0)
    head = np.array([len(rules), len(texts), len(sym)], "<u4")
    return MAGIC + head.tobytes() + rules.astype("<u2").tobytes() + lengths_of(rules)[BASE:].astype("<u4").tobytes() + docs.tobytes() + sym.astype("<u2").tobytes()


class Reader:
    """Random access to the documents of a block."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n_rules, n_docs, n_sym = np.frombuffer(payload, "<u4", 3, 4).tolist()
        at = 16
        self.rules = np.frombuffer(payload, "<u2", 2 * n_rules, at).reshape(-1, 2)
        self.lengths = np.append(np.ones(BASE, np.int64), np.frombuffer(payload, "<u4", n_rules, at := at + 4 * n_rules))
        self.docs = np.frombuffer(payload, DOC, n_docs, at := at + 4 * n_rules)
        self.symbols = np.frombuffer(payload, "<u2", n_sym, at + DOC.itemsize * n_docs)
        self.starts = np.zeros(BASE + n_rules, np.int64)
        parts, size = [np.arange(BASE, dtype=np.uint16)], BASE
        self.starts[:BASE] = np.arange(BASE)
        flat = np.empty(BASE + int(self.lengths[BASE:].sum()), np.uint16)
        flat[:BASE] = parts[0]
        for k, (a, b) in enumerate(self.rules.tolist()):
            self.starts[BASE + k] = size
            for x in (a, b):
                n = self.lengths[x]
                flat[size : size + n] = flat[self.starts[x] : self.starts[x] + n]
                size += n
        self.flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        shift = self.starts[symbols] - (np.cumsum(n) - n)
        return self.flat[np.arange(int(n.sum())) + np.repeat(shift, n)]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens start to stop of the k-th document; only the symbols that reach there are expanded."""
        lo, hi = int(self.docs["first"][k]), int(self.docs["first"][k + 1]) if k + 1 < len(self.docs) else len(self.symbols)
        ends = np.cumsum(self.lengths[self.symbols[lo:hi]])
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.empty(0, np.uint16)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[lo + a : lo + b])[start - before : stop - before]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, as many at a time as have CHUNK bytes of text, one at least."""
    lo, size = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if size + n > CHUNK and k > lo:
            yield batch.slice(lo, k - lo)
            lo, size = k, 0
        size += n
    yield batch.slice(lo)


def encode_blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ENCODERS.setdefault(path, None) or ENCODERS.update({path: Encoder(path)}) or ENCODERS[path]
        shard, block, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([pack(ids, texts)], pa.binary())], names=["shard", "block", "tokens", "payload"])

        for batch in batches:
            for part in parts(batch):
                for doc_id, tokens in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                    ids.append(doc_id)
                    texts.append(tokens)
                    size += len(tokens)
                    if size >= BLOCK:
                        yield row()
                        block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the token ids of all texts (columns doc_id, text) to ``path``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows of one doc_id are ordered by text; the last key only deals equal rows out, so any order among them is the same
    keys = ("doc_id", "hash", "text", "row")
    ordered = texts.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange("doc_id", "hash", "row").sortWithinPartitions(*keys[:3]).select("doc_id", "text")
    ordered.mapInArrow(encode_blocks(vocabulary or vocabulary_path()), BLOCKS).write.parquet(path)


def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, block, payload in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            reader = Reader(payload.as_py())
            docs, ids = reader.docs, reader.expand(reader.symbols).astype("<u4")
            ends = np.cumsum(docs["tokens"].astype(np.int64))
            starts = ends - docs["tokens"]
            k = len(docs)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(k, shard, np.int32)),
                    pa.array(np.full(k, block, np.int32)),
                    pa.array(docs["id"].astype(np.int64), mask=docs["null"] == 1),
                    pa.array(starts),
                    pa.array(docs["tokens"].astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ],
                names=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files at ``path``."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    up_to = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("tokens").over(w), F.lit(0))
    # one row per shard here
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens")).select("shard", before(up_to("shard")).alias("shard_start"))
    places = blocks.select("shard", "block", before(up_to("shard", "block")).alias("block_start")).join(shards, "shard")
    docs = blocks.select("shard", "block", "payload").mapInArrow(decode, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenised(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tandem-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_tokens(spark, path)


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    return tokenised(documents(spark, sf_dir))
