"""Vector links, source divergence and tokenizer alignment against brute force."""

import hashlib
import math
import tracemalloc
from collections import defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tandem.llm import alignment, vectors
from tandem.llm.alignment import aligned
from tandem.llm.divergence import divergence
from tandem.llm.queries import ORACLE_SQL, QUERIES
from tandem.llm.vectors import agree, sizes_of, vector_links

# ---- vectors

VECTORS = "vec_id long, embedding array<double>, label int, print string, m int"


def every_link(rows):
    """Links of all pairs, and the least vec_id of each component, by depth-first search."""
    fits = lambda r: r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])
    scaled = [np.array(r[1], float) / max(map(abs, r[1])) if fits(r) else None for r in rows]
    unit = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    near = [[k for k in range(len(rows)) if k != i and u is not None and unit[k] is not None and rows[k][2] == rows[i][2] and len(unit[k]) == len(u) and float(u @ unit[k]) >= 0.98] for i, u in enumerate(unit)]
    least = [None] * len(rows)
    seen = set()
    for i in range(len(rows)):
        part, todo = [], [i] if i not in seen else []
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                part.append(a)
                todo += near[a]
        ids = [rows[a][0] for a in part if rows[a][0] is not None]
        for a in part:
            least[a] = min(ids, default=None)
    return sorted(((r[0], len(near[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows)), key=str)


def clouds(seed=5, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(40):
        centre = rng.normal(size=dims)
        for _ in range(1 + k % 5):
            rows.append((len(rows), (centre + rng.normal(size=dims) * 0.08).tolist(), k % 3, "x", 1))
    return rows


def test_vectors_link_as_all_pairs_do(spark):
    rows = clouds()
    big = np.array(rows[3][1])
    rows += [
        (900, rows[3][1], rows[3][2], "x", 1),  # a copy
        (901, (big * 7).tolist(), rows[3][2], "x", 1),  # scaled
        (902, (big * 1e200).tolist(), rows[3][2], "x", 1),  # squares overflow
        (903, (-big).tolist(), rows[3][2], "x", 1),
        (904, rows[3][1], rows[3][2] + 1, "x", 1),  # another label
        (905, rows[3][1], None, "x", 1),
        (906, None, 1, "x", 1),
        (907, [], 1, "x", 1),
        (908, [0.0] * 16, 1, "x", 1),
        (909, [float("nan")] + [1.0] * 15, 1, "x", 1),
        (910, [None] + [1.0] * 15, 1, "x", 1),
        (911, [1.0, float("inf")] + [1.0] * 14, 1, "x", 1),
        (912, rows[3][1][:8], rows[3][2], "x", 1),  # another length
        (3, rows[3][1], rows[3][2], "x", 1),  # a row again
        (3, rows[20][1], rows[20][2], "x", 1),  # another vector under the same vec_id
        (None, rows[3][1], rows[3][2], "x", 1),
        (None, rng_far(), 2, "x", 1),
        (None, None, None, "x", 1),
    ]
    table = spark.createDataFrame(rows, VECTORS)
    got = sorted((tuple(r) for r in vector_links(table).collect()), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in every_link(rows)]
    assert all(r[3] == (r[0] == r[2]) for r in got)
    assert vector_links(table.limit(0)).count() == 0


def rng_far():
    return [1.0, -1.0] * 8


def test_a_large_bucket_is_compared_by_blocks(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=12)
    rows = [(k, (centre + rng.normal(size=12) * 0.02).tolist(), 0, "x", 1) for k in range(300)]
    got = vector_links(spark.createDataFrame(rows, VECTORS), side=32).collect()
    assert {r.n_links for r in got} == {299} and {r.component_id for r in got} == {0}


def test_tables_reach_their_recall():
    assert agree(0.2, 1.0) == pytest.approx(0.8404, abs=1e-3)
    rng = np.random.default_rng(1)
    for n in (1000, 10**9):
        k, tables = sizes_of(n)
        assert 1 - (1 - agree(0.2) ** k) ** tables >= 0.98 and n * agree(math.sqrt(2)) ** k <= 0.1
    # measured: pairs at the threshold, 64 dimensions
    k, tables = sizes_of(5000)
    a, b = vectors.directions(64, k, tables)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=(2000, 64))
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    cells = [np.floor(v @ a + b).reshape(2000, tables, k) for v in (x, y)]
    assert (cells[0] == cells[1]).all(axis=2).any(axis=1).mean() > 0.96


def test_vector_query_against_all_pairs(spark, small):
    rows = [(*r, "", 0) for r in duckdb.sql(f"SELECT vec_id, embedding, label FROM '{small}/embeddings.parquet'").fetchall()]
    got = sorted((tuple(r) for r in QUERIES["op11_vector_links"](spark, small).collect()), key=str)
    assert got == every_link(rows)


# ---- divergence


def test_divergence_against_sql(spark):
    rows = [
        (1, "Apple apple pear", "en", "a", "x"),
        (2, "apple PEAR fig", "en", "b", "x"),
        (3, "apple pear, fig-fig", "en", "a", "x"),
        (3, "apple pear, fig-fig", "en", "a", "x"),
        (4, "Äpfel äpfel Apfel", "de", "a", "x"),
        (5, "Äpfel apfel", "de", "a", "x"),
        (6, "Äpfel apfel 12 !", "de", "c", "x"),
        (7, None, "en", "d", "x"),
        (8, "apple", None, "a", "x"),
        (9, "apple fig", None, None, "x"),
        (10, "", "fr", "a", "x"),
        (11, "un", "fr", "b", "x"),
        (None, "kiwi apple pear", "en", None, "x"),
        (12, "kiwi " * 3000, "en", "b", "x"),
        (13, "kiwi fig zwei", "en", "e", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string")
    frame = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    got = {tuple(r) for r in divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()}
    want = {tuple(r) for r in con.execute(ORACLE_SQL["op12_source_divergence"]).fetchall()}
    assert got == want and any(r[2] == "term" for r in got)
    # a language without kept terms has pairs of value 0
    assert {r[4] for r in got if r[0] == "fr"} == {0}
    top = [r for r in divergence(docs, top=1).collect() if r.part == "term"]
    assert all(r["rank"] == 1 for r in top) and {(r.source, r.item) for r in top if r.lang == "en"} == {(r[1], r[3]) for r in got if r[0] == "en" and r[2] == "term" and r[5] == 1}
    assert divergence(docs.limit(0)).count() == 0


def test_divergence_query_against_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op12_source_divergence"]).df()
    got = QUERIES["op12_source_divergence"](spark, small).toPandas()[list(want.columns)]
    key = ["lang", "source", "part", "rank"]
    assert len(want) and (got.sort_values(key).to_numpy() == want.sort_values(key).to_numpy()).all()


# ---- alignment


def by_hand(rows):
    """Every document alone, token by token, with the library that the byte-level vocabulary is published for."""
    import public_tokenizers
    from tokenizers import Tokenizer

    s = alignment.sides(alignment.vocabularies())
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    letters = {c: bytes([b]) for b, c in ((b, chr(b) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD) and not 0x7F <= b < 0xA1 else None) for b in range(256)) if c}
    hidden = [b for b in range(256) if bytes([b]) not in letters.values()]
    letters |= {chr(256 + k): bytes([b]) for k, b in enumerate(hidden)}
    spelled = {i: b"".join(letters[c] for c in token) for token, i in a_side.get_vocab().items() if all(c in letters for c in token)}
    out, holds = [], defaultdict(int)
    for doc_id, text in rows:
        text = text or ""
        a, b, whole = a_side.encode(" " + text, add_special_tokens=False).ids, s.b.encode(text), (" " + text).encode()
        if not text or b"".join(spelled[i] for i in a) != whole or b"".join(s.b_bytes[i] for i in b) != whole:
            a, b = [], []
        ends = [set(np.cumsum([len(size[i]) for i in ids]).tolist()) for ids, size in ((a, spelled), (b, s.b_bytes))]
        cuts = sorted(ends[0] & ends[1])
        groups = [([], []) for _ in cuts]
        for side, (ids, size) in enumerate(((a, spelled), (b, s.b_bytes))):
            at = 0
            for i in ids:
                at += len(size[i])
                groups[next(k for k, c in enumerate(cuts) if c >= at)][side].append(i)
        links = [(p, q) for x, y in groups for p in x for q in y]
        for p in set(links):
            holds[p] += 1
        digest = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(digest.encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    return sorted(((d, na, nb, ng, len(ls), sum(holds[p] == best[p[0]] for p in ls), sum(holds[p] for p in ls), h) for d, na, nb, ng, ls, h in out), key=str)


TEXTS = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "▁x y"),
    (5, "<|endoftext|> a </s> <s>"),
    (6, "中文字符 ½ é́"),
    (7, "a" * 700 + "b" * 301 + " " * 77),
    (8, "x\ty\r\n\n z\u0000"),
    (8, "x\ty"),
    (9, "👩‍👩‍👧‍👦 ok ok"),
    (10, "#" * 333),
    (None, "the cat sat on the mat"),
    (11, "the cat sat on the mat"),
    (11, "the cat sat on the mat"),
    (12, "the dog, the Hund und die Katze"),
]


def test_alignment_by_hand(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, b"x") for r in TEXTS], "doc_id long, text string, block int, pairs binary")
    want = by_hand(TEXTS)
    assert sorted((tuple(r) for r in aligned(docs).collect()), key=str) == want
    # every part dealt out over several tasks
    monkeypatch.setattr(alignment, "TOGETHER", 2)
    monkeypatch.setattr(alignment, "SPREAD", 0)
    assert sorted((tuple(r) for r in aligned(docs.repartition(5)).collect()), key=str) == want
    assert aligned(docs.limit(0)).count() == 0


def test_wide_groups_are_linked_by_distinct_ids():
    rng = np.random.default_rng(3)
    n_a, n_b = np.array([1, 40, 2, 60]), np.array([1, 50, 3, 1])
    a, b = rng.integers(0, 5, n_a.sum()), rng.integers(0, 4, n_b.sum())
    group_a, group_b, doc = np.repeat(range(4), n_a), np.repeat(range(4), n_b), np.array([0, 0, 1, 1])
    want = defaultdict(int)
    for x, g in zip(a, group_a, strict=True):
        for y, h in zip(b, group_b, strict=True):
            if g == h:
                want[int(doc[g]), int((x << 15) | y)] += 1
    got = alignment.linked(a, b, group_a, group_b, n_a, n_b, doc)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(*k, n) for k, n in sorted(want.items())]


def test_blocks_are_small_and_take_few_bytes_a_posting(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice([*"abcdefgh"], rng.integers(2, 8))) for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, 400)).encode()) for k in range(500)], "doc_id long, text binary").coalesce(1)
    blocks = docs.mapInArrow(alignment.packed(alignment.vocabularies()), alignment.BLOCKS)
    cells = blocks.select(*(F.octet_length(c).alias(c) for c in ("docs", "pairs", "times")), F.size("doc_id").alias("n")).collect()
    assert len(cells) > 1 and sum(r.n for r in cells) == 500
    # from half a megabyte on, the JVM lays an object out apart
    assert max(max(r.docs, r.pairs, r.times) for r in cells) < 512 * 1024
    assert sum(r.docs + r.pairs + r.times for r in cells) <= 7 * sum(r.pairs for r in cells) / 4


def test_row_groups_hold_few_blocks(spark, monkeypatch):
    made = []
    monkeypatch.setattr(alignment, "BLOCK", 1)
    monkeypatch.setattr(alignment, "CHUNK", 1)
    monkeypatch.setattr(alignment, "written", lambda df, label, f=alignment.written, **options: made.append(f(df, label, **options)) or made[-1])
    rows = [(k, f"the cat sat on mat {k}") for k in range(40)]
    assert sorted((tuple(r) for r in aligned(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=str) == by_hand(rows)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made[0].inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == 40 and max(groups) <= 8


def test_texts_of_a_batch_are_copied_a_few_at_a_time(monkeypatch):
    none = np.empty(0, np.int64)
    monkeypatch.setattr(alignment, "sides", lambda paths: None)
    monkeypatch.setattr(alignment, "align", lambda texts, s: ({c: np.zeros(len(texts), np.int64) for c in alignment.DIGESTS}, [""] * len(texts), (none, none, none)))
    monkeypatch.setattr(alignment.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array([b"x" * 10_000] * 4000, pa.binary())], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(len(x.column("doc_id")[0]) for x in alignment.packed(("", ""))(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and most < 4_000_000


def test_multiplicities_of_any_size(spark):
    for top, width in ((0, 1), (255, 1), (256, 2), (65_536, 4), (1 << 32, 8)):
        values = np.array([1, top], np.int64)
        cell = pa.scalar(alignment.narrow(values).tobytes(), pa.binary())
        assert cell.as_buffer().size == 2 * width
        assert alignment.multiplicities(cell, 2).tolist() == [1, top]
    # links of one pair in one document: a few, more than 255, more than 65,535
    rows = [(1, "the cat"), (2, "\u0001" * 40), (3, "#" * 9000), (4, None), (5, "中" * 300)]
    assert sorted((tuple(r) for r in aligned(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=str) == by_hand(rows)
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in aligned(nothing).collect()) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_alignment_query_by_hand(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.col("text")).collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_tokenizer_alignment"](spark, small).collect()), key=str)
    assert got == by_hand(rows)


def test_results_are_the_same_from_run_to_run(spark, small):
    for name in ("op11_vector_links", "op13_tokenizer_alignment"):
        a, b = (pd.DataFrame(QUERIES[name](spark, small).toPandas()).sort_values(by=["vec_id" if name[2:4] == "11" else "doc_id"]).reset_index(drop=True) for _ in range(2))
        pd.testing.assert_frame_equal(a, b)
