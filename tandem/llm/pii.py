"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

1. Candidates: the base patterns (email, ip, card, phone: leftmost non-overlapping, checked, no
   retries) and wider ones (spelled-out addresses, national phone numbers, account numbers,
   matches that fail a check). Labelers look at each: format (strict pattern), checksum, gazetteer
   (known domains, prefixes, country codes), context (a word of the kind shortly before), border
   (free-standing or part of a longer token). Each votes yes, no or abstains.
2. Vote patterns are counted over all documents by kind; their number is bounded by the votes'
   combinations. Expectation-maximisation over the counts gives every labeler's reliability per
   kind and the probability of each pattern (Dawid-Skene with abstentions).
3. Those probabilities train a logistic span classifier on votes and shape. A candidate beyond
   the base ones becomes a span when the classifier gives it THRESHOLD or more.

Base spans always stay; the method only adds. Positions count code points, ends are exclusive.
Null text is empty and has no spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written
from .secrets import digest

KINDS = ("email", "ip", "card", "phone", "account")
BASE = 4
THRESHOLD = 0.9
REACH = 40

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED_HOST = r"(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]+)+"
SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\x20?" + SPELLED_HOST, re.IGNORECASE)
#: The end of every match of SPELLED; cheap to look for.
TRIGGER = re.compile(SPELLED_HOST, re.IGNORECASE)
NATIONAL = re.compile(r"(?:\([0-9]{3}\)\x20?|\b[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}\b")
ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b")
DIGIT = re.compile(r"[0-9]")
#: What the gazetteer knows per kind, and words that announce a kind.
KNOWN = {
    "email": re.compile(r"\b(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)\Z", re.IGNORECASE),
    "ip": re.compile(r"(?:10|127|172|192|8|1|23|34|52)\."),
    "card": re.compile(r"(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"),
    "phone": re.compile(r"\+?(?:1|33|34|44|49)\b|\([2-9]"),
    "account": re.compile(r"(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU)"),
}
NEAR = {
    "email": re.compile(r"e-?mail|contact|write|reach|correo|courriel", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server|adresse", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.IGNORECASE),
    "phone": re.compile(r"phone|\btel|call|mobile|fax|telefon|t[eé]l[eé]fono", re.IGNORECASE),
    "account": re.compile(r"iban|account|konto|compte|cuenta", re.IGNORECASE),
}


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@label(.label)+: each @ reaches back to where the last match ended."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def candidates(text: str) -> list[tuple[int, int, int, bool, bool, bool]]:
    """(start, kind number, end, base, strict format, checksum) of all candidates."""
    found = []
    if "@" in text:
        found += [(s, 0, e, True, True, True) for s, e in emails(text)]
    if TRIGGER.search(text):
        found += [(m.start(), 0, m.end(), False, "(" in m[0] or "[" in m[0] or "{" in m[0], False) for m in SPELLED.finditer(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        ok = all(len(p) < 400 and int(p) <= 255 for p in m[0].split("."))
        found.append((m.start(), 1, m.end(), ok, ok, ok))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            ok = luhn(digits)
            found.append((m.start(), 2, m.end(), ok, True, ok))
    base_phones = []
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 9 <= n <= 15:
                base_phones.append((m.start(), 3, m.end(), True, True, n >= 10))
    found += base_phones
    found += [(m.start(), 3, m.end(), False, True, False) for m in NATIONAL.finditer(text) if not any(s < m.end() and e > m.start() for s, _, e, *_ in base_phones)]
    for m in ACCOUNT.finditer(text):
        ok = mod97(m[0])
        found.append((m.start(), 4, m.end(), False, ok, ok))
    return found


def votes(text: str, start: int, kind: int, end: int, strict: bool, check: bool) -> tuple[int, ...]:
    """format, checksum, gazetteer, context, border: 1 yes, 0 abstains, -1 no."""
    name, body = KINDS[kind], text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    free = not (before.isalnum() or after.isalnum() or before in ("/", "=", "_") or after in ("/", "=", "_"))
    known = KNOWN[name].search(body) if kind == 0 else KNOWN[name].match(body)
    return (1 if strict else -1, 1 if check else (0 if kind in (0, 3) else -1), 1 if known else 0, 1 if NEAR[name].search(text, max(0, start - REACH), start) else 0, 1 if free else -1)


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("code", pa.string())]))


def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates of a text; ``code`` holds kind, votes and shape."""
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            out = []
            for s, k, e, base, strict, check in sorted(candidates(text)):
                shape = (min(7, (e - s) // 4), sum(c.isdigit() for c in text[s:e]) * 4 // (e - s))
                out.append({"kind": KINDS[k], "start": s, "end": e, "base": base, "code": ",".join(map(str, (k, *votes(text, s, k, e, strict, check), *shape)))})
            rows.append(out)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, FOUND)], names=["doc_id", "found"])


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns of one kind: the probability of yes per pattern, and P(vote | yes), P(vote | no)."""
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    p = np.clip(0.5 + 0.15 * patterns.sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        given = []
        for w in (p * counts, (1 - p) * counts):
            table = (one_hot * w[:, None, None]).sum(axis=0) + 1.0
            given.append(table / table.sum(axis=1, keepdims=True))
        prior = np.clip((p * counts).sum() / counts.sum(), 0.01, 0.99)
        yes, no = (np.log(g)[None] for g in given)
        odds = np.log(prior / (1 - prior)) + ((yes - no) * one_hot).sum(axis=(1, 2))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, given[0], given[1]


def features(codes: np.ndarray) -> np.ndarray:
    kind, vote, shape = codes[:, 0], codes[:, 1:6], codes[:, 6:]
    return np.hstack([np.eye(len(KINDS))[kind], vote == 1, vote == -1, np.eye(8)[shape[:, 0]], np.eye(5)[np.minimum(shape[:, 1], 4)]]).astype(float)


def train(codes: np.ndarray, counts: np.ndarray) -> dict[str, float]:
    """The classifier's probability for each code."""
    soft = np.empty(len(codes))
    for k in range(len(KINDS)):
        own = codes[:, 0] == k
        if own.any():
            soft[own] = reliabilities(codes[own, 1:6], counts[own])[0]
    x, w = features(codes), np.zeros(features(codes[:1]).shape[1])
    for _ in range(40):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (counts * (soft - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {",".join(map(str, c)): float(v) for c, v in zip(codes, p, strict=True)}


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the spans (kind, start, end, base, score) of every text, by start, then kind as in KINDS."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    labelled = written(texts.mapInArrow(label, "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean,code:string>>"), "labelled")
    patterns = labelled.select(F.explode("found.code").alias("code")).groupBy("code").count().orderBy("code").toPandas()
    scores: dict[str, float] = {}
    if len(patterns):
        codes = np.array([[int(v) for v in c.split(",")] for c in patterns.code])
        scores = train(codes, patterns["count"].to_numpy(float))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column("found").to_pylist():
                base = [f for f in found if f["base"]]
                extra = [f for f in found if not f["base"] and scores[f["code"]] >= threshold and not any(b["start"] < f["end"] and b["end"] > f["start"] for b in base)]
                both = sorted(base + extra, key=lambda f: (f["start"], KINDS.index(f["kind"])))
                rows.append([{"kind": f["kind"], "start": f["start"], "end": f["end"], "base": f["base"], "score": scores[f["code"]]} for f in both])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return labelled.mapInArrow(decide, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")


def op10_weak_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    return found.select("doc_id", *digest(found, KINDS[:BASE], flagged=True))
