"""Held-out passages that turn up in a corpus, by winnowing.

Texts are reduced to their stream of letters and digits (case, punctuation, markup, joined letter forms, quote marks and line breaks vanish). Every passage
window of `min_words` words is then a substring of at least L characters, L being the shortest such window of the test set. Fingerprints are the minimum
hashes of all windows of w = L - k + 1 k-grams, so every shared stretch of L characters shares at least one fingerprint (Schleimer, Wilkerson
and Aiken, 2003). Hits are extended to the exact question: does the text hold `min_words` consecutive words of the passage, from word edge to word edge?

Each task holds the test set's fingerprints with their items, two numbers each, and the words of its passages; windows are only made of items that a text shares a
fingerprint with. A test set of more than `hold` words is searched in blocks of that size.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_WRAP = re.compile(r"[-‐­]\s*\n[>|\s]*")
_OTHER = re.compile(r"[^a-z0-9]+")
PRIME = 0x100000001B3


def spaced(text: str) -> str:
    """Lower-case letters and digits, runs of anything else as one blank."""
    if "&" in text or "<" in text:
        text = _TAG.sub(" ", html.unescape(text) if "&" in text else text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).replace("æ", "ae").replace("Æ", "ae").replace("œ", "oe").replace("Œ", "oe").replace("ß", "ss")
        text = text.replace("­", "").replace("​", "")
    return _OTHER.sub(" ", text.lower()).strip()


def passage_words(text: str | None) -> list[str]:
    """Words between blanks, each reduced to its letters and digits: '3.78' is the one word '378'."""
    return [w for w in (spaced(p).replace(" ", "") for p in (text or "").split()) if w]


def fingerprints(stream: bytes, k: int, w: int) -> np.ndarray:
    """Minimum k-gram hash of each window of w k-grams, distinct."""
    b = np.frombuffer(stream, np.uint8)
    if len(b) < k + w - 1:
        return np.zeros(0, np.uint64)
    return np.unique(_minima(_hashes(b, k), w))


def _hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, built from those of lengths 1, 2, 4, …"""
    with np.errstate(over="ignore"):
        part, width = b.astype(np.uint64) + np.uint64(1), 1
        out, done = None, 0
        left = k
        while left:
            if left & 1:
                if out is None:
                    out = part
                else:
                    n = min(len(out), len(part) - done)
                    out = out[:n] * np.uint64(pow(PRIME, width, 1 << 64)) + part[done : done + n]
                done += width
            left >>= 1
            if left:
                part = part[:-width] * np.uint64(pow(PRIME, width, 1 << 64)) + part[width:]
                width *= 2
        out = out[: len(b) - k + 1]
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def _minima(h: np.ndarray, w: int) -> np.ndarray:
    span = 1
    m = h
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class TestSet:
    """Test passages prepared for the search: their words, and their fingerprints with the place of the item each belongs to."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words = min_words
        held = [(i, w) for i, w in ((i, passage_words(t)) for i, t in items) if len(w) >= min_words]
        self.items, self.words = [i for i, _ in held], [" ".join(w) for _, w in held]
        length = min((sum(map(len, w[k : k + min_words])) for _, w in held for k in range(len(w) - min_words + 1)), default=0)
        self.k = max(1, length // 2)
        self.w = max(1, length - self.k + 1)
        parts = [self._prints(w) for _, w in held]
        value = np.concatenate([*(p[0] for p in parts), np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(p[0]) for p in parts])
        order = np.argsort(value, kind="stable")
        self.prints, self.owner = value[order], owner[order]
        self.first, self.last = (np.concatenate([*(p[k] for p in parts), np.zeros(0, np.int32)])[order] for k in (1, 2))

    def _prints(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints of a passage, one for each place, and the first and last of the windows that hold the whole k-gram: a shared window shares one inside it."""
        h = _hashes(np.frombuffer("".join(words).encode(), np.uint8), self.k)
        at = np.flatnonzero(np.isin(h, np.unique(_minima(h, self.w))))
        begin = np.concatenate([[0], np.cumsum([len(x) for x in words])])
        first = np.maximum(np.searchsorted(begin, at + self.k, "left") - self.min_words, 0)
        last = np.minimum(np.searchsorted(begin, at, "right") - 1, len(words) - self.min_words)
        some = first <= last
        return h[at[some]], first[some].astype(np.int32), last[some].astype(np.int32)

    def windows(self, at: int) -> list[str]:
        """Every run of min_words words of an item, joined."""
        w = self.words[at].split(" ")
        return ["".join(w[k : k + self.min_words]) for k in range(len(w) - self.min_words + 1)]


class _Text:
    """A text as a stream of letters and digits, and, once asked for, the places where words begin or end."""

    def __init__(self, text: str):
        self.text, self.stream, self.edge = text, text.replace(" ", ""), None

    def edges(self) -> set[int]:
        if self.edge is None:
            gaps = np.flatnonzero(np.frombuffer(self.text.encode(), np.uint8) == 32)
            self.edge = set((gaps - np.arange(len(gaps))).tolist()) | {0, len(self.stream)}
        return self.edge

    def holds(self, window: str) -> bool:
        at = self.stream.find(window)
        while at >= 0:
            if at in self.edges() and at + len(window) in self.edges():
                return True
            at = self.stream.find(window, at + 1)
        return False


def _search(test: TestSet):
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list[str]] = {}
        for b in batches:
            texts = [spaced(t) if t else "" for t in b.column(1).to_pylist()]
            docs, items, known = [], [], {}
            for (d, at), (first, last) in _candidates(texts, test):
                if at not in made:
                    if len(made) >= 1000:
                        made.clear()
                    made[at] = test.windows(at)
                if d not in known:
                    known = {d: _Text(texts[d])}
                if any(map(known[d].holds, made[at][first : last + 1])):
                    docs.append(d)
                    items.append(test.items[at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), pa.array(items, pa.int64())], schema=out)

    return run


def _candidates(texts: list[str], test: TestSet) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(text, item) that share a fingerprint, both as places, and the first and last of the item's windows that hold one."""
    streams = [t.replace(" ", "").encode() for t in texts]
    need = test.k + test.w - 1
    long = [i for i, s in enumerate(streams) if len(s) >= need]
    if not long or not len(test.prints):
        return []
    # one array for the batch; k-grams across two texts only add candidates that the exact step refuses
    joined = np.frombuffer(b"".join(streams[i] for i in long), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(streams[i]) for i in long])])
    m = _minima(_hashes(joined, test.k), test.w)
    new = np.append(True, m[1:] != m[:-1])
    at = np.flatnonzero(new)
    lo, hi = np.searchsorted(test.prints, m[at], "left"), np.searchsorted(test.prints, m[at], "right")
    hit = hi > lo
    # a run of equal minima may reach into the next texts
    reach = np.append(at[1:], len(m))[hit]
    first, last = np.searchsorted(start, at[hit], "right") - 1, np.searchsorted(start, reach - 1, "right") - 1
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for a, z, x, y in zip(first.tolist(), last.tolist(), lo[hit].tolist(), hi[hit].tolist()):
        for o, u, v in zip(test.owner[x:y].tolist(), test.first[x:y].tolist(), test.last[x:y].tolist()):
            for j in range(a, min(z, len(long) - 1) + 1):
                old = found.get((long[j], o))
                found[long[j], o] = (min(u, old[0]), max(v, old[1])) if old else (u, v)
    return sorted(found.items())


def leaked_passages(documents: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 12, hold: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id) for each document that holds at least min_words consecutive words of the item's passage.

    `items` (item_id, passage) is the held-out set; up to `hold` words of it are gathered, which bounds what each task holds, and it is searched in
    blocks of that size beyond. Whole texts are read, however long. Null and empty texts and passages, and passages of fewer words, match nothing;
    repeated documents and items each match. Rows are distinct. Other columns are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    held = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").where("item_id is not null and passage is not null")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    sizes = held.select("item_id", F.size(F.split("passage", r"\s+")).alias("words"))
    blocks = max(1, -(-(sizes.agg(F.sum("words")).first()[0] or 0) // hold))
    out = None
    for block in range(blocks):  # one block unless the test set is very large: the corpus is read once for each
        part = [(r.item_id, r.passage) for r in held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator()]
        found = docs.mapInArrow(_search(TestSet(part, min_words)), "doc_id long, item_id long")
        out = found if out is None else out.union(found)
    return (out if out is not None else spark.createDataFrame([], "doc_id long, item_id long")).distinct()
