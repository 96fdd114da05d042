"""Which texts are mainly English sentences: a classifier on character trigrams, fitted on the whole corpus, and words as vectors of hashes.

Readers grade English sentences only, so graded documents are examples of what is wanted; there are none of what isn't. A trigram model of all graded texts
scores all texts; they fall into two parts (the split with the largest variance between parts), and the lower part trains a second
model, once more after the texts are told apart by both. A text is English sentences if it is likelier under the first model than under the second and less unlikely than the
texts of the second are on average, so that a language or kind of log that is in neither is turned away too.
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

from lodestone.session import Scratch

SIGNS = 30  # blank and other, a to z, digit, letter beyond ASCII, sign
SMOOTH = 5.0  # weight of the bigram model behind a trigram
BIN = 1e-4  # width of the bins in which scores of all texts are counted to find the split
LEAST_OTHER = 0.01  # share of the texts below which the lower part is no kind of its own
MOST_WANTED = 0.05  # share of the graded texts in the lower part beyond which it isn't the unwanted one
PART = 2_000_000  # bytes of text that are hashed at a time

_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_SIGN = np.zeros(256, np.uint8)
_SIGN[97:123] = np.arange(1, 27)
_SIGN[48:58], _SIGN[128:], _SIGN[list(b"=_/\\|[]{}<>@#*+%~^$")] = 27, 28, 29
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 1, 2
_JOIN = np.zeros(256, bool)
_JOIN[list(b"'-")] = True
_QUOTES = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": " ", "—": " ", "‐": "-", "­": "", "…": " ", "·": " ", "×": " ", "°": " ", "±": " "})
_P = 0x9E3779B97F4A7C15 | 1


def plain(text: str | None) -> str:
    """Lower case, without tags and entities, letters without accents."""
    if not text:
        return ""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", html.unescape(text) if "&" in text else text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_QUOTES)) if not unicodedata.combining(c))
    return text.lower()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text of each code) of plain texts; runs of blanks count as one, trigrams lie within a text."""
    raw = [t.encode() for t in texts]
    b = _SIGN[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0) | (b[:-1] != 0)
    b, doc = b[keep].astype(np.int32), doc[keep]
    if len(b) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    whole = doc[2:] == doc[:-2]
    return (b[:-2] * SIGNS**2 + b[1:-1] * SIGNS + b[2:])[whole], doc[2:][whole]


def _likelihood(counts: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of each trigram's last sign after its first two."""
    c = counts.reshape(SIGNS**2, SIGNS)
    pair = counts.reshape(SIGNS, SIGNS, SIGNS).sum(0) + 0.5
    pair /= pair.sum(1, keepdims=True)
    return np.log((c + SMOOTH * np.tile(pair, (SIGNS, 1))) / (c.sum(1, keepdims=True) + SMOOTH)).reshape(-1)


def split(x: np.ndarray, n: np.ndarray | None = None) -> float:
    """The value that parts numbers into two groups whose means differ most for their sizes. With n, each number stands for so many."""
    order = np.argsort(x)
    x, n = x[order], np.ones(len(x)) if n is None else n[order].astype(float)
    if len(x) < 2:
        return -np.inf
    k, low = np.cumsum(n)[:-1], np.cumsum(n * x)[:-1]
    rest, total = n.sum() - k, (n * x).sum()
    between = k * rest * (low / k - (total - low) / rest) ** 2
    at = int(between.argmax())
    return float(x[at] + x[at + 1]) / 2


class Sentences:
    """The fitted classifier. english, other: log-likelihoods by trigram; floor: the score under english that a text must exceed."""

    def __init__(self, english: np.ndarray, other: np.ndarray | None, floor: float):
        self.english, self.other, self.floor = english.astype(np.float32), None if other is None else other.astype(np.float32), floor

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood a trigram under english, and what it is above that under other; -inf for texts without trigrams."""
        codes, doc = trigrams(texts)
        own = self.mean(self.english, codes, doc, len(texts))
        return own, np.where(np.isfinite(own), np.inf, -np.inf) if self.other is None else self.mean(self.english - self.other, codes, doc, len(texts))

    @staticmethod
    def mean(value: np.ndarray, codes: np.ndarray, doc: np.ndarray, m: int) -> np.ndarray:
        """Mean of a value over the trigrams of each of m texts."""
        n = np.bincount(doc, minlength=m)
        return np.where(n > 0, np.bincount(doc, value[codes], m) / np.maximum(n, 1), -np.inf)

    def accepts(self, texts: list[str]) -> np.ndarray:
        own, above = self.scores(texts)
        return (own > self.floor) & (above > 0)


CHANCE = float(np.log(1 / SIGNS))


def _counts(texts: DataFrame, model: Sentences | None = None, plainly: bool = False) -> np.ndarray:
    """Trigram counts over all of a table of texts (plain ones already, if `plainly`); with a model only over those that are less likely under english than under other.
    Each task sends a row a trigram at most, and their sums come to the driver: SIGNS ** 3 rows, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIGNS**3, np.int64)
        for b in batches:
            t = b.column(0).to_pylist() if plainly else [plain(x) for x in b.column(0).to_pylist()]
            codes, doc = trigrams(t)
            if model is not None:
                codes = codes[(model.mean(model.english - model.other, codes, doc, len(t)) < 0)[doc]]
            total += np.bincount(codes, minlength=SIGNS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    sums = texts.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIGNS**3)
    out[sums.code.to_numpy(int)] = sums.n.to_numpy(float)
    return out


def _english_scores(texts: DataFrame, model: Sentences) -> DataFrame:
    """(text, s): plain texts and their scores under english; texts without trigrams are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [plain(x) for x in b.column(0).to_pylist()]
            own = model.mean(model.english, *trigrams(t), len(t))
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(own)], names=["text", "s"]).filter(pa.array(np.isfinite(own)))

    return texts.select("text").mapInArrow(run, "text string, s double")


def fit_sentences(graded: DataFrame, texts: DataFrame) -> Sentences | None:
    """The classifier from all texts of graded documents and all texts. None without graded texts: then nothing is known.

    The scores of all texts are counted in bins of BIN, whose means and numbers decide the split; what comes to the driver is bounded by the number of bins and trigrams.
    """
    counts = _counts(graded)
    if not counts.sum():
        return None
    first = Sentences(_likelihood(counts), None, -np.inf)
    scratch = Scratch(texts.sparkSession, "sentences")
    try:
        scored = scratch.keep(_english_scores(texts, first))
        bins = scored.groupBy(F.floor(F.col("s") / BIN).alias("bin")).agg(F.count("*").alias("n"), F.avg("s").alias("s")).toPandas()
        at = split(bins.s.to_numpy(float), bins.n.to_numpy())
        low = scored.where(F.col("s") < at)
        n_low, mean_low = low.agg(F.count("*"), F.avg("s")).first()
        wanted = _english_scores(graded, first).agg(F.avg((F.col("s") < at).cast("int"))).first()[0]
        if n_low < LEAST_OTHER * bins.n.sum() or not n_low or (wanted or 0.0) > MOST_WANTED:
            return Sentences(first.english, None, CHANCE)
        second = Sentences(first.english, _likelihood(_counts(low, plainly=True)), -np.inf)
        return Sentences(first.english, _likelihood(_counts(scored, second, plainly=True)), float(mean_low))
    finally:
        scratch.clear()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct words and pairs of neighbouring words or numbers of plain texts, sorted by text and hash.

    A word is a run of letters, with apostrophes and hyphens inside. Hashes of 64 bits are taken from running sums over the bytes: no loop over words.
    """
    hashes, docs, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < PART):
            size += len(texts[hi])
            hi += 1
        h, d = _hash_part(texts[lo:hi])
        hashes.append(h)
        docs.append(d + lo)
        lo = hi
    return np.concatenate(hashes), np.concatenate(docs)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hash_part(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    b = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    begin = np.cumsum([1] + [len(r) + 1 for r in raw])
    kind = _KIND[b]
    inside = np.zeros(len(b), bool)
    inside[1:-1] = _JOIN[b[1:-1]] & (kind[:-2] == 1) & (kind[2:] == 1)
    kind = np.where(inside, np.uint8(1), kind)
    edge = kind[1:] != kind[:-1]
    start, end = np.flatnonzero(edge & (kind[1:] > 0)) + 1, np.flatnonzero(edge & (kind[:-1] > 0)) + 1
    with np.errstate(over="ignore"):
        power = np.full(len(b), _P, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        run = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(b.astype(np.uint64) * power)])
        back = np.full(len(b), pow(_P, -1, 1 << 64), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        h = _mix((run[end] - run[start]) * back[start] + (end - start).astype(np.uint64))
        doc = np.searchsorted(begin, start, "right") - 1
        word = kind[start] == 1
        same = doc[1:] == doc[:-1]
        pair = _mix(h[:-1] * np.uint64(0x94D049BB133111EB) + h[1:] * np.uint64(0xD6E8FEB86659FD93))[same]
    every, of = np.concatenate([h[word], pair]), np.concatenate([doc[word], doc[1:][same]])
    order = np.lexsort((every, of))
    every, of = every[order], of[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (of[1:] != of[:-1])
    return every[new], of[new]
