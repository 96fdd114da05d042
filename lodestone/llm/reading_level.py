"""How demanding each document is to read, from graded examples, by harmonic propagation on the document-word graph.

What isn't mainly English sentences is set aside first (`language.py`).

Documents and their words and word pairs form a bipartite graph. Every distinct word and pair has a node of its own, known by a full hash and numbered
by its place among the sorted hashes of the corpus. Graded documents are clamped to their grades; in every round a word takes the weighted mean of its
documents and a document that of its words, so that grades spread through shared vocabulary and not through lengths of words or sentences. Words whose
documents agree carry more weight. Word scores are a table in the shared folder that tasks read, as the vocabulary grows with the corpus; they pass neither
the driver nor a broadcast. A document sends none of its links: each batch adds up its documents' part of every word's mean, and these sums are added in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.language import Sentences, fit_sentences, plain, word_hashes
from lodestone.session import Scratch


def _featurise(model: Sentences | None):
    """Texts to the hashes of their words and pairs; logs, other languages and texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [plain(t) for t in b.column(1).to_pylist()]
            keep = np.flatnonzero(model.accepts(texts)) if model else np.flatnonzero([bool(t) for t in texts])
            hashes, doc = word_hashes([texts[i] for i in keep])
            sizes = np.bincount(doc, minlength=len(keep))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes.view(np.int64)))
            some = pa.array(sizes > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())).filter(some), lists.filter(some)], names=["doc_id", "nodes"])

    return run


def _number(vocabulary: str):
    """Hashes to places among the sorted hashes of the vocabulary, a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            if known is None:
                known = np.sort(pq.read_table(vocabulary, columns=["node"], use_threads=False)["node"].to_numpy())
            lists = b.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            at = np.searchsorted(known, np.asarray(lists.flatten(), np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(at, pa.int32()))], names=["doc_id", "nodes"])

    return run


class Words:
    """Score and weight of every word node, read from a table in the shared folder by the task that needs them; none before the first round."""

    def __init__(self, n: int, start: float, path: str | None = None):
        self.n, self.start, self.path = n, start, path

    def load(self) -> tuple[np.ndarray, np.ndarray]:
        word, weight = np.full(self.n, self.start), np.zeros(self.n)
        if self.path:
            t = pq.read_table(self.path, use_threads=False)
            at = t["node"].to_numpy()
            word[at], weight[at] = t["word"].to_numpy(), t["weight"].to_numpy()
        return word, weight


class Grades:
    """All graded documents, a table (doc_id, level) in the shared folder that a task reads once, to look up in a batch."""

    def __init__(self, path: str):
        self.path = path

    def of(self, ids: np.ndarray) -> np.ndarray:
        known = self.__dict__.get("_known")
        if known is None:
            t = pq.read_table(self.path, use_threads=False)
            order = np.argsort(t["doc_id"].to_numpy())
            known = self._known = t["doc_id"].to_numpy()[order], t["level"].to_numpy()[order]
        if not len(known[0]):
            return np.full(len(ids), np.nan)
        at = np.searchsorted(known[0], ids).clip(max=len(known[0]) - 1)
        return np.where(known[0][at] == ids, known[1][at], np.nan)


def _scores(b: pa.RecordBatch, word: np.ndarray, weight: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: the weighted mean of each document's words, and its links as (place of document, node)."""
    lists = b.column(1)
    node = np.asarray(lists.flatten(), np.int64)
    doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0), np.int64))
    w = weight[node]
    den = np.bincount(doc, w, len(lists))
    return np.where(den > 0, np.bincount(doc, w * word[node], len(lists)) / np.maximum(den, 1e-300), start), doc, node


def _place(medians: pd.DataFrame, levels: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(levels with graded documents, their places on the raw score, rising)."""
    known = medians.sort_values("level")
    known = known[(known.level >= 1) & (known.level <= levels)]
    if not len(known):
        return None
    return known.level.to_numpy(float), np.maximum.accumulate(known.m.to_numpy(float)) + np.arange(len(known)) * 1e-6


def _round(grades: Grades, words: Words, own: float, place):
    """Partial sums of one round: for every word of a batch, weight, weighted level and weighted squared level of its documents. Documents
    that have no grade weigh `own`; their means, which shrink towards the middle, are first stretched back by `place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, weight = words.load()
        for b in batches:
            if not b.num_rows:
                continue
            level, doc, node = _scores(b, word, weight, words.start)
            if place is not None:
                level = np.interp(level, place[1], place[0])
            g = grades.of(np.asarray(b.column(0), np.int64))
            graded = np.isfinite(g)
            level, d = np.where(graded, g, level), np.where(graded, 1.0, own)
            n = np.bincount(node, d[doc], words.n)
            at = np.flatnonzero(n)
            s, s2 = (np.bincount(node, v[doc], words.n)[at] for v in (d * level, d * level**2))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(s), pa.array(s2)], names=["node", "n", "s", "s2"])

    return run


def reading_scores(documents: DataFrame, labels: DataFrame, levels: int = 4, rounds: int = 8, own: float = 0.3, settled: float = 0.002) -> tuple[DataFrame, tuple | None]:
    """(doc_id, score) for every document that is mainly English sentences, and the places of the levels on the score (None without grades).

    All graded documents are clamps, and all documents take part in the graph and in the classifier of sentences. Rounds end early when no level's place moves by more than `settled`.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "reading-level")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    graded = labels.where("doc_id is not null and reading_level is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("reading_level").alias("level"))
    graded = scratch.keep(graded)
    grades = Grades(graded._lodestone_path)
    middle = graded.agg(F.avg("level")).first()[0]
    model = None if middle is None else fit_sentences(docs.mapInArrow(_graded_only(grades), "doc_id long, text string"), docs)
    hashed = scratch.keep(docs.mapInArrow(_featurise(model), "doc_id long, nodes array<long>"))
    vocabulary = scratch.keep(hashed.select(F.explode("nodes").alias("node")).distinct())
    nodes = scratch.keep(hashed.mapInArrow(_number(vocabulary._lodestone_path), "doc_id long, nodes array<int>"))
    scratch.drop(hashed)
    start = (levels + 1) / 2 if middle is None else float(middle)
    size, place, scored = vocabulary.count(), None, None
    words = Words(size, start)
    scratch.drop(vocabulary)
    # the graded documents by themselves, for the places of the levels
    sample = scratch.keep(nodes.mapInArrow(_graded_only(grades), "doc_id long, nodes array<int>"))
    mean, square = F.col("s") / F.col("n"), F.col("s2") / F.col("n")
    spread = F.greatest(square - mean * mean, F.lit(0.0))
    for r in range(rounds):
        # in the first round only graded documents speak
        parts = (nodes if r else sample).mapInArrow(_round(grades, words, own if r else 0.0, place), "node int, n double, s double, s2 double")
        sums = parts.groupBy("node").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
        last, scored = scored, scratch.keep(sums.select("node", mean.alias("word"), (1 / (0.05 + spread + 1 / (F.col("n") + 1))).alias("weight")))
        words = Words(size, start, scored._lodestone_path)
        if last is not None:
            scratch.drop(last)
        found = sample.mapInArrow(_graded_scores(grades, words), "level int, score double").groupBy("level").agg(F.percentile_approx("score", 0.5, 10_000).alias("m")).toPandas()
        before, place = place, _place(found, levels)
        if r > 1 and before is not None and place is not None and len(before[1]) == len(place[1]) and np.abs(before[1] - place[1]).max() <= settled:
            break

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, weight = words.load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b, word, weight, start)[0])], names=["doc_id", "score"])

    return nodes.mapInArrow(final, "doc_id long, score double"), place


def _graded_only(grades: Grades):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.isfinite(grades.of(np.asarray(b.column(0), np.int64)))))

    return run


def _graded_scores(grades: Grades, words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, weight = words.load()
        for b in batches:
            g = np.round(grades.of(np.asarray(b.column(0), np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(_scores(b, word, weight, words.start)[0])], names=["level", "score"])

    return run


def reading_levels(documents: DataFrame, labels: DataFrame, levels: int = 4, **how) -> DataFrame:
    """(doc_id, reading_level, score), levels 1 (easiest) to `levels`.

    A level's place on the score is the median score of the documents graded with it; limits lie midway. Levels without a graded document are placed in
    line with the others. The grade of a document only enters through the graph, so a rater's slip doesn't fix its level. Logs, other
    languages, null and empty texts have no row; without any grade the level is null. Repeated ids each get a row.
    """
    scores, found = reading_scores(documents, labels, levels, **how)
    if found is None:
        return scores.select("doc_id", F.lit(None).cast("int").alias("reading_level"), "score")
    (x, y), at = found, np.arange(1, levels + 1, dtype=float)
    if len(x) > 1:
        slope = (y[-1] - y[0]) / (x[-1] - x[0])
        place = np.where(at < x[0], y[0] + (at - x[0]) * slope, np.where(at > x[-1], y[-1] + (at - x[-1]) * slope, np.interp(at, x, y)))
    else:
        place = y[0] + (at - x[0])
    limits = (place[1:] + place[:-1]) / 2
    level = F.lit(1)
    for v in limits:
        level = level + (F.col("score") > float(v)).cast("int")
    return scores.select("doc_id", level.cast("int").alias("reading_level"), "score")
