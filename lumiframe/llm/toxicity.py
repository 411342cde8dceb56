"""Toxicity by multiple-instance learning: a document is toxic if some sentence is.

Only documents are labelled. A sentence's score is a logistic model of its hashed words and word beginnings; a document's is
the noisy-or of its sentences. Training follows the gradient of the document's likelihood through the noisy-or, so
blame goes to the sentences that explain a toxic label, and every sentence of a clean document is clean. The fitted
sentence model then locates the offending sentences. The document score is calibrated on held-back sample texts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumiframe.llm import words as W
from lumiframe.llm.sampling import below, bounded_sample, fit_on, place, threshold
from lumiframe.llm.storage import small_batches

BITS = 18
#: Pull of weights towards zero: only features that many sample documents agree on keep a weight.
PULL = 0.02
#: Letters of the word beginnings that are features beside the words.
PREFIXES = (4, 5)
#: Sample texts that must hold a feature for it to get a weight.
LEAST_TEXTS = 5
_STRIP = np.zeros(256, dtype=bool)
_STRIP[[ord(c) for c in "\"'()[]{}.,;:!?|*#%&$_-<>=+/\\~`"]] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True


class Features:
    """Hashed words and their first letters, and the sentence each lies in. Words are taken without the
    punctuation around them; a sentence ends with a word that ends in . ! or ?, at a line's end or with the text."""

    def __init__(self, words: W.Words):
        data, start, end = words.data, words.start.copy(), words.end.copy()
        n = len(start)
        closes = np.zeros(n, dtype=bool)
        if n:
            last = data[end - 1]
            closes = _ENDS[last]
            lines = np.concatenate([[0], np.cumsum(data == 10)])
            closes[:-1] |= lines[start[1:]] > lines[end[:-1]]
            closes[words.first[1:][np.diff(words.first) > 0] - 1] = True
            for _ in range(3):
                tail = (end - start > 1) & _STRIP[data[end - 1]]
                end[tail] -= 1
                head = (end - start > 1) & _STRIP[data[np.minimum(start, len(data) - 1)]]
                start[head] += 1
        up, down = W._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(W._BYTE[data] * up[: len(data)], out=total[1:])
        bare = W.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        self.sentence = np.cumsum(closes) - closes
        self.words, self.doc = words, words.doc
        size = np.uint64((1 << BITS) - 1)
        parts = [bare]
        for letters in PREFIXES:  # of code points: a word's beginning, if the word goes on after it
            char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            at = np.searchsorted(char, char[start] + letters, side="right") - 1
            stem = W.mix((total[np.minimum(at, len(data))] - total[start]) * down[start] + W.PLACE[letters])
            parts.append(np.where(at < end, stem, bare))
        index = (np.concatenate(parts) & size).astype(np.int64)
        held = np.sort((np.tile(self.sentence, len(parts)) << BITS) | index)  # a sentence has a feature or not
        held = held[np.concatenate([[True], held[1:] != held[:-1]])] if len(held) else held
        self.index, self.owner = held & ((1 << BITS) - 1), held >> BITS
        self.count = int(self.sentence[-1]) + 1 if n else 0
        self.sentence_doc = np.zeros(self.count, dtype=np.int64)
        if n:
            self.sentence_doc[self.sentence] = self.doc
        #: first word of every sentence
        self.opens = np.flatnonzero(np.concatenate([[True], self.sentence[1:] != self.sentence[:-1]])) if n else np.zeros(0, int)


class ToxicityModel:
    """Sentence weights, bias and the calibration (a, b) of the document's log odds."""

    def __init__(self):
        self.weight = np.zeros(1 << BITS, dtype=np.float32)
        self.bias, self.scale, self.shift = -3.0, 1.0, 0.0

    def sentences(self, f: Features) -> np.ndarray:
        return np.bincount(f.owner, self.weight[f.index], minlength=f.count) + self.bias

    def documents(self, f: Features, docs: int) -> np.ndarray:
        """log odds of the noisy-or of each document's sentences."""
        clean = np.bincount(f.sentence_doc, -np.logaddexp(0, self.sentences(f)), minlength=docs)
        return np.log(-np.expm1(np.minimum(clean, -1e-12))) - clean

    def calibrated(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * odds + self.shift, -30, 30)))

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], share: float | None = None, epochs: int = 60, seed: int = 5, pull_to_zero: float = PULL) -> ToxicityModel:
        """Adagrad on the noisy-or likelihood with an L1 pull towards zero."""
        model = cls()
        aside = np.arange(len(texts)) % 5 == 4
        train = [(t, y) for t, y, a in zip(texts, labels, aside, strict=True) if not a]
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(train))
        batches = [[train[i] for i in order[at : at + 256]] for at in range(0, len(train), 256)]
        parts = [(f, np.array([y for _, y in b], dtype=np.float64)) for b in batches for f in _features([t for t, _ in b])]
        texts_of = np.zeros(1 << BITS, dtype=np.int64)
        for f, _ in parts:
            own = np.unique((f.sentence_doc[f.owner] << BITS) | f.index)
            texts_of += np.bincount(own & ((1 << BITS) - 1), minlength=1 << BITS)
        usable = texts_of >= LEAST_TEXTS
        grad2, bias2 = np.full(1 << BITS, 1e-2), 1.0
        for epoch in range(epochs):
            for f, y in parts:
                s = model.sentences(f)
                p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
                clean = np.bincount(f.sentence_doc, -np.logaddexp(0, s), minlength=len(y))
                dirty = -np.expm1(np.minimum(clean, -1e-9))
                # d loglik / d s of a sentence: p (1 - P) / P in a toxic document, -p in a clean one
                pull = np.where(y > 0, np.exp(clean) / dirty, -1.0)[f.sentence_doc] * p
                g = np.bincount(f.index, pull[f.owner], minlength=1 << BITS)
                touched = np.flatnonzero((g != 0) & usable)
                grad2[touched] += g[touched] ** 2
                w = model.weight[touched] + 0.3 * g[touched] / np.sqrt(grad2[touched])
                model.weight[touched] = np.sign(w) * np.maximum(np.abs(w) - pull_to_zero / np.sqrt(grad2[touched]), 0)
                total = pull.sum()
                bias2 += total**2
                model.bias += 0.3 * total / np.sqrt(bias2)
        held = [(t, y) for t, y, a in zip(texts, labels, aside, strict=True) if a]
        if held:
            odds = np.concatenate([model.documents(f, f.words.docs) for f in _features([t for t, _ in held])])
            model._calibrate(np.clip(odds, -12, 12), np.array([y for _, y in held], dtype=np.float64), share)
        return model

    def _calibrate(self, odds: np.ndarray, y: np.ndarray, share: float | None) -> None:
        """Platt scaling with smoothed targets; share is that of label 1 among all labelled rows, which the sample lacks."""
        pos, neg = (y > 0).sum(), (y == 0).sum()
        if not pos or not neg:
            return
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        share = pos / len(y) if share is None else share
        each = np.where(y > 0, share / pos, (1 - share) / neg) * len(y)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * odds + b)))
            w = each * p * (1 - p) + 1e-9
            h = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, [(each * (target - p) * odds).sum() - 1e-3 * (a - 1), (each * (target - p)).sum()])
            a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
        self.scale, self.shift = float(max(a, 0.05)), float(b)


def _features(texts: list[str]) -> Iterator[Features]:
    """One Features of a small batch of texts (any size of text)."""
    for _, words in W.slices(pa.array(texts, pa.large_string()), 1 << 62):
        yield Features(words)


def _sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, per_class: int, per_class_chars: int) -> tuple[DataFrame, float | None]:
    """(label, n, text) and the share of label 1 among all labelled rows. Ids are chosen from ids and labels alone; then one
    scan picks the texts of the chosen ids, which are at most a few thousand and are broadcast."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    own = docs.select(F.col(f"`{id_col}`").alias("id"))
    counts = {r["label"]: r["count"] for r in own.join(known, "id").groupBy("label").count().collect()}
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).join(known, "id").select("id", "label").distinct()
    picked = {r["label"]: threshold(per_class, r["count"]) for r in ids.groupBy("label").count().collect()}
    chosen = known.filter(below(F.col("label"), picked, place("id", F.lit(3)))).join(own, "id", "left_semi")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text <> ''").join(F.broadcast(chosen), "id")
    every = sum(counts.values())
    sample = bounded_sample(rows.select("label", "text", place("id", "text", F.lit(3)).alias("h")), per_class, per_class_chars)
    return sample, counts.get(1, 0) / every if every else None


def _fit(share: float | None):
    def run(found: dict[int, list[str]]) -> ToxicityModel | None:
        rows = [(t, y) for y, texts in found.items() for t in texts]
        rows = [rows[i] for i in np.random.default_rng(11).permutation(len(rows))]
        return ToxicityModel.fit([t for t, _ in rows], [y for _, y in rows], share) if len(found) == 2 else None

    return run


def _spans(f: Features, d: int, s: np.ndarray, at_least: float) -> list[str]:
    own = np.flatnonzero((f.sentence_doc == d) & (s >= at_least))
    ends = np.append(f.opens[1:], len(f.words.start))
    return [f.words.data[f.words.start[f.opens[i]] : f.words.end[ends[i] - 1]].tobytes().decode("utf-8", "replace") for i in own]


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "label", id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, per_class: int = 3000, per_class_chars: int = 15_000_000, spans: bool = False
) -> DataFrame:
    """docs with score (0 to 1), predicted (1 if score >= cut), n_sentences and n_offending (and the offending sentences'
    texts, `sentences`, if asked for); input columns of these names are replaced.

    labels: rows with id_col and `label` (0 or 1; others are ignored; an id with both is 1). Rows of docs where `train`
    holds (default: all) and whose id has a label are learned from: at most per_class texts of each label, and no further
    one after per_class_chars characters, in the order of a hash. Rows of one id are texts of their own. Every text is
    scored whole. A null text counts as empty; an empty one has the score of a text without sentences. Without both
    labels, or without rows, every score is 0.5."""
    spark = docs.sparkSession
    small_batches(spark)
    sample, share = _sample(docs if train is None else docs.filter(train), labels, label, id_col, text_col, per_class, per_class_chars)
    sent = spark.sparkContext.broadcast(fit_on(sample, _fit(share)) or pickle.dumps(None))
    new = ["score", "predicted", "n_sentences", "n_offending", *(["sentences"] if spans else [])]
    base = docs.drop(*new)
    names, at_col = base.columns, base.columns.index(text_col)
    schema = StructType([*base.schema.fields, *StructType.fromDDL("score double, predicted int, n_sentences bigint, n_offending bigint" + (", sentences array<string>" if spans else "")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            for at, words in W.slices(batch.column(at_col)):
                f, n = Features(words), words.docs
                score, bad = np.full(n, 0.5), np.zeros(n, dtype=np.int64)
                s = np.zeros(f.count)
                if own is not None:
                    score = own.calibrated(np.clip(own.documents(f, n), -12, 12))
                    s = own.sentences(f)
                    bad = np.bincount(f.sentence_doc[s >= 0], minlength=n)
                cols = [pa.array(score), pa.array((score >= cut).astype(np.int32)), pa.array(np.bincount(f.sentence_doc, minlength=n).astype(np.int64)), pa.array(bad.astype(np.int64))]
                if spans:
                    cols.append(pa.array([_spans(f, d, s, 0.0) if bad[d] else [] for d in range(n)], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, *cols], names=[*names, *new])

    return base.mapInArrow(run, schema)
