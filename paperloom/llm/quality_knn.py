"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes hashed counts of character-shape trigrams (classes of characters, marks as
themselves), of letter trigrams, and a few bins of how much words and lines repeat; square roots,
inverse document frequency and a truncated singular value decomposition make it a vector of RANK
numbers.  The decomposition and the labelled vectors come from a bounded sample: PER_CLASS rows
of each label, those of least hashed id, weighted back to the labels' shares.  Both are broadcast
(under 2 MB by these bounds).  Every document's cosines with all of them are one matrix product a
block; the NEAREST vote with their similarity to the power SHARP.

The score reads whole texts and nothing but texts.  A text with no features (null, empty) gets
the share of label 1, as does every text where nothing was learned from both labels (0.5 if from none).
Of neighbours as near as the last that votes those learned first (by doc_id, label) vote.  Labels
without a document or with a null id, and documents with a null id, teach nothing; of documents that
repeat an id the text of least hash teaches; an id with both labels teaches both.  Rows that repeat
are each scored; an empty table gives an empty one; a column ``quality_score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.shared import by_batch, tidy

PER_CLASS = 1500
RANK, NEAREST, SHARP = 48, 15, 8
SHAPES, LETTERS, BINS = 1024, 512, 16
WIDTH = SHAPES + LETTERS + 2 * BINS
_classes: np.ndarray | None = None


def _class_of() -> np.ndarray:
    """Class of each code point below U+3000: small and capital letters, digits, white space, other, and each ASCII mark its own."""
    global _classes
    if _classes is None:
        kinds = []
        for c in map(chr, range(0x3000)):
            kinds.append(1 if c.islower() else 2 if c.isupper() else 3 if c.isalpha() else 4 if c.isdigit() else 5 if c == "\n" else 6 if c.isspace() else 8 + ord(c) if c < "\x80" else 7)
        _classes = np.array(kinds, np.int64)
    return _classes


def features(text: str | None) -> np.ndarray:
    """WIDTH numbers, zero for an empty text."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    kinds = _class_of()[np.minimum(c, 0x2FFF)]
    k = np.concatenate([[6], kinds, [6]])
    shape = ((k[:-2] * 160 + k[1:-1]) * 160 + k[2:]) * 2654435761 >> 8 & (SHAPES - 1)
    out[:SHAPES] = np.bincount(shape, minlength=SHAPES)
    if len(c) > 2:
        low = np.where(kinds == 2, c | 32, c)
        gram = ((low[:-2] * 31 + low[1:-1]) * 1009 + low[2:]) * 2654435761 >> 10 & (LETTERS - 1)
        out[SHAPES : SHAPES + LETTERS] = np.bincount(gram, minlength=LETTERS)
    words, lines = text.split(), text.split("\n")
    for at, units in ((SHAPES + LETTERS, words), (SHAPES + LETTERS + BINS, lines)):
        again = sum(map(eq, units, units[1:])) / len(units) if units else 0
        few = 1 - len(set(units)) / len(units) if units else 0
        out[at + min(7, int(8 * again))] = 1
        out[at + 8 + min(7, int(8 * few))] = 1
    out[:SHAPES] = np.sqrt(out[:SHAPES] / max(1, out[:SHAPES].sum()))
    out[SHAPES : SHAPES + LETTERS] = 0.5 * np.sqrt(out[SHAPES : SHAPES + LETTERS] / max(1, out[SHAPES : SHAPES + LETTERS].sum()))
    out[SHAPES + LETTERS :] *= 0.25
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class Neighbours:
    """Projection and labelled vectors."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, rank: int = RANK):
        self.labels, self.weights = labels.astype(np.float64), weights.astype(np.float64)
        self.prior = float((self.labels * self.weights).sum() / self.weights.sum()) if len(x) else 0.5
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
        y = x * self.idf
        rng, rank = np.random.default_rng(7), min(rank, *x.shape) if len(x) else 0
        if rank:  # randomized range finder, three power steps
            q = np.linalg.qr(y @ rng.standard_normal((y.shape[1], min(len(y), rank + 16))).astype(np.float32))[0]
            for _ in range(3):
                q = np.linalg.qr(y @ np.linalg.qr(y.T @ q)[0])[0]
            self.project = np.ascontiguousarray(np.linalg.svd(q.T @ y, full_matrices=False)[2][:rank].T * self.idf[:, None])
            self.vectors = unit_rows(x @ self.project)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of features."""
        if not 0 < self.labels.sum() < len(self.labels):
            return np.full(len(x), self.prior)
        some, k = np.abs(x).sum(axis=1) > 0, min(NEAREST, len(self.vectors))
        near = unit_rows(x @ self.project) @ self.vectors.T
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(near, at, 1).min(axis=1, keepdims=True)
        for r in np.flatnonzero((near >= last).sum(axis=1) > k):
            at[r] = np.argsort(-near[r], kind="stable")[:k]
        w = np.take_along_axis(near, at, 1).clip(min=0).astype(np.float64) ** SHARP * self.weights[at]
        total = w.sum(axis=1)
        return np.where(some & (total > 0), (w * self.labels[at]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", per_class: int = PER_CLASS) -> Neighbours:
    """From documents (doc_id, text) and labels (doc_id, 0 or 1) of the rows under ``learn``, a condition on doc_id."""
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("label")).dropDuplicates()
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in sorted(totals):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return Neighbours(np.zeros((0, WIDTH), np.float32), np.zeros(0), np.zeros(0))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 x per_class ids at most
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    made = by_batch(rows.select("doc_id", "label", "text"), lambda c: {"doc_id": c["doc_id"], "label": c["label"], "x": [features(t).astype(np.float16).tobytes() for t in c["text"]]}, "doc_id long, label int, x binary")
    found = sorted((r["doc_id"], r["label"], bytes(r["x"])) for r in made.collect())
    y = np.array([l for _, l, _ in found], np.int64)
    n = np.bincount(y, minlength=2)
    x = np.array([np.frombuffer(v, np.float16) for *_, v in found], np.float32).reshape(-1, WIDTH)
    return Neighbours(x, y, np.array([totals[l] / n[l] for l in y.tolist()]))


def predict(docs: DataFrame, model: Neighbours, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score; the other columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [c for c in docs.columns if c != "quality_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                x = np.array([features(t) for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in fields), pa.array(held.value.score(x), pa.float64())], names=[*fields, "quality_score"])
        tidy()

    return docs.select(*fields).mapInArrow(run, docs.select(*fields).schema.add("quality_score", "double"))
