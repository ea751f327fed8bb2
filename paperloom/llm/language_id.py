"""Language by rank-order profiles of letter n-grams.

A profile is a language's PROFILE most frequent 1- to 3-grams of its letters (words in lower case
between single spaces), in order of frequency.  A document's own most frequent n-grams are
compared with each by the out-of-place distance: the sum of rank differences, PROFILE for an
n-gram the profile lacks, as a share of the greatest possible.  The nearest language wins (ties:
the least name); the score is one minus its distance.

Profiles are fitted on a bounded sample of the labelled rows: about SAMPLE documents a language,
those of least hash of id and text.  Prediction reads whole texts and nothing but texts.  Null texts
and texts without a letter are ``und`` with score 0, as is every text if nothing was learned.
Rows that repeat are each predicted, null ids too; an empty table gives an empty one; columns
``lang_pred`` and ``score`` are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paperloom.llm.shared import by_batch, tidy

PROFILE = 300
SAMPLE = 1500
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a character) and counts of the text's letter n-grams; none if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    c = np.concatenate([[32], np.where(_is_letter()[c], c, 32), [32]])
    c = c[np.append((c[1:] != 32) | (c[:-1] != 32), True)]
    c = c if c[-1] == 32 else np.append(c, 32)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two, middle = c[:-1] << 21 | c[1:], c[1:-1]
    three = (two[:-1] << 21 | c[2:])[middle != 32]
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, the most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, size: int = PROFILE, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, list[int]]:
    """Profiles of the languages that the rows under ``learn`` with a language and a text name."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)).alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(False)
    for lang, n in sorted(counts.items()):
        share = share | ((F.col("lang") == lang) & (F.col("h") < int((1 << 30) * min(1.0, sample / n))))

    def count(c: dict[str, list]) -> dict[str, list]:
        by: dict[str, list] = {}
        for lang, text in zip(c["lang"], c["text"], strict=True):
            by.setdefault(lang, []).append(ngrams(text))
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang, found in by.items():
            codes, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            n = np.bincount(back, np.concatenate([y for _, y in found]), len(codes)).astype(np.int64)
            out["lang"] += [lang] * len(codes)
            out["gram"] += codes.tolist()
            out["n"] += n.tolist()
        return out

    grams = by_batch(known.where(share).select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams), len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), k] = np.arange(len(profiles[name]))

    def judge(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text), self.size) if text else ()
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.grams, own).clip(max=len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        k = int(apart.argmin())
        return self.names[k], float(1 - apart[k] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; the other columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x PROFILE codes
    fields = [f.name for f in docs.schema if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(held.value, size)
        for b in batches:
            said = [model.judge(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())], names=[*fields, "lang_pred", "score"])
        tidy()

    schema = docs.select(*fields).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, schema)
