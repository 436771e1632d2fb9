"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, their stems (the first ``STEM`` characters, so that inflected and
compound forms share a weight), pairs of neighbours and pairs with one or two words between.
Labelled rows are sampled to at most about ``positives`` and ``negatives`` documents, the documented bound of the
fit; their hashed features are computed where the rows are, and one task learns from them in the order of a hash
of their ids, so a lost executor or another partitioning gives the same weights. Where the two labels were thinned by
different shares the bias is corrected for it, so a score means the same at every size. The L1 term leaves few weights,
which are broadcast. Scoring reads every document whole and shuffles nothing.

A null or empty text has no features: its score is the base rate. Without labelled rows every score is 0. Labels
that are null are skipped; several labels of one id count as their largest. Every input row gives one output row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, with_text_last

WORD = re.compile(r"\w+")
BITS = 20
STEM = 4
ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=50_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def features(text: str | None) -> np.ndarray:
    """The feature numbers of a text, with repeats."""
    words = WORD.findall(text.lower()) if text else []
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    shift = np.uint64(64 - BITS)
    stems = np.fromiter(map(_word_hash, [w[:STEM] for w in words]), np.uint64, len(words))
    out = [(h * ODD) >> shift, ((stems ^ ODD) * ODD) >> shift]
    for gap in (1, 2, 3):
        if len(h) > gap:
            salt = np.uint64(2 * gap + 1)
            out.append((((h[:-gap] * salt) ^ (h[gap:] >> np.uint64(7))) * ODD) >> shift)
    return np.concatenate(out).astype(np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float):
    """Weights by number and the bias: per-coordinate rates, L1 sparsity, several passes in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    bias = np.array([size])
    for _ in range(epochs):
        for numbers, label in rows:
            at = np.concatenate((numbers, bias))
            za, na = z[at], n[at]
            w = -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2)
            w[np.abs(za) <= l1] = 0
            if abs(za[-1]) <= l1:  # the bias has no L1 term
                w[-1] = -za[-1] / ((beta + np.sqrt(na[-1])) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    w[np.abs(z) <= l1] = 0
    if abs(z[-1]) <= l1:
        w[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha + l2)
    keep = np.flatnonzero(w[:-1])
    return keep.astype(np.int32), w[keep].astype(np.float32), float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = 3000, negatives: int = 6000, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 10.0, l2: float = 1.0,
) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Sparse weights ``(numbers, values, bias)``; ``None`` without labelled rows.

    ``positives`` and ``negatives`` bound the sample: each label's ids are thinned by a hash to that number on
    average, however many there are. The model has at most ``2 ** BITS`` weights.
    """
    known = (
        labels.select(F.col(f"`{id}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y"))
        .where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
        .withColumn("y", (F.col("y") > 0).cast("int"))
    )
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    order = F.xxhash64("i", F.lit(7))
    unit = (F.abs(order % 1_000_000) + 0.5) / 1_000_000
    share = {1: min(1, positives / max(1, counts.get(1, 0))), 0: min(1, negatives / max(1, counts.get(0, 0)))}
    chosen = known.where(unit < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    texts = docs.select(F.col(f"`{id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    rows = texts.join(F.broadcast(chosen), "i").select(order.alias("o"), "y", "t")

    def hashed(batch: pa.RecordBatch):
        numbers = [np.unique(features(t)).tobytes() for t in batch.column(2).to_pylist()]
        yield {"one": [1] * batch.num_rows, "o": batch.column(0), "y": batch.column(1), "f": numbers}

    def learn(pdf):
        pdf = pdf.sort_values(["o", "y"], kind="stable")
        rows = [(np.frombuffer(f, np.int32), int(y)) for f, y in zip(pdf["f"], pdf["y"])]
        numbers, values, bias = ftrl(rows, epochs, alpha, beta, l1, l2)
        import pandas as pd

        return pd.DataFrame({"n": [numbers.tobytes()], "w": [values.tobytes()], "b": [bias]})

    model = (
        map_arrow(rows, hashed, "one int, o bigint, y int, f binary")
        .groupBy("one").applyInPandas(learn, "n binary, w binary, b double").first()
    )
    if model is None:
        return None
    # the sample's odds are the table's times the ratio of the shares; with one label only there are no odds
    moved = float(np.log(share[1] / share[0])) if len(counts) == 2 and share[1] and share[0] else 0.0
    return np.frombuffer(model.n, np.int32), np.frombuffer(model.w, np.float32), model.b - moved


def score(df: DataFrame, model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Add ``out``, the probability of the label, to the columns in ``keep`` (all)."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    source = with_text_last(df, keep, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        scores = [0.0] * batch.num_rows
        if shared.value is not None:
            numbers, values, bias = shared.value
            weights = np.zeros(1 << BITS, np.float32)
            weights[numbers] = values
            used = weights != 0
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                f = features(t)
                total = bias + float(weights[np.unique(f[used[f]])].sum(dtype=np.float64))
                scores[i] = float(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        yield {c: batch.column(i) for i, c in enumerate(keep)} | {out: scores}

    return map_arrow(source, run, T.StructType([*source.schema.fields[:-1], T.StructField(out, T.DoubleType())]))
